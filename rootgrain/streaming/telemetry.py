"""The batch operators' counterparts on streams: rules, log counts, runs of anomalies, parents of spans.

Streams are DataFrames from readStream with an event time `ts` (timestamp). Watermarks or lifetimes bound the state.
"""

import collections
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import rules


@contextmanager
def lasting_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, which state with a lifetime takes, and run
    no batch without data: one that counts lifetimes would always ask for another, and never end."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _micros(span: str) -> int:
    """A span like 10 minutes in microseconds."""
    return int(pd.Timedelta(span) // pd.Timedelta(1, "us"))


def apply_rules(stream: DataFrame, rule_list: list[rules.Rule], good: str, bad: str, checkpoint: str, trigger: dict | None = None):
    """Starts the rule engine on a stream: each micro-batch is classified once and written to two Parquet
    tables, output and quarantine, so that input = output + quarantine in every batch. A batch that is
    run again after a failure replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        output, quarantine = rules.transform(held, rule_list)
        output.write.mode("overwrite").parquet(f"{good}/batch={number}")
        quarantine.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_counts(stream: DataFrame, *key: str, seconds: int = 15, lateness: str = "1 minute") -> DataFrame:
    """(key, bucket_start, cluster, n) of tumbling windows that are closed; rows later than the watermark
    are dropped (windows_or_late() tells them). Buckets without rows are added when a finished range is read, by reshape.log_grid."""
    counted = stream.withWatermark("ts", lateness).groupBy(*key, F.window("ts", f"{seconds} seconds").alias("_w"), "cluster").agg(F.count("*").alias("n"))
    return counted.select(*key, F.col("_w.start").alias("bucket_start"), "cluster", "n")


def occurrences(stream: DataFrame, *key: str, minutes: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """(key, period_start, period_end, n) of tumbling windows of so many minutes."""
    counted = stream.withWatermark("ts", lateness).groupBy(*key, F.window("ts", f"{minutes} minutes").alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(*key, F.col("_w.start").alias("period_start"), F.col("_w.end").alias("period_end"), "n")


class _Windows(StatefulProcessor):
    """Counts of a key's open windows (start, count), and the latest time that earlier batches brought."""

    def __init__(self, key: tuple[str, ...], size: int, lateness: int, ttl_ms: int | None):
        self.key, self.size, self.lateness, self.ttl = key, size, lateness, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at long", self.ttl)
        self.open = handle.getMapState("open", "start long", "n long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        before = self.latest.get()[0] if self.latest.exists() else None
        latest, counts = before, collections.Counter()

        def told(**columns) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(self.key, key, strict=True)) | columns)

        for part in rows:
            at = part["at_us"]
            start = at - at % self.size
            late = start + self.size <= before - self.lateness if before is not None else start != start
            if late.any():
                yield told(kind="late", start=start[late].array, at=at[late].array, n=1, closed=True)
            counts.update(start[~late].value_counts().to_dict())
            latest = max(at.max(), latest) if latest is not None else at.max()
        for start, n in counts.items():
            held = self.open.getValue((int(start),))[0] if self.open.containsKey((int(start),)) else 0
            self.open.updateValue((int(start),), (int(n) + held,))
        self.latest.update((int(latest),))
        changed, ended = [], []
        for (start,), (n,) in list(self.open.iterator()):
            closed = start + self.size <= latest - self.lateness
            if closed:
                ended.append(start)
            if closed or start in counts:
                changed.append((start, n, closed))
        for start in ended:
            self.open.removeKey((start,))
        if changed:
            yield told(kind="window", start=[c[0] for c in changed], at=None, n=[c[1] for c in changed], closed=[c[2] for c in changed])


def windows_or_late(stream: DataFrame, *key: str, seconds: int, lateness: str = "1 minute", ttl: str | None = "7 days") -> DataFrame:
    """(key, kind, start, at, n, closed): every row of the stream is in a window, or told as late.

    A window closes for a key when a row has come that is `lateness` past its end. Rows of windows that
    earlier batches closed are of kind late, one row for each with its time in `at`; rows of one batch
    are never late to one another. Of kind window is each window that a batch changed or closed, with
    its count so far: the last word on it, which has the largest n, holds, and what a stream ends with
    is told too. Rows without a time are left out.

    A key's state is its open windows and one time. It goes when no row of the key has come for `ttl`;
    all that it held was told by then. Start it within lasting_state(); a key's rows are read in batches.
    """
    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in key) + ", kind string, start long, at long, n long, closed boolean"
    rows = stream.where("ts IS NOT NULL").select(*key, F.unix_micros("ts").alias("at_us"))
    processor = _Windows(key, seconds * 1_000_000, _micros(lateness), _micros(ttl) // 1000 if ttl else None)
    told = rows.groupBy(*key).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("start", "at")})


class _Runs(StatefulProcessor):
    """The baseline of a series (count, mean, squares) and the length of its run."""

    def __init__(self, threshold: float, samples: int, baseline: int, ttl_ms: int | None):
        self.threshold, self.samples, self.baseline, self.ttl = threshold, samples, baseline, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "n long, mean double, m2 double, run int", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        n, mean, m2, run = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0)
        alarms = []
        ordered = pd.concat(list(rows)).sort_values("ts", kind="stable")
        for ts, value in zip(ordered["ts"], ordered["value"], strict=True):
            if n < self.baseline:
                n += 1
                step = value - mean
                mean += step / n
                m2 += step * (value - mean)
                continue
            sigma = max((m2 / (n - 1)) ** 0.5 if n > 1 else 0.0, 1e-6)
            run = run + 1 if abs(value - mean) / sigma >= self.threshold else 0
            if run == self.samples:
                alarms.append((key[0], ts, run))
        self.state.update((n, mean, m2, run))
        yield pd.DataFrame(alarms, columns=["series", "ts", "run"])


def anomaly_runs(stream: DataFrame, threshold: float, samples: int, baseline: int, ttl: str | None = "7 days") -> DataFrame:
    """(series, ts, run): alarms of a stream (series, ts, value), one when a series has `samples` values on
    end that lie `threshold` or more sample deviations off its baseline, the first `baseline` values. The
    state of a series is four numbers; values of a micro-batch are taken in order of time. A series of
    which nothing has come for `ttl` begins anew. Start it within
    lasting_state()."""
    processor = _Runs(threshold, samples, baseline, _micros(ttl) // 1000 if ttl else None)
    return stream.groupBy("series").transformWithStateInPandas(processor, "series string, ts timestamp, run int", "Append", "ProcessingTime")


def dangling_parents(spans: DataFrame, lateness: str = "1 minute", reach: str = "5 minutes") -> DataFrame:
    """(trace_id, parent, ts) of spans whose parent does not arrive within `reach` of them: a left outer
    join of the stream with itself, told once the watermark has passed."""
    # the condition names ts, so that it stays above the watermark: spans without a parent move it too
    children = spans.select("trace_id", "parent", "ts").withWatermark("ts", lateness).where(F.when(F.col("ts").isNotNull(), F.col("parent").isNotNull()))
    parents = spans.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("ts").alias("_at")).withWatermark("_at", lateness)
    near = F.expr(f"_t = trace_id AND _s = parent AND _at BETWEEN ts - INTERVAL {reach} AND ts + INTERVAL {reach}")
    return children.join(parents, near, "left_outer").where("_s IS NULL").select("trace_id", "parent", "ts")
