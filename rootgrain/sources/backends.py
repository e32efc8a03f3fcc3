"""Answers of telemetry servers as signals, and a data source that fetches them.

`HttpPages` reads one answer per time slice, each slice a partition, so that slices are fetched by
many tasks and a lost one is fetched again. The functions below turn answers (url, body) into
(signals, quarantine) in one plan each; they run on stored answers as well as on fetched ones.
"""

import json
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text, times


class Slice(InputPartition):
    def __init__(self, start_ms: int, end_ms: int):
        self.start_ms, self.end_ms = start_ms, end_ms


class HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Slice]:
        start, end, step = (int(self.options[k]) for k in ("startMs", "endMs", "sliceMs"))
        return [Slice(a, min(a + step, end)) for a in range(start, end, step)]

    def read(self, partition: Slice):
        scale = {"s": 1000, "ms": 1}.get(self.options.get("timeUnit", "s"), 1)
        bounds = {"start": partition.start_ms / scale, "end": partition.end_ms / scale} if scale > 1 else {"start": partition.start_ms, "end": partition.end_ms}
        if self.options.get("timeUnit") in ("us", "ns"):
            factor = 1000 if self.options["timeUnit"] == "us" else 1_000_000
            bounds = {"start": partition.start_ms * factor, "end": partition.end_ms * factor}
        headers = json.loads(self.options.get("headers", "{}"))
        if template := self.options.get("body"):  # a statement or query with {start} and {end}
            url = self.options["url"]
            request = urllib.request.Request(url, template.replace("{start}", f"{bounds['start']:g}" if scale > 1 else str(bounds["start"])).replace("{end}", f"{bounds['end']:g}" if scale > 1 else str(bounds["end"])).encode(), headers, method="POST")
        else:
            url = self.options["url"] + ("&" if "?" in self.options["url"] else "?") + urllib.parse.urlencode(bounds)
            request = urllib.request.Request(url, headers=headers)
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeoutS", "60"))) as answer:
            yield partition.start_ms, url, answer.status, answer.read().decode()


class HttpPages(DataSource):
    """spark.dataSource.register(HttpPages); spark.read.format("http_pages").option("url", …)

    Options: url, startMs, endMs, sliceMs (whole milliseconds, the end not included), timeUnit of the
    `start` and `end` parameters (s, ms, us or ns), headers (JSON), body (then POST), timeoutS. An HTTP
    error fails the task: no slice is left out silently.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "slice_ms long, url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


def _parts(rows: DataFrame, why: Column, raw: Column, /, **fields: Column) -> tuple[DataFrame, DataFrame]:
    told = rows.withColumn("_reason", why)
    return told.where("_reason IS NULL").select(*[c.alias(k) for k, c in fields.items()]), told.where("_reason IS NOT NULL").select(F.col("_reason").alias("reason"), raw.alias("record"))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _finite(c: Column) -> Column:
    value = F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))
    return F.when(~value.isin(float("inf"), float("-inf")), value)


def prometheus(answers: DataFrame, service_label: str = "service") -> tuple[DataFrame, DataFrame]:
    """Range queries: a sample of each series, whose labels name the metric and the service."""
    kind = "status string, data struct<resultType:string,result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"
    series = answers.select(F.explode(F.from_json("body", kind)["data"]["result"]).alias("s"))
    whole = F.when(F.col("s.metric").isNull() | F.col("s.values").isNull(), "series has no labels or no values").when(_blank(F.col("s.metric")["__name__"]), "series has no name").when(_blank(F.col("s.metric")[service_label]), f"series has no label {service_label}")
    _, refused = _parts(series, whole, F.to_json("s"))
    samples = series.where(whole.isNull()).select(F.col("s.metric").alias("labels"), F.explode("s.values").alias("v"))
    at, value = _finite(F.col("v")[0]), _finite(F.col("v")[1])
    bad = F.when(F.size("v") != 2, "sample is not a pair").when(at.isNull(), "sample has no numeric timestamp").when(value.isNull(), "sample value is not a finite number")
    signals, single = _parts(samples, bad, F.to_json("v"), service=F.col("labels")[service_label], name=F.col("labels")["__name__"], ts_ms=F.floor(at * 1000 + 1e-6).cast("bigint"), value=value)
    return signals, refused.unionByName(single)


def jaeger(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces: the service is the span's own or that of its process; the parent is the first CHILD_OF;
    the tags `error` and `otel.status_code` tell the status. Microseconds become milliseconds."""
    tag = "array<struct<key:string,value:string>>"
    span = f"struct<traceID:string,spanID:string,operationName:string,processID:string,process:struct<serviceName:string>,references:array<struct<refType:string,spanID:string>>,startTime:string,duration:string,tags:{tag}>"
    kind = f"data array<struct<processes:map<string,struct<serviceName:string>>,spans:array<{span}>>>"
    traces = answers.select(F.explode(F.from_json("body", kind)["data"]).alias("t"))
    _, refused = _parts(traces, F.when(F.col("t.spans").isNull(), "trace has no spans"), F.to_json("t"))
    spans = traces.select(F.col("t.processes").alias("p"), F.explode("t.spans").alias("s"))
    service = F.coalesce(F.nullif(F.col("s.process.serviceName"), F.lit("")), F.col("p")[F.col("s.processID")]["serviceName"])
    start, duration = _finite(F.col("s.startTime")), _finite(F.col("s.duration"))
    bad = F.when(F.col("s").isNull(), "span is not an object")
    for field in ("traceID", "spanID", "operationName"):
        bad = bad.when(_blank(F.col(f"s.{field}")), f"span has no {field}")
    bad = bad.when(_blank(service), "span names no service").when(start.isNull(), "span start is no number").when(~F.coalesce(duration >= 0, F.lit(False)), "span duration is no non-negative number")
    tags = lambda key: F.lower(F.try_element_at(F.filter("s.tags", lambda x: x["key"] == key), F.lit(1))["value"])
    status = F.when((tags("error") == "true") | (tags("otel.status_code") == "error"), "ERROR").when(tags("otel.status_code") == "ok", "OK")
    parent = F.try_element_at(F.filter("s.references", lambda r: r["refType"] == "CHILD_OF"), F.lit(1))["spanID"]
    signals, single = _parts(spans, bad, F.to_json("s"), trace_id=F.col("s.traceID"), span_id=F.col("s.spanID"), parent=parent, name=F.col("s.operationName"), service=service, ts_ms=F.floor(start / 1000).cast("bigint"), duration_ms=duration / 1000, status=status)
    return signals, refused.unionByName(single)


def loki(answers: DataFrame, service_label: str = "service") -> tuple[DataFrame, DataFrame]:
    """Log ranges: entries of exactly a time in nanoseconds and a line; other labels stay with the signal."""
    kind = "data struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>"
    streams = answers.select(F.explode(F.from_json("body", kind)["data"]["result"]).alias("s"))
    whole = F.when(F.col("s.stream").isNull() | F.col("s.values").isNull(), "stream has no labels or no values").when(_blank(F.col("s.stream")[service_label]), f"stream has no label {service_label}")
    _, refused = _parts(streams, whole, F.to_json("s"))
    entries = streams.where(whole.isNull()).select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v"))
    nanos = F.when(F.col("v")[0].rlike(r"^\d{1,19}$"), F.col("v")[0].try_cast("decimal(20,0)"))
    bad = F.when(F.size("v") != 2, "entry is not a pair").when(nanos.isNull(), "entry time is not in nanoseconds").when(F.col("v")[1].isNull(), "entry line is no text")
    level = text.severity(F.coalesce(F.col("labels")["level"], F.lit("")))
    signals, single = _parts(entries, bad, F.to_json("v"), service=F.col("labels")[service_label], ts_ms=F.floor(nanos / 1_000_000).cast("bigint"), severity=level, body=F.col("v")[1], resource=F.map_filter("labels", lambda k, _: ~k.isin(service_label, "level")))
    return signals, refused.unionByName(single)


def elasticsearch(answers: DataFrame, time_field: str, service_field: str, message_field: str, layout: str = "iso8601") -> tuple[DataFrame, DataFrame]:
    """Search hits: fields of the source by name, the time by one of the engine's layouts."""
    hits = answers.select(F.explode(F.from_json("body", "hits struct<hits:array<struct<_source:map<string,string>>>>")["hits"]["hits"]["_source"]).alias("h"))
    at = times.parse(F.col("h")[time_field], layout, None)["ms"]
    bad = F.when(F.col("h").isNull(), "hit has no source").when(_blank(F.col("h")[service_field]), f"hit has no {service_field}").when(at.isNull(), f"{time_field} cannot be read").when(F.col("h")[message_field].isNull(), f"hit has no {message_field}")
    return _parts(hits, bad, F.to_json("h"), service=F.col("h")[service_field], ts_ms=at, body=F.col("h")[message_field])


def elasticsearch_state(answers: DataFrame) -> DataFrame:
    """(url, total, relation, timed_out, failed_shards): whether an answer is whole."""
    kind = "timed_out boolean, _shards struct<failed:int>, hits struct<total:struct<value:bigint,relation:string>>"
    r = F.from_json("body", kind)
    return answers.select("url", r["hits"]["total"]["value"].alias("total"), r["hits"]["total"]["relation"].alias("relation"), r["timed_out"].alias("timed_out"), r["_shards"]["failed"].alias("failed_shards"))


def clickhouse_time(type_name: str, unit: str = "ms") -> str:
    """The layout by which a column of that type is read; types that lose the instant are refused."""
    inner = type_name
    while inner.startswith(("Nullable(", "LowCardinality(")):
        inner = inner[inner.index("(") + 1 : -1]
    if inner.startswith("DateTime"):
        return "iso8601"
    if inner.startswith(("Int", "UInt")):
        return f"unix_{unit}"
    if inner == "Float64" and unit == "s":
        return "unix_s"
    raise ValueError(f"a column of type {type_name} does not hold an instant")


def clickhouse(answers: DataFrame, time_column: str, service_column: str, message_column: str, layout: str, assume_offset_minutes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON answer; layout as clickhouse_time() tells from the column's type."""
    rows = answers.select(F.explode(F.from_json("body", "data array<map<string,string>>")["data"]).alias("r"))
    at = times.parse(F.col("r")[time_column], layout, assume_offset_minutes)["ms"]
    bad = F.when(F.col("r").isNull(), "row is not an object").when(_blank(F.col("r")[service_column]), f"row has no {service_column}").when(F.col("r")[message_column].isNull(), f"row has no {message_column}").when(at.isNull(), f"{time_column} cannot be read")
    return _parts(rows, bad, F.to_json("r"), service=F.col("r")[service_column], ts_ms=at, body=F.col("r")[message_column])


def kubernetes(answers: DataFrame, time_field: str = "lastTimestamp", start_ms: int | None = None, end_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events: object, reason, message, type and count. Events outside the window are left out of both."""
    item = f"struct<metadata:struct<namespace:string>,involvedObject:struct<kind:string,name:string>,reason:string,message:string,type:string,count:string,{time_field}:string>"
    events = answers.select(F.explode(F.from_json("body", f"items array<{item}>")["items"]).alias("e"))
    at = times.parse(F.col(f"e.{time_field}"), "rfc3339", None)["ms"]
    if start_ms is not None or end_ms is not None:
        events = events.where(at.isNull() | ((at >= (start_ms if start_ms is not None else -(2**62))) & (at <= (end_ms if end_ms is not None else 2**62))))
    count = F.col("e.count")
    bad = (
        F.when(F.col("e").isNull(), "item is not an object").when(_blank(F.col("e.involvedObject.kind")) | _blank(F.col("e.involvedObject.name")), "event names no object").when(_blank(F.col("e.reason")), "event has no reason")
        .when(at.isNull(), f"{time_field} cannot be read").when(F.col("e.type").isNotNull() & ~F.col("e.type").isin("Normal", "Warning"), "event type is neither Normal nor Warning").when(count.isNotNull() & ~count.rlike(r"^\d+$"), "event count is no whole number")
    )
    return _parts(events, bad, F.to_json("e"), ts_ms=at, kind=F.col("e.involvedObject.kind"), object=F.col("e.involvedObject.name"), namespace=F.col("e.metadata.namespace"), reason=F.col("e.reason"), body=F.coalesce("e.message", F.lit("")), type=F.col("e.type"), count=count.cast("bigint"))


#: Readers by the name of the server.
BACKENDS = {"prometheus": prometheus, "jaeger": jaeger, "loki": loki, "elasticsearch": elasticsearch, "clickhouse": clickhouse, "kubernetes": kubernetes}
