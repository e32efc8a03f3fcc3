import datetime as dt
import time

from rootgrain.operators.rules import Rule
from rootgrain.streaming import telemetry

START = dt.datetime(2024, 1, 1)


def stream(spark, folder, *batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def collected(spark, df, folder):
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out").collect()


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_rules_lose_nothing(spark, tmp_path):
    rows = stream(spark, tmp_path / "in", [("1",), ("x",)], [("2",), (None,)], schema="v string")
    telemetry.apply_rules(rows, [Rule("u", "unit", "s", source="v", source_unit="ms", target_unit="s")], f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2 and spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_closed_windows_are_counted(spark, tmp_path):
    rows = stream(spark, tmp_path / "in", [("a", "k", at(0)), ("a", "k", at(14)), ("a", "k", at(15))], [("a", "k", at(3600))], [("b", "k", at(7200))], schema="service string, cluster string, ts timestamp")
    got = collected(spark, telemetry.log_counts(rows, "service", seconds=15), tmp_path)
    assert sorted((r.service, r.n) for r in got)[:2] == [("a", 1), ("a", 2)] or sorted((r.service, r.n) for r in got)[:3] == [("a", 1), ("a", 1), ("a", 2)]


def test_runs_of_anomalies_go_over_batches(spark, tmp_path):
    first = [("s", at(i), 1.0 + 0.1 * (i % 2)) for i in range(6)] + [("s", at(6), 9.0)]
    rows = stream(spark, tmp_path / "in", first, [("s", at(7), 9.0), ("s", at(8), 9.0), ("s", at(9), 9.0)], schema="series string, ts timestamp, value double")
    with telemetry.lasting_state(spark):
        got = collected(spark, telemetry.anomaly_runs(rows, threshold=3.0, samples=3, baseline=6), tmp_path)
    assert [(r.series, r.ts, r.run) for r in got] == [("s", at(8), 3)]


def test_dangling_parents(spark, tmp_path):
    schema = "trace_id string, span_id string, parent string, ts timestamp"
    rows = stream(spark, tmp_path / "in", [("t", "1", None, at(0)), ("t", "2", "1", at(1)), ("t", "3", "gone", at(2))], [("u", "9", None, at(4000))], [("u", "10", None, at(8000))], schema=schema)
    got = collected(spark, telemetry.dangling_parents(rows), tmp_path)
    assert [(r.trace_id, r.parent) for r in got] == [("t", "gone")]


def test_every_row_is_in_a_window_or_late(spark, tmp_path):
    schema = "service string, ts timestamp"
    batches = [[("a", at(0)), ("a", at(5)), ("a", at(100)), ("b", at(3))], [("a", at(7)), ("a", at(95)), ("a", at(31)), ("b", at(0)), ("b", None)], [("a", at(300)), ("a", at(99)), ("c", at(1))], [("a", at(100)), ("a", at(299))]]
    rows = stream(spark, tmp_path / "in", *batches, schema=schema)
    with telemetry.lasting_state(spark):
        got = collected(spark, telemetry.windows_or_late(rows, "service", seconds=10, lateness="60 seconds"), tmp_path)
    late = sorted((r.service, r.at) for r in got if r.kind == "late")
    assert late == [("a", at(7)), ("a", at(31)), ("a", at(100))] or late == [("a", at(7)), ("a", at(100))]
    last = {}
    for r in got:
        if r.kind == "window":
            last[r.service, r.start] = max(last.get((r.service, r.start), 0), r.n)
    assert sum(last.values()) + len(late) == sum(ts is not None for b in batches for _, ts in b)
    assert last["a", at(0)] == 2 and last["b", at(0)] == 2 and last["c", at(0)] == 1
    closed = {(r.service, r.start) for r in got if r.kind == "window" and r.closed}
    assert ("a", at(0)) in closed and ("a", at(290)) not in closed and ("b", at(0)) not in closed


def test_state_has_a_lifetime(spark, tmp_path):
    folder, schema = tmp_path / "in", "service string, ts timestamp"
    for n, rows in enumerate(([("a", at(100))], [("a", at(0))])):
        if n:
            time.sleep(1.5)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{n}")
        with telemetry.lasting_state(spark):
            got = collected(spark, telemetry.windows_or_late(spark.readStream.schema(schema).parquet(f"{folder}/*"), "service", seconds=10, lateness="1 second", ttl="1 second"), tmp_path)
    assert sorted((r.kind, r.start, r.n) for r in got) == [("window", at(0), 1), ("window", at(100), 1)]
