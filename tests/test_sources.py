import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rootgrain.sources import backends, delimited, otlp, signals


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "path string, content string")


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("a,b\n1,2\n", [(1, ["a", "b"], None), (2, ["1", "2"], None)]),
        ('a,"b ""c"""\r\nx', [(1, ["a", 'b "c"'], None), (2, ["x"], None)]),
        ('ab"c,d"e,f', [(1, ["abc,de", "f"], None)]),
        ('"a\nb",c\rd,e', [(1, ["a\nb", "c"], None), (3, ["d", "e"], None)]),
        (" , \n\nq", [(3, ["q"], None)]),
        ('x,y\n1,"open\n2,3', [(1, ["x", "y"], None), (2, None, "unterminated quoted field")]),
        ("a,", [(1, ["a", ""], None)]),
        (None, []),
        ("", []),
    ],
)
def test_dialect(spark, content, want):
    got = delimited.rows(files(spark, content)).orderBy("line").collect()
    assert [(r.line, r.cells, r.error) for r in got] == want


def test_records_pad_and_last_column_of_a_name_counts(spark):
    got = delimited.records(delimited.rows(files(spark, "a\tb\ta\n1\t2\t3\n4", ""), "\t")).orderBy("line").collect()
    assert [r.record for r in got] == [{"a": "3", "b": "2"}, {"a": "", "b": ""}]


def test_json_documents(spark):
    lines = delimited.json_lines(files(spark, '{"a": 1}\n\n[1]\n{bad\r\n{"b": "x"}')).orderBy("line").collect()
    assert [(r.line, r.record, r.error) for r in lines] == [(1, {"a": "1"}, None), (3, None, "not a JSON object"), (4, None, "malformed JSON"), (5, {"b": "x"}, None)]
    array = delimited.json_array(files(spark, '[{"a": 1}, 2]', "{}", None)).orderBy("path", "line").collect()
    assert [(r.path, r.line, r.error) for r in array] == [("f0", 1, None), ("f0", 2, "not a JSON object"), ("f1", 1, "not a JSON array"), ("f2", 1, "not a JSON array")]


def test_layout_takes_the_first_header():
    assert signals.detect_layout(["Span-ID", "TS", "time", "svc.", "Duration"], "trace") == {"timestamp": "TS", "service": "svc.", "span_id": "Span-ID", "duration_ms": "Duration"}
    assert signals.detect_layout([], "log") == {}


def records(spark, *rows):
    return spark.createDataFrame([("f", i, r, None) for i, r in enumerate(rows)], "path string, line int, record map<string,string>, error string")


def test_every_record_ends_in_one_place(spark):
    layout = {"timestamp": "t", "service": "s", "metric_name": "n", "metric_value": "v"}
    good = {"t": "2024-01-01T00:00:00Z", "s": "a", "n": "cpu", "v": " 1.5 "}
    rows = records(spark, good, good | {"v": "NaN"}, good | {"v": "x"}, good | {"t": ""}, good | {"t": "soon", "s": ""}, good | {"s": " "}, good | {"n": None}, good | {"v": "1e999"}, good | {"v": "1d"})
    told = {r.line: (r.outcome, r.reason) for r in signals.classify(rows, "metric", layout).collect()}
    assert told[0] == ("signal", None) and told[1] == ("missing", None)
    assert told[3] == ("quarantine", "missing required column 't' (timestamp)") and told[4][1] == "timestamp cannot be read" and told[5][1] == "missing service name"
    assert all(told[i][0] == "quarantine" for i in (2, 6, 7, 8))
    parts = signals.ingest(rows, "metric", layout)
    assert sum(p.count() for p in parts) == rows.count()


def test_logs_and_spans(spark):
    layout = {"timestamp": "t", "log_body": "m", "severity": "l"}
    rows = records(spark, {"t": "0", "m": " ", "l": "warning"}, {"t": "1", "m": "x", "l": "loud"}, {"t": "1"})
    told = signals.classify(rows, "log", layout, time_layout="unix_s", service="a", aliases={"a": "b"}).orderBy("line").collect()
    assert (told[0].signal.body, told[0].signal.severity, told[0].signal.service) == ("", "WARN", "b")
    assert told[1].reason == "invalid severity 'loud'" and told[2].reason == "missing required column 'm' (log body)"
    layout = {"timestamp": "t", "trace_id": "a", "span_id": "b", "span_name": "c", "duration_ms": "d", "status": "e"}
    span = {"t": "1", "a": "1", "b": "2", "c": "x", "d": "4330", "e": "ok"}
    told = signals.classify(records(spark, span, span | {"d": "-1"}, span | {"e": "maybe"}), "trace", layout, time_layout="unix_ms", service="a", duration_unit="us").orderBy("line").collect()
    assert told[0].signal.duration_ms == 4.33 and told[0].signal.status == "OK"
    assert "non-negative" in told[1].reason and told[2].reason == "invalid span status 'maybe'"


def test_paths(spark):
    paths = spark.createDataFrame([(p,) for p in ("x/traces/a.csv", "logs/metrics.csv", "y/trace-log.csv", "metric.csv", "z/q.csv")], "path string")
    assert [r.k for r in paths.select(signals.kind_of_path(F.col("path")).alias("k")).collect()] == ["trace", "log", "trace", "metric", None]
    cases = spark.createDataFrame([(1, "a", "x/"), (2, "b", "x/tr"), (3, "rest", None)], "case_ord int, case_id string, prefix string")
    assert {r.path: r.case_id for r in signals.route(paths, cases).collect()}["x/traces/a.csv"] == "a"
    assert {r.case_id for r in signals.route(paths, cases.where("prefix IS NOT NULL")).collect()} == {"a", None}


def test_otlp(spark):
    attribute = {"key": "service.name", "value": {"stringValue": "shop"}}
    resource = {"attributes": [attribute]}
    points = [{"timeUnixNano": "1700000000123456789", "asDouble": 1.5, "attributes": [{"key": "a", "value": {"intValue": "1"}}, {"key": "a", "value": {"boolValue": True}}, {"key": "", "value": {"stringValue": "x"}}]}, {"timeUnixNano": "x", "asInt": "3"}, {"timeUnixNano": "0", "asInt": "9007199254740993"}]
    metrics = {"resourceMetrics": [{"resource": resource, "scopeMetrics": [{"metrics": [{"name": "m", "unit": "ms", "gauge": {"dataPoints": points}}, {"name": "h", "histogram": {}}, {"name": "n"}, {"sum": {"dataPoints": points}}]}]}]}
    good, bad = otlp.metrics(files(spark, json.dumps(metrics), "not json", None))
    assert [(r.service, r.name, r.ts_ms, r.value, r.attributes) for r in good.collect()] == [("shop", "m", 1700000000123, 1.5, {"a": "true"})]
    assert sorted(r.reason for r in bad.collect()) == sorted(["unsupported metric type", "metric has no recognised type", "metric is missing a name", "data point has an invalid timestamp", "data point has no numeric value"])
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1999999", "endTimeUnixNano": "2000000", "status": {"code": 2}}
    traces = {"resourceSpans": [{"scopeSpans": [{"spans": [span, span | {"endTimeUnixNano": "1999998"}, span | {"spanId": ""}, span | {"status": {"code": "7"}}]}]}]}
    good, bad = otlp.traces(files(spark, json.dumps(traces)), service="x")
    assert [(r.duration_ms, r.status) for r in good.collect()] == [(1, "ERROR")]
    assert sorted(r.reason for r in bad.collect()) == ["invalid span status code '7'", "span has a negative duration", "span has no span id"]
    assert otlp.traces(files(spark, json.dumps(traces)))[0].count() == 0
    record = {"timeUnixNano": "5000000", "severityText": "critical", "body": {"stringValue": "b"}}
    logs = {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [record, record | {"severityText": "odd"}]}]}]}
    good, bad = otlp.logs(files(spark, json.dumps(logs)))
    assert [(r.ts_ms, r.severity, r.body) for r in good.collect()] == [(5, "FATAL", "b")] and bad.count() == 1


def answers(spark, *bodies):
    return spark.createDataFrame([("u", json.dumps(b)) for b in bodies], "url string, body string")


def test_server_answers(spark):
    good, bad = backends.prometheus(answers(spark, {"data": {"result": [{"metric": {"__name__": "cpu", "service": "a"}, "values": [[1.5, "2"], [2, "NaN"], [3]]}, {"metric": {"service": "a"}, "values": []}]}}))
    assert [(r.service, r.name, r.ts_ms, r.value) for r in good.collect()] == [("a", "cpu", 1500, 2.0)] and bad.count() == 3
    span = {"traceID": "t", "spanID": "s", "operationName": "o", "processID": "p1", "references": [{"refType": "FOLLOWS_FROM", "spanID": "x"}, {"refType": "CHILD_OF", "spanID": "y"}], "startTime": 1500, "duration": 250, "tags": [{"key": "error", "value": True}]}
    good, bad = backends.jaeger(answers(spark, {"data": [{"processes": {"p1": {"serviceName": "a"}}, "spans": [span, span | {"processID": "p2"}, span | {"duration": -1}]}, {"x": 1}]}))
    assert [(r.service, r.parent, r.ts_ms, r.duration_ms, r.status) for r in good.collect()] == [("a", "y", 1, 0.25, "ERROR")] and bad.count() == 3
    good, bad = backends.loki(answers(spark, {"data": {"result": [{"stream": {"service": "a", "level": "warn", "pod": "p"}, "values": [["1999999", "hello"], ["x", "y"], ["1", "a", {}]]}]}}))
    assert [(r.ts_ms, r.severity, r.body, r.resource) for r in good.collect()] == [(1, "WARN", "hello", {"pod": "p"})] and bad.count() == 2
    hits = {"timed_out": False, "_shards": {"failed": 1}, "hits": {"total": {"value": 3, "relation": "gte"}, "hits": [{"_source": {"@timestamp": "2024-01-01T00:00:00Z", "svc": "a", "msg": "m"}}, {"_source": {"svc": "a"}}, {}]}}
    good, bad = backends.elasticsearch(answers(spark, hits), "@timestamp", "svc", "msg")
    assert [(r.service, r.ts_ms, r.body) for r in good.collect()] == [("a", 1704067200000, "m")] and bad.count() == 2
    assert tuple(backends.elasticsearch_state(answers(spark, hits)).first())[1:] == (3, "gte", False, 1)
    good, bad = backends.clickhouse(answers(spark, {"data": [{"t": "17", "s": "a", "m": "x"}, {"t": "17", "m": "x"}]}), "t", "s", "m", backends.clickhouse_time("Nullable(UInt64)"))
    assert [(r.ts_ms, r.body) for r in good.collect()] == [(17, "x")] and bad.count() == 1
    with pytest.raises(ValueError):
        backends.clickhouse_time("Date")
    event = {"metadata": {"namespace": "n"}, "involvedObject": {"kind": "Pod", "name": "p"}, "reason": "Killed", "message": "m", "type": "Warning", "count": 2, "lastTimestamp": "2024-01-01T00:00:01Z"}
    good, bad = backends.kubernetes(answers(spark, {"items": [event, event | {"type": "Odd"}, event | {"lastTimestamp": "2025-01-01T00:00:00Z"}]}), end_ms=1704067300000)
    assert [(r.object, r["count"]) for r in good.collect()] == [("p", 2)] and bad.count() == 1


def test_pages_are_fetched_by_slice(spark):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"ok": 1}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(backends.HttpPages)
    read = spark.read.format("http_pages").options(url=f"http://127.0.0.1:{server.server_port}/q?x=1", startMs="0", endMs="5000", sliceMs="2000").load()
    assert sorted(r.slice_ms for r in read.collect()) == [0, 2000, 4000]
    server.shutdown()
    assert any("start=4.0&end=5.0" in p for p in seen)
