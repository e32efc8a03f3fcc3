"""Whole datasets by a descriptor."""

import pytest

from rootgrain.sources import descriptor

CASES = "case_ord int, case_id string, component string, fault_type string, fault_category string, inject_time string, window_start string, window_end string, prefixes array<string>"
SPECS = "case_id string, path string, " + ", ".join(f"{c} {t}" for c, t in descriptor.OPTIONS.items())
ENTITIES, EDGES = "entity_id string, kind string, name string, aliases array<string>", "src string, dst string, relation string"
AT = "2024-01-16T00:10:00Z"

FILES = {
    "a/metrics.csv": '﻿timestamp,service,metric,value\r\n2024-01-16T00:00:00Z,cart,cpu,1\r\n2024-01-16T00:00:01Z,cart,cpu,NaN\r\n2024-01-16T00:00:02Z,cart,cpu,x\r\n2024-01-16T00:00:03Z,,cpu,1\r\n',
    "a/logs/x.jsonl": '{"ts": "1705363200000", "msg": "hi", "level": "warning"}\n\nnot json\n',
    "a/spans.tsv": "time\ttrace_id\tspan_id\tname\toperation\tduration\tservice\n2024-01-16T00:00:00Z\tt\ts\tx\top\t5\ttill\n",
    "a/notes.bin": "x", "a/other.csv": "a,b\n1,2\n", "a/metric/empty.csv": "", "a/logs/short.csv": "time,level\n1,INFO\n",
    "b/metrics.csv": "1705363200;cpu;7\n1705363201;cpu;8\n", "zz/logs.json": '[{"time": "2024-01-16T00:00:00Z", "message": "m", "svc": "web"}, 5]', "zz/trace.csv": "time,trace_id\n",
}


@pytest.fixture(scope="module")
def out(spark):
    cases = [(1, "A", "cart", "CPU Stress", None, AT, None, None, ["a/"]), (2, "A2", "nobody", "f1", "code", AT, "s", "e", ["a/m", "none/"]), (3, "B", "front", "odd thing", None, AT, None, None, ["b/"]), (4, "R", "web", "x", None, AT, None, None, None), (5, "R2", "web", "net", None, AT, None, None, [])]
    spec = dict.fromkeys(descriptor.OPTIONS)
    own = [
        ("A", "a/logs/x.jsonl", spec | {"time_layout": "unix_ms", "service_name": "cart-x", "service_aliases": {"cart-x": "cart"}}),
        ("B", "b/metrics.csv", spec | {"layout": {"timestamp": "col_0", "metric_name": "col_1", "metric_value": "col_2"}, "time_layout": "unix_s", "delimiter": ";", "has_header": False, "service_name": "front"}),
        ("A2", "a/metrics.csv", spec | {"format": "json"}),
    ]
    specs = spark.createDataFrame([(c, p, *o.values()) for c, p, o in own], SPECS)
    entities = spark.createDataFrame([("node:/n", "node", "n", None), ("service:shop/front", "service", "front", ["f"])], ENTITIES)
    edges = spark.createDataFrame([("node:/n", "service:shop/cart", "hosts"), ("node:/n", "service:shop/cart", "hosts"), ("node:/n", "node:/n", "hosts"), ("node:/n", "gone", "hosts"), (" ", "node:/n", "hosts")], EDGES)
    return descriptor.ingest(spark.createDataFrame(list(FILES.items()), "path string, content string"), spark.createDataFrame(cases, CASES), specs, "rcaeval", "shop", entities, edges, lag_ms=60_000)


def test_signals(out):
    assert [tuple(r) for r in out.signals["metric"].select("case_id", "path", "service", "name", "value").orderBy("case_id", "value").collect()] == [("A", "a/metrics.csv", "cart", "cpu", 1.0), ("B", "b/metrics.csv", "front", "cpu", 7.0), ("B", "b/metrics.csv", "front", "cpu", 8.0)]
    assert [tuple(r) for r in out.signals["log"].select("case_id", "service", "body", "severity", "ts_ms").orderBy("case_id").collect()] == [("A", "cart", "hi", "WARN", 1705363200000), ("R", "web", "m", None, 1705363200000)]
    assert [tuple(r) for r in out.signals["trace"].select("service", "trace_id", "span_name", "duration_ms").collect()] == [("till", "t", "op", 5.0)]


def test_quarantine_and_report(out):
    got = {(r.path, r.line): r.reason for r in out.quarantine.collect()}
    assert got == {
        ("a/metrics.csv", 4): "metric value 'x' is not a finite number", ("a/metrics.csv", 5): "missing service name", ("a/logs/x.jsonl", 3): "malformed JSON", ("a/notes.bin", 0): "cannot determine the file format of 'a/notes.bin'",
        ("a/other.csv", 0): "cannot determine the signal kind of 'a/other.csv'; pass an explicit file spec", ("a/metric/empty.csv", 0): "'a/metric/empty.csv' has no readable header to infer columns from",
        ("a/logs/short.csv", 0): "'a/logs/short.csv' is missing required column(s): log_body", ("zz/logs.json", 2): "not a JSON object", ("zz/trace.csv", 0): "'zz/trace.csv' is missing required column(s): span_id, span_name, duration_ms",
    }
    assert {r.case_id: tuple(r)[1:] for r in out.report.collect()} == {"A": (3, 7, 1, 7), "A2": (0, 0, 0, 0), "B": (2, 0, 0, 1), "R": (1, 2, 0, 2), "R2": (0, 0, 0, 0)}
    assert {(r.case_id, r.code) for r in out.hard_errors.collect()} == {("A2", "noFiles"), ("R2", "noFiles")} and out.unclaimed.count() == 0


def test_cases_and_graph(out):
    got = {r.case_id: r for r in out.cases.collect()}
    assert (got["A"].fault_type, got["A"].category, got["A"].window_start, got["A"].window_end) == ("cpu-stress", "resource", "2024-01-16T00:00:00.000Z", "2024-01-16T00:11:00.000Z")
    assert (got["A2"].category, got["A2"].window_start, got["A2"].root_entity_id) == ("code", "s", None)
    assert got["A"].root_entity_id == "service:shop/cart" and got["B"].root_entity_id == "service:shop/front" and got["B"].category == "unknown"
    assert {r.entity_id for r in out.entities.collect()} == {"node:/n", "service:shop/front", "service:shop/cart", "service:shop/till", "service:shop/web"}
    assert sorted(tuple(r) for r in out.edges.collect()) == [(" ", "node:/n", "hosts"), ("node:/n", "gone", "hosts"), ("node:/n", "service:shop/cart", "hosts")]
    assert {(r.code, r.case_id, r.told) for r in out.problems.collect()} == {("unvouchedRoot", "A2", "nobody"), ("danglingEdge", None, "gone"), ("emptyEdge", None, " ")}


def test_a_descriptor_with_faults(spark):
    cases = [(1, "A", " ", "", None, "2024-01-16 00:00", None, None, None), (2, "A", "web", "cpu", "odd", AT, None, None, ["x/"]), (3, "", "web", "cpu", None, None, None, None, ["y/"])]
    entities = spark.createDataFrame([("", "service", "web", []), ("e", "service", None, [""]), ("service:/web", "service", "Web", None)], ENTITIES)
    edges = spark.createDataFrame([("e", "e", "near")], EDGES)
    got = descriptor.problems("odd", " ", spark.createDataFrame(cases, CASES), entities, edges)
    assert sorted((r.code, r.case_id or "") for r in got.collect()) == [("badCategory", "A"), ("badInstant", ""), ("badInstant", "A"), ("blankAlias", ""), ("blankCase", ""), ("blankEntity", ""), ("blankName", ""), ("blankSystem", ""), ("duplicateCase", "A"), ("noComponent", "A"), ("noFaultType", "A"), ("unknownDataset", ""), ("unknownRelation", "")]
    none = descriptor.ingest(spark.createDataFrame([], "path string, content string"), spark.createDataFrame(cases[1:2], CASES), spark.createDataFrame([], SPECS), "itbench", "s", entities.where("entity_id != ''"), edges.limit(0))
    assert {(r.code, r.told) for r in none.problems.collect()} >= {("noFiles", "")} and none.report.collect()[0].files == 0
