"""Work that must not grow faster than the input: rows that the steps of a plan make."""

import json
import math
from collections import Counter

import pytest

from rootgrain.functions import text
from rootgrain.operators import chains, derived, gates, graph, lookup, references
from rootgrain.plans import structure
from rootgrain.sources import delimited, otlp, shared


def most_rows(df):
    """(result, the most rows that one step of its plan made)."""
    rows = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        n = node.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return rows, most


N = 400


@pytest.fixture(scope="module")
def crowd(spark):
    """A node that hosts N services, each of which is a case's."""
    services = spark.range(N).selectExpr("'c' || id AS case_id", "'service:/' || id AS entity_id", "id")
    edges = services.selectExpr("'node:/n' AS src", "entity_id AS dst", "'hosts' AS relation")
    return services, edges


def test_published_rows_within_an_entity_that_holds_many(spark, crowd):
    services, edges = crowd
    cps = services.selectExpr("case_id", "'k' AS checkpoint_id", "'node:/n' AS entity_ref", "if(id % 2 = 0, 'm', 'other') AS signal_ref", "'series' AS signal_kind")
    metrics = services.selectExpr("case_id", "'m' AS metric", "if(id % 4 = 0, 'service:/1', entity_id) AS entity_id").union(services.selectExpr("case_id", "'other' AS metric", "'elsewhere' AS entity_id"))
    nothing = spark.createDataFrame([], "case_id string, id string, entity_id string")
    rows, most = most_rows(references.join_published(cps, metrics, nothing, nothing.selectExpr("case_id", "id AS key"), edges))
    assert sorted((r.kind, r.match, r.reason) for r in rows) == [("dangling", None, "otherEntity")] * (N // 2) + [("joined", "container", None)] * (N // 2)
    assert most < 10 * N


def test_readings_within_an_entity_that_holds_many(spark, crowd):
    services, edges = crowd
    entities = services.selectExpr("entity_id", "CAST(NULL AS STRING) AS name", "array() AS aliases").union(spark.sql("SELECT 'node:/n', 'n', array()"))
    cps = services.selectExpr("case_id", "'k' AS checkpoint_id", "'node:/n' AS entity_ref", "'m' AS metric")
    series = services.selectExpr("case_id", "if(id % 4 = 0, 'service:/1', entity_id) AS service", "'m' AS metric")
    rows, most = most_rows(references.resolve_readings(cps, series, entities, edges))
    assert {(r.case_id, r.kind, r.via, r.service) for r in rows} == {(f"c{i}", "resolved", "component", f"service:/{i if i % 4 else 1}") for i in range(N)}
    assert most < 10 * N


def test_readings_on_a_cycle_are_told_once(spark):
    edges = spark.createDataFrame([("a", "b", "contains"), ("b", "a", "contains")], "src string, dst string, relation string")
    entities = spark.createDataFrame([("a", "A", []), ("b", "B", [])], "entity_id string, name string, aliases array<string>")
    told = references.resolve_readings(spark.createDataFrame([("c", "k", "a", "m")], "case_id string, checkpoint_id string, entity_ref string, metric string"), spark.createDataFrame([("c", "b", "m")], "case_id string, service string, metric string"), entities, edges)
    assert [(r.kind, r.via, r.service) for r in told.collect()] == [("resolved", "component", "b")]


def largest_share(df):
    """The largest partition of df, as a share of its rows."""
    sizes = [n for n in df.rdd.glom().map(len).collect() if n]
    return max(sizes) / sum(sizes)


def test_frequent_keys_stay_where_they_are(spark):
    rows = spark.range(4000, numPartitions=4).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN CAST(id AS STRING) ELSE 'hot' END AS k")
    known = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), (None, 4)], "_key string, v int")
    told = lookup.looked_up(rows, "k", lambda keys: keys.join(known, "_key", "left"))
    assert told.where("k = 'hot'").groupBy("v").count().orderBy("v").collect() == [(1, 3200), (2, 3200)]
    assert {tuple(r) for r in told.where("k IS NULL").groupBy("v").count().collect()} == {(None, 400)}
    assert {tuple(r) for r in told.where("k IS NOT NULL AND k != 'hot'").groupBy("v").count().collect()} == {(3, 1), (None, 399)}
    assert largest_share(told) < 0.3


def test_floors_of_chains_through_one_entity(spark, monkeypatch):
    """No step of the plan deals out steps by their entity."""
    seen, entities = [], spark.createDataFrame([("a", "service"), ("b", "node")], "entity_id string, kind string")
    held = lookup.looked_up
    monkeypatch.setattr(lookup, "looked_up", lambda *a: seen.append(held(*a)) or seen[-1])
    cases = spark.range(2000, numPartitions=4).selectExpr("CAST(id AS STRING) AS case_id", "'a' AS root_entity_id")
    steps = cases.selectExpr("case_id", "1 AS step", "'a' AS from_entity", "if(case_id % 2 = 0, 'b', 'nobody') AS to_entity")
    told = chains.difficulty_floor(cases, steps, entities).groupBy("depth", "breadth", "floor").count().collect()
    assert sorted(tuple(r) for r in told) == [(1, 1, "L1", 1000), (1, 2, "L2", 1000)]
    assert largest_share(seen[0]) < 0.3


def test_references_to_one_entity_stay_where_they_are(spark):
    entities = spark.createDataFrame([("a:/1", "One", ["uno"]), ("a:/2", "two", [])], "entity_id string, name string, aliases array<string>")
    refs = spark.range(4000, numPartitions=4).selectExpr("id", "CASE WHEN id < 3000 THEN if(id % 2 = 0, 'a:/1', 'UNO') WHEN id < 3990 THEN 'nobody' WHEN id < 3995 THEN NULL ELSE 'a:/2' END AS ref")
    told = graph.resolve(refs, entities)
    assert {tuple(r) for r in told.groupBy("entity_id").count().collect()} == {("a:/1", 3000), ("a:/2", 5), (None, 995)}
    assert largest_share(told) < 0.3


def test_overlapping_windows_meet_once(spark):
    """Pairs are found once, not by stretch and then made distinct: nothing is dealt out after the join."""
    at = "date_format(timestamp_seconds(1700000000 + {}), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    lo, hi = "id % 7 * 500", "id % 7 * 500 + 1000 + id % 5 * 900"
    rows = spark.range(60).selectExpr("'s' || id % 2 AS system", "id AS case_id", f"{at.format(lo)} AS window_start", f"{at.format(hi)} AS window_end", f"{lo} AS lo", f"{hi} AS hi")
    w = [(r.system, r.case_id, r.lo, r.hi) for r in rows.collect()]
    want = {(c, c2): (min(b, b2) - max(a, a2)) / (max(b, b2) - min(a, a2)) for s, c, a, b in w for s2, c2, a2, b2 in w if s == s2 and c < c2 and min(b, b2) > max(a, a2)}
    told = gates.overlapping_windows(rows.union(rows.where("case_id = 3")), 0.4)
    got = told.collect()
    assert {(r.a, r.b): round(r.iou, 9) for r in got} == {k: round(v, 9) for k, v in want.items() if v >= 0.4}
    assert len(got) == sum(v >= 0.4 for v in want.values())
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_grams_of_a_text_are_no_rows(spark):
    """N-grams of keys of one row are counted within the row; rows of one key, null included, still count as one."""
    body = "concat('Abcde', repeat(concat(id % 7, 'xY\U0001d53b'), 200))"
    rows = spark.range(50).selectExpr("id AS conv_id", "1 AS turn", f"{body} AS text", f"substr({body}, 1, CASE WHEN id % 2 = 0 THEN 400 ELSE 2 END) AS answer")
    several = spark.createDataFrame([(None, None, "aaab", "zz"), (None, None, "baaa", "AAAB"), (7, 1, "abcd", "abce"), (60, None, "a", "b"), (61, 1, "abc", None)], "conv_id long, turn int, text string, answer string")

    def cosine(pairs):
        x, y = (Counter(t[i : i + 3] for p in pairs for t in [(p[k] or "").lower()] for i in range(len(t) - 2)) for k in (0, 1))
        size = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return round(sum(v * y[g] for g, v in x.items()) / size, 6) if size else 0.0

    every = rows.union(several)
    groups = {}
    for r in every.collect():
        groups.setdefault((r.conv_id, r.turn), []).append((r.text, r.answer))
    del groups[60, None]  # no 3-gram at all
    told, most = most_rows(text.gram_cosines(every, ["conv_id", "turn"], "text", "answer", 3, "cosine"))
    assert {(r.conv_id, r.turn): r.cosine for r in told} == {k: cosine(v) for k, v in groups.items()}
    assert len(told) == len(groups)
    assert most < 4000  # the texts have 40,000


def test_rows_go_on_while_a_file_is_read(spark):
    """Neither the rows of a file nor those of many files are held together, and batches of kept tables are small."""
    told = delimited._rows("a,b\n" * 5 + '"', delimited._pieces(","))
    assert next(told) == (1, ["a", "b"], None)
    assert [r[0] for r in told] == [2, 3, 4, 5, 6]
    rows = (("p", i, ["x" * (1000 if i < 5000 else 1)], None) for i in range(40_000))
    sizes = [(len(b), sum(len(r[2][0]) + 1 for r in b)) for b in delimited._batches(rows)]
    assert sum(n for n, _ in sizes) == 40_000
    assert max(n for n, _ in sizes) == delimited.ROWS
    assert max(c for _, c in sizes) < delimited.CHARACTERS + 1002
    files = spark.createDataFrame([("p", "k,v\n1,2\n\n3,\"4\n5\"\n"), ("q", None), (None, "z")], "path string, content string")
    got = shared.kept(delimited.rows(files), "cells").collect()
    assert sorted(((r.path or "", r.line, r.cells, r.error) for r in got), key=lambda r: r[:2]) == [("", 1, ["z"], None), ("p", 1, ["k", "v"], None), ("p", 2, ["1", "2"], None), ("p", 4, ["3", "4\n5"], None)]
    with shared.small_batches(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)


def test_spans_are_judged_in_one_reading(spark):
    """Good and refused spans come from one parse of their document."""
    span = lambda i, end: {"traceId": "t", "spanId": str(i), "name": "n", "startTimeUnixNano": "2000000", "endTimeUnixNano": end}
    text = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span(1, "5999999"), span(2, "1"), span(3, "x")]}]}]})
    told = otlp.judged_traces(spark.createDataFrame([("p", text)], "path string, content string"), service="s")
    rows = {json.loads(r.record)["spanId"] if r.record else r.signal.span_id: (r.reason, r.signal and (r.signal.service, r.signal.ts_ms, r.signal.duration_ms)) for r in told.collect()}
    assert rows == {"1": (None, ("s", 2, 3)), "2": ("span has a negative duration", None), "3": ("span has an invalid start/end timestamp", None)}
    assert told.groupBy("reason").count()._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_exported_files_are_put_together_once(spark):
    """However often they are looked at; of telemetry only the header goes on."""
    made = spark.sparkContext.accumulator(0)

    def build(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    head = "timestamp,cmdb_id,kpi_name,value"
    texts = [("s/query.csv", "instruction_id,query,occurrence_window\nc,q,w\n"), ("s/record.csv", "instruction_id,prediction\nc,{}\n"), ("s/d/telemetry/metric/c.csv", head + "\nroot cause reason\n"), ("s/else.txt", "x")]
    files = spark.createDataFrame(texts, "path string, content string").mapInArrow(build, "path string, content string")
    told = dict(structure.openrca(files).collect())
    assert {k for k, v in told.items() if not v} == {"groundtruth-csv", "groundtruth-header", "scoring-points-present", "row-alignment"}
    assert made.value == len(texts)


def test_derived_readings_are_dealt_out_once_and_not_interpreted(spark):
    """Series that are dealt out by case stay there, and no expression is a tree of higher-order functions."""
    series = spark.range(150).selectExpr("'c' || id % 50 AS case_id", "'e' || id % 3 AS entity", "'m' || id % 2 AS metric", "if(id % 2 = 0, 's', 'ms') AS unit", "1.0D AS baseline", "CAST(id % 50 AS DOUBLE) AS post")
    told = derived.evaluate(series.repartition("case_id"), {"sum": "m0@e0.post + 2 * m0@e0.post", "other": "m1@e1.post / m1@e1.baseline"})
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "lambda" not in plan
    rows = {(r.case_id, r.name): (r.value, r.unit, r.problem and r.problem.kind) for r in told.collect()}
    assert len(rows) == 100 and rows["c3", "other"] == (3.0, "1", None) and rows["c3", "sum"] == (None, None, "unknownSeries")
    assert rows["c4", "other"][2] == "unknownSeries" and rows["c4", "sum"] == (12.0, "s", None)
