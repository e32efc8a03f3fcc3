from pyspark.sql import functions as F

from rootgrain.functions import units
from rootgrain.operators import graph, pools, published, samples, sli
from rootgrain.operators.published import Planned
from rootgrain.plans import structure
from rootgrain.sources import answers


def test_compare_counts_each_side(spark):
    theirs = spark.createDataFrame([(0, "1999999999", "warning", "a"), (1, "soon", "info", "b"), (2, "3000000", "odd", None)], "line long, ts string, level string, own string")
    ours = spark.createDataFrame([(0, "1999000000", "WARN", "a"), (1, "5", "INFO", "c")], "line long, ts string, level string, own string")
    plan = [Planned("ts", "truncated", unit="ns"), Planned("level", "normalised", transform="severity"), Planned("own"), Planned("gone"), Planned("hm", "derived", source="ts")]
    told = {r["column"]: (r["kind"], r["differ"], r["lossy"], r["absent"]) for r in published.compare(theirs, ours, plan).collect()}
    assert told == {
        "ts": ("truncated", 0, 1, None), "level": ("normalised", 0, 2, None), "own": ("exact", 1, 0, None), "gone": ("exact", 0, 0, "both"),
        "hm": ("derived", 2, 0, "both"), None: ("rows", 1, 1, None),
    }
    assert [(r.side, r.row) for r in published.examples(theirs, ours, plan[:3]).collect()] == [("published", "3000000 | ODD | "), ("exported", "5 | INFO | c")]


def test_compare_of_empty_tables(spark):
    none = spark.createDataFrame([], "line long, a string")
    assert {tuple(r) for r in published.compare(none, none, [Planned("a")]).collect()} == {("a", "exact", 0, 0, None), (None, "rows", 0, 0, None)}


def test_minutes_and_instants(spark):
    cells = ["-1", "86340000000000", "x", "12345678901234567890123"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(published.truncated(F.col("c"), "ns"), published.minute(F.col("c"), "ns")).collect()
    assert [tuple(r) for r in rows[:3]] == [("0", "00:00"), ("86340000000000", "23:59"), (None, None)]
    assert rows[3][0] == "12345678901234567000000"


def test_roots_of_predictions(spark):
    texts = ['{"2": {"root cause component": "b"}, "10": {"root cause component": "c", "root cause reason": 5}, "1": {"root cause component": "a"}, "x": {}}', '{"root cause component": "d", "1": 3}', "[1]", "no", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", answers.predicted_roots(F.col("t")).alias("r")).orderBy("i").collect()
    assert [[(x.component, x.reason, x.time) for x in r.r] for r in rows] == [[("a", "", ""), ("b", "", ""), ("c", "", "")], [("d", "", "")], [], [], []]


def test_points_round_trip(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a(b)", None), (" ", None, None), (None, None, "slow disk ")], "t string, c string, r string")
    text = answers.points_text(F.col("t"), F.col("c"), F.col("r"))
    told = rows.select(answers.task(F.col("t"), F.col("c"), F.col("r")).alias("task"), answers.scoring_points(text).alias("p"), answers.true_roots(answers.scoring_points(text)).alias("roots")).collect()
    assert [(r.task, r.p.components, r.p.reasons, r.p.times) for r in told] == [("task_5", ["a(b)"], [], ["2024-01-01 00:00:00"]), ("task_1", [], [], [""]), ("task_2", [], ["slow disk"], [])]
    assert [len(r.roots) for r in told] == [1, 1, 1]


def test_paths(spark):
    paths = ["RE2-shop/cart_f3_1/7", "/RE1-a//b_c/2/", "RE4-a/b_c/1", "RE1-a/_c/1", "RE1-a/b_/1", "RE1-a/b_c/x", "b_c"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", answers.case_path(F.col("p")).alias("c"), answers.loader_label(F.col("p")).alias("l")).orderBy("i").collect()
    assert [tuple(r.c) if r.c else None for r in rows] == [("RE2", "shop", "cart", "f3_1", "7"), ("RE1", "a", "b", "c", "2"), None, None, None, None, None]
    assert [r.l.fault_kind for r in rows] == ["unpack", None, None, None, None, None, "shape"]
    got = spark.range(1).select(answers.case_directory(F.lit("RE2-a-b-cpu_12")).alias("d"), answers.case_directory(F.lit("RE2-a")).alias("n")).first()
    assert tuple(got.d) == ("RE2", "a-b", "cpu", "12") and got.n is None


def test_pairs_are_one_to_one(spark):
    one, two = spark.createDataFrame([(1,), (2,)], "sample_id int"), spark.createDataFrame([(1, "a")], "sample_id int, x string")
    assert samples.pair(two.select("sample_id"), two).collect()[0].x == "a"
    try:
        samples.pair(one, two).collect()
        raise AssertionError("two tables that disagree were paired")
    except Exception as e:
        assert "not one sample and one prediction of 2" in str(e)


def test_coverage_of_an_unfinished_index(spark):
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    few = spark.createDataFrame([("1", "a"), ("2", "a")], "case_id string, sample_id string")
    assert [tuple(r) for r in samples.coverage_issues(few, known).collect()] == [("a", "duplicate", 2)]
    more = few.union(few.selectExpr("case_id", "'b'"))
    assert {tuple(r) for r in samples.coverage_issues(more, known).collect()} == {("a", "duplicate", 2), ("b", "duplicate", 2), ("c", "missing", 0)}


def test_declarations_of_latency(spark):
    texts = [None, "null", "5", '{"none": "x", "metric": "m"}', '{"none": 3}', '{"service": "a b"}', '{"service": "a", "metric": ""}', '{"service": "b", "metric": "m"}', '{"service": "a", "metric": "m"}', '{"none": null, "service": "a", "metric": "m"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", sli.declaration(F.col("t"), F.lit("a")).alias("d")).orderBy("i").collect()
    assert [r.d.fault for r in rows] == ["absent", "absent", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "foreign", None, "unreadable"]


def test_latency_column_that_is_taken(spark):
    case = spark.createDataFrame([("c", "a", '{"service": "a", "metric": "m"}')], "case_id string, component string, sli string")
    series = lambda *rows: spark.createDataFrame([("c", "a", n, u, i) for i, (n, u) in enumerate(rows)], "case_id string, service string, name string, unit string, signal_idx int")
    fault = lambda *rows: sli.resolve(case, series(*rows)).first()
    assert fault(("m", "ms"), ("latency", "ms")).fault == "collision"
    assert tuple(fault(("m", "ms"), ("m", "%")))[1:] == (None, "a_m", "a_latency")
    assert fault(("m", "%"), ("m", "ms")).fault == "notDuration"


def test_structure_of_files(spark):
    good = {
        "s/query.csv": "instruction_id,query,occurrence_window\nc1,what?,w\nc2, a ,w\n", "s/record.csv": 'instruction_id,prediction\nc1,"{""root cause component"": ""a""}"\nc2,"{""1"": {""root cause component"": ""a""}}"\n',
        "s/groundtruth.csv": 'task_index,instruction,scoring_points\ntask_3,x,"The only predicted root cause component is a"\ntask_3,x,none\n', "s/d/telemetry/log/c1.csv": "timestamp,cmdb_id\n",
    }
    told = {r.check: r.passed for r in structure.openrca(spark.createDataFrame(list(good.items()), "path string, content string")).collect()}
    assert len(told) == 14
    assert {c for c, passed in told.items() if not passed} == {"metric-header", "log-header", "scoring-points-present", "task-carries-no-scored-value"}
    none = {r.check for r in structure.openrca(spark.createDataFrame([], "path string, content string")).where("passed").collect()}
    assert none == {"answer-key-isolated", "task-carries-no-scored-value", "log-header", "trace-header", "row-alignment"}


def test_authors_of_cited_lines(spark):
    entities = spark.createDataFrame([("service:/a", "service", "a", None), ("pod:/p", "pod", "p", None), ("service:/b", "service", "b", None)], "entity_id string, kind string, name string, aliases array<string>")
    edges = spark.createDataFrame([("service:/a", "pod:/p", "contains")], "src string, dst string, relation string")
    points = spark.createDataFrame([("c", x, ref, x) for x, ref in (("1", "a"), ("2", "a"), ("3", "a"), ("4", "zz"), ("5", "a"))], "case_id string, checkpoint_id string, entity_ref string, signal_ref string")
    lines = spark.createDataFrame([("c", "1", "P"), ("c", "2", "b"), ("c", "3", None), ("c", "4", "b")], "case_id string, log_id string, service string")
    assert {(r.checkpoint_id, r.code) for r in graph.foreign_logs(points, lines, entities, edges).collect()} == {("2", "FOREIGN_AUTHOR"), ("3", "UNKNOWN_AUTHOR")}
    twice = edges.union(edges).union(spark.createDataFrame([("x", "x", "calls")], edges.schema))
    assert [tuple(r) for r in graph.distinct_edges(twice).collect()] == [("service:/a", "pod:/p", "contains")]


def test_tolerance_and_baselines(spark):
    one = spark.range(1).select(*[units.holds(c, F.lit(1.0 + 1e-12), F.lit(1.0)).alias(c) for c in (">", ">=", "==", "!=")]).first()
    assert tuple(one) == (False, True, True, False)
    at = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 5.0), ("b", None), ("b", float("inf"))], "k string, t double")
    assert {tuple(r) for r in pools.baseline_window(at, F.col("t"), F.lit(3.0), "k").collect()} == {("a", 1, 1.0, 5.0), ("b", 0, 0.0, 0.0)}
