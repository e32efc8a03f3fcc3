import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rootgrain.functions import text, times, units
from rootgrain.operators import compare, gates, grading, graph, misses, rules, scoring
from rootgrain.operators.rules import Rule
from rootgrain.plans import exports


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("value", "layout", "offset", "want"),
    [
        ("2024-02-30T00:00:00Z", "iso8601", None, 1709251200000),
        ("2024-13-01 00:00:00", "iso8601", 0, 1735689600000),
        ("2024-01-01T00:00:00.123456+08:00", "rfc3339", None, 1704038400123),
        ("2024-01-01 00:00:00", "iso8601", None, None),
        ("2024-01-01 00:00:00,5", "java_log", 480, 1704038400500),
        ("-1", "unix_ns", None, 0),
        ("1700000000", "unix_s", None, 1700000000000),
        ("1e3", "unix_ms", None, None),
        ("soon", "iso8601", 0, None),
    ],
)
def test_times(spark, value, layout, offset, want):
    assert one(spark, times.parse(F.lit(value), layout, offset)["ms"]) == want


@pytest.mark.parametrize(("value", "want"), [(95.0, "95"), (0.1 + 0.2, "0.30000000000000004"), (1e-7, "1e-7"), (1e21, "1e+21"), (1234567.5, "1234567.5"), (-0.5, "-0.5"), (1e-6, "0.000001"), (12345678901234567890.0, "12345678901234567000")])
def test_number_text(spark, value, want):
    assert one(spark, text.number(F.lit(value))) == want


def test_units(spark):
    assert one(spark, units.convert(F.lit(90.0), "s", "min")) == 1.5
    with pytest.raises(ValueError):
        units.convert(F.lit(1.0), "s", "By")
    assert one(spark, units.clamp(F.lit(140.0), F.lit("%"))) == 100 and one(spark, units.quantize(F.lit(2.5), F.lit("count"))) == 3


@pytest.mark.parametrize(("slug", "want"), [("pod-kill", "runtime"), ("net-work", "network"), ("misconfigured", "config"), ("third-party-timeouts", "dependency"), ("cpus", "unknown"), ("caches", "middleware"), ("odd", "unknown")])
def test_category(spark, slug, want):
    assert one(spark, text.category(F.lit(slug))) == want


def test_rules_quarantine_the_first_failure_and_lose_nothing(spark):
    rows = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", "5", "F"), (2, "", "5", "F"), (3, "2024-01-01T00:00:00Z", "x", "Q"), (4, "2024-01-01T00:00:00Z", "2", "Q"), (5, None, None, None)], "id int, t string, v string, s string")
    listed = [Rule("t", "time", "at", source="t"), Rule("u", "unit", "sec", source="v", source_unit="ms", target_unit="s"), Rule("m", "map", "s", source="s", values={"F": "fine"}), Rule("e", "expr", "twice", expression="sec * 2 - -1")]
    good, bad = rules.transform(rows, listed)
    assert [(r.id, r.at, r.s, round(r.twice, 6)) for r in good.collect()] == [(1, "2024-01-01T00:00:00.000Z", "fine", 1.01)]
    assert {r.id: (r.failure.rule, r.failure.code, r.s) for r in bad.collect()} == {2: ("t", "MISSING_INPUT", "F"), 3: ("u", "BAD_NUMBER", "Q"), 4: ("m", "UNMAPPED_VALUE", "Q"), 5: ("t", "MISSING_INPUT", None)}
    with pytest.raises(rules.ExpressionError):
        rules.classify(rows, [Rule("e", "expr", "x", expression="(1 + ")])


def test_division_by_zero_fails(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    told = [r.failure and r.failure.code for r in rules.classify(rows, [Rule("e", "expr", "c", expression="a / b")]).collect()]
    assert told == ["EXPR_FAILED", None, "EXPR_FAILED"]


def entities(spark):
    return spark.createDataFrame([(1, "service:/a", "service", "A", ["x"]), (2, "service:/b", "service", "B", ["X", "y"]), (3, "pod:/p", "pod", "p", None), (4, "node:/n", "node", "n", [])], "entity_ord int, entity_id string, kind string, name string, aliases array<string>")


def edges(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_ord int, src string, dst string, relation string")


def test_references_and_aliases(spark):
    refs = spark.createDataFrame([(r,) for r in ("service:/a", "a", "x", "Y", "zz", None)], "ref string")
    assert {r.ref: r.entity_id for r in graph.resolve(refs, entities(spark)).collect()} == {"service:/a": "service:/a", "a": "service:/a", "x": None, "Y": "service:/b", "zz": None, None: None}
    assert [tuple(r) for r in graph.ambiguous_aliases(entities(spark)).collect()] == [("x", ["service:/a", "service:/b"])]


def test_closure_ends_on_a_cycle(spark):
    e = edges(spark, ("a", "b", "contains"), ("b", "c", "hosts"), ("c", "a", "contains"), ("c", "d", "calls"))
    got = {tuple(r) for r in graph.closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abc"}


def test_merged_aliases(spark):
    e = edges(spark, ("service:/b", "service:/a", "same_as"), ("node:/n", "service:/b", "hosts"), ("service:/a", "service:/b", "calls"))
    merged, moved = graph.merge_aliases(entities(spark), e)
    assert {r.entity_id: (r.aliases, r.members) for r in merged.collect()}["service:/a"] == (["B", "X", "x", "y"], 2)
    assert [(r.src, r.dst) for r in moved.collect()] == [("node:/n", "service:/a")]


def test_edge_issues(spark):
    e = edges(spark, ("node:/n", "pod:/p", "contains"), ("pod:/p", "service:/a", "calls"), ("service:/a", "gone", "calls"), ("service:/a", "service:/a", "calls"), ("service:/a", "service:/b", "likes"))
    assert sorted(map(tuple, graph.edge_issues(entities(spark), e).collect())) == [(1, "IMPLAUSIBLE_EDGE_DIRECTION", "from"), (2, "DANGLING_EDGE_REF", "to"), (3, "SELF_EDGE", ""), (4, "INVALID_RELATION", "")]


def bundle(spark):
    fields = "case_ord int, case_id string, system string, inject_time string, window_start string, window_end string, fault_type string, category string, root_entity_id string, component string, reason string, query string, difficulty string"
    case = ("shop", "2024-01-01T00:10:00.000Z", "2024-01-01T00:00:00.000Z", "2024-01-01T00:20:00.000Z", "cpu-stress", "resource", "service:/a", "A", "cpu", "what broke here", "L3")
    cases = spark.createDataFrame([(1, "c1", *case), (2, "c2", *case)], fields)
    start = 1704067200000
    rows = [("c1", i, "metric", start + i * 60_000, "A", None, None, "cpu", 1.0 + (i % 2) * 0.1 if i < 10 else 50.0, None, None, None, None, None, None, None) for i in range(20)]
    rows += [("c1", 20, "log", start + 1000, "A", "p", None, None, None, "WARN", 'said "hi", twice', None, None, None, None, None), ("c1", 21, "trace", start + 2000, "A", None, "n", "op", None, None, None, "t", "s", None, 4.33, "OK")]
    signals = spark.createDataFrame(rows, "case_id string, signal_idx int, signal string, ts_ms long, service string, pod string, node string, name string, value double, severity string, body string, trace_id string, span_id string, parent string, duration_ms double, status string")
    return cases, signals.withColumn("unit", F.lit("1"))


def codes(violations):
    return {(r.case_id, r.code) for r in violations.collect()}


def test_gates_find_what_is_broken(spark):
    cases, signals = bundle(spark)
    assert codes(gates.structural(cases, signals, ("metric", "log"))) == {("c2", "MISSING_SIGNAL")}
    broken = cases.withColumns({"inject_time": F.lit("2024-01-01 00:10"), "window_end": F.col("window_start"), "root_entity_id": F.lit(" "), "query": F.lit("")})
    assert {c for _, c in codes(gates.structural(broken, signals, (), query_required=True))} == {"BAD_INJECT_TIME", "BAD_WINDOW", "EMPTY_ROOT_CAUSE", "MISSING_QUERY"}
    assert codes(gates.semantic(cases, signals, entities(spark))) == set()
    late = cases.withColumns({"inject_time": F.lit("2024-01-01T09:00:00.000Z"), "root_entity_id": F.lit("service:/zz")})
    back = signals.withColumn("ts_ms", F.when(F.col("signal_idx") == 5, 0).otherwise(F.col("ts_ms")))
    assert {c for _, c in codes(gates.semantic(late, back, entities(spark)))} == {"UNRESOLVED_ROOT_CAUSE", "INJECT_TIME_OUT_OF_WINDOW", "NON_MONOTONIC_TIMESTAMP"}
    assert codes(gates.validity(cases, signals)) == {("c2", "WEAK_ANOMALY_SIGNAL")}
    again = codes(gates.anti_pollution(cases, signals, spark.createDataFrame([], "fp string")))
    assert again == {("c2", "NEAR_DUPLICATE_QUERY"), ("c2", "OVERLAPPING_WINDOW"), ("c2", "DUPLICATE_CASE")}
    leaky = signals.withColumn("body", F.when(F.col("signal") == "log", "mail bob@example.com"))
    public = cases.select(gates.fingerprint("system", "fault_type", "inject_time", "root_entity_id", "window_start", "window_end").alias("fp")).limit(1)
    assert {("c1", "SENSITIVE_DATA_PRESENT"), ("c1", "PUBLIC_SET_CONTAMINATION")} <= codes(gates.anti_pollution(cases, leaky, public))
    told = gates.status(cases, gates.structural(cases, signals, ("log",)).unionByName(gates.validity(cases, signals)))
    assert {r.case_id: r.status for r in told.collect()} == {"c1": "admitted", "c2": "rejected"}


def test_exports(spark):
    cases, signals = bundle(spark)
    out = {r.path: r.content for r in exports.openrca_telemetry(cases, signals).collect()}
    log = out["shop/2024_01_01/telemetry/log/c1.csv"]
    assert log == 'timestamp,cmdb_id,severity,message\n2024-01-01 08:00:01,p,WARN,"said ""hi"", twice"\n'
    assert out["shop/2024_01_01/telemetry/trace/c1.csv"].split("\n")[1] == "2024-01-01 08:00:02,t,s,,n,op,4.33,OK"
    answers = {r.path: r.content for r in exports.openrca_answers(cases, signals).collect()}
    assert set(answers) == {"shop/query.csv", "shop/record.csv", "shop/groundtruth.csv"}
    assert answers["shop/record.csv"].startswith('instruction_id,prediction\nc1,"{""1"":{""root cause occurrence datetime"":""2024-01-01 08:10:00""') and answers["shop/record.csv"].count("\n") == 2
    assert answers["shop/query.csv"].split("\n")[1].endswith(",2024-01-01 08:00:00 to 2024-01-01 08:30:00")
    assert answers["shop/groundtruth.csv"].startswith('task_index,instruction,scoring_points\ntask_7,')
    re2 = {r.path: r.content for r in exports.rcaeval(cases, signals, "RE2").collect()}
    assert set(re2) == {f"RE2-shop/a_cpu-stress/1/{f}" for f in ("data.csv", "inject_time.txt", "logs.csv", "traces.csv")}
    assert re2["RE2-shop/a_cpu-stress/1/data.csv"].startswith("time,A_cpu\n1704067200,1\n") and re2["RE2-shop/a_cpu-stress/1/inject_time.txt"] == "1704067800\n"
    assert re2["RE2-shop/a_cpu-stress/1/traces.csv"].split("\n")[1] == "00:00,t,s,A,op,op,1704067202000,1704067202000000,4330,OK,"
    assert exports.rcaeval(cases, signals, "RE3").count() == 0
    kinds = {r.path for r in exports.modalities(cases, signals, entities(spark)).collect()}
    assert kinds == {"c1/metric.jsonl", "c1/log.jsonl", "c1/trace.jsonl"}
    assert exports.modalities(cases, signals.withColumn("service", F.when(F.col("signal_idx") != 3, F.col("service"))), entities(spark)).count() == 0
    steps = spark.createDataFrame([("c1", 1, "service:/a", "pod:/p", "calls", ["e1"])], "case_id string, step int, from_entity string, to_entity string, mechanism string, evidence array<string>")
    path = exports.causal_paths(cases, signals, steps, entities(spark)).first()
    assert path.path == "cases/c1/causal_path.json" and '"from":"A","to":"p"' in path.content
    assert exports.topology(entities(spark), edges(spark, ("node:/n", "gone", "hosts"))).first().content.count("external") == 1
    for target in ("aiops2025", "cloud-opsbench", "itbench", "rca100"):
        assert exports.answer_keys(cases, target).first().content.count("\n") == 2
    with pytest.raises(ValueError):
        exports.answer_keys(cases, "other")


def test_best_assignment(spark):
    matrices = [[], [[2.0]], [[1.0, 3.0], [2.0, 3.0]], [[1.0, 2.0, 3.0], [3.0, 1.0, 0.0], [2.0, 3.0, 1.0]]]
    df = spark.createDataFrame([(m,) for m in matrices], "m array<array<double>>")
    assert [r[0] for r in df.select(grading.best_assignment(F.col("m"))).collect()] == [0.0, 2.0, 5.0, 9.0]


def test_assigned_scores(spark):
    root = "array<struct<component:string,reason:string,time:string>>"
    right = [("a", "x", "2024-01-01 00:00:30"), ("b", "y", "2024-01-01 01:00:00")]
    rows = [(right[::-1], right), (right[:1], right), (right, [("a", "x", None), ("b", None, None)]), ([], []), ([("a", "q", "2024-01-01T00:01:30")], [right[0]])]
    df = spark.createDataFrame(rows, f"p {root}, t {root}")
    got = [r.score for r in grading.assigned_scores(df, "p", "t", scoring.time_matches).collect()]
    assert got == pytest.approx([1.0, 0.0, 2 / 3, 0.0, 2 / 3])


def test_best_assignment_of_any_size(spark):
    r = random.Random(3)
    small = [[[float(r.randint(0, 3)) for _ in range(n)] for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 6)]
    want = [max(sum(m[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(m)))) for m in small]
    n = 40
    large = [[5.0 if (7 * i + 3) % n == j else float((i * j) % 4) for j in range(n)] for i in range(n)]
    df = spark.createDataFrame([(m,) for m in [*small, large]], "m array<array<double>>").coalesce(1)
    assert [x[0] for x in df.select(grading.best_assignment(F.col("m"))).collect()] == [*want, 5.0 * n]


def test_assigned_roots_of_whole_orders(spark):
    from rootgrain.plans import documents

    folder = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").collect()
    sides = {}
    for x in lines:
        sides.setdefault(x.l_orderkey, ([], []))[1 - x.l_linenumber % 2].append((x.l_returnflag, x.l_linestatus))
    want = {}
    for k, (p, t) in sides.items():
        even = len(p) == len(t) and t
        want[k] = max(sum((a[0] == b[0]) + (a[1] == b[1]) for a, b in zip(q, t, strict=True)) for q in itertools.permutations(p)) / (2 * len(t)) if even else 0.0
    assert {x.l_orderkey: x.score for x in documents.assigned_roots(spark, folder).collect()} == pytest.approx(want)


def test_long_chains_are_followed_to_their_end(spark):
    chain = [f"n{i}->n{i + 1}" for i in range(1000)]
    rows = spark.createDataFrame([("a", chain, "n0", ["n1000"]), ("b", chain, "n1", ["n0"]), ("c", ["x->y", "y->x"], "x", ["x"]), ("d", [], "x", ["x"])], "c string, e array<string>, r string, t array<string>")
    assert {x[0]: x[1] for x in rows.select("c", grading.reaches("e", "r", "t")).collect()} == {"a": True, "b": False, "c": True, "d": False}
    order = list(range(1000))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(2000, 2001), (2002, 2002)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*order, 2000, 2001, 2002, 2003]], "node long")
    assert {x.node: x.label for x in graph.connected(edges, nodes).collect()} == dict.fromkeys(order, 0) | {2000: 2000, 2001: 2000, 2002: 2002, 2003: 2003}


def test_chain_scores(spark):
    rows = [("1", "a", "f", ["a->b", "b->c"], "a", "f", ["a->b", "b->c"]), ("2", "a", "f", ["a->x", "x->c"], "a", "g", ["a->b", "b->c"]), ("3", "z", "f", ["a->b"], "a", "f", ["a->b"]), ("4", "a", None, [], "a", None, [])]
    got = {r.case_id: tuple(r)[1:] for r in grading.chain_scores(spark.createDataFrame(rows, "case_id string, component string, fault string, chain array<string>, true_component string, true_fault string, true_chain array<string>")).collect()}
    assert got["1"] == (1, 1, 1.0, 1.0, 1) and got["3"] == (0, 0, 1.0, 1.0, 0) and got["4"] == (0, 1, None, None, None)
    assert got["2"][:2] == (0, 1) and math.isclose(got["2"][2], 4 / 6) and got["2"][3:] == (0.0, 1)


def test_facet_grid_lowers_scored_facets_only(spark):
    truths = spark.createDataFrame([("a", "b", "c")], "component string, fault string, note string")
    score = lambda p, t: grading.conjunction({k: (p[k], t[k]) for k in ("component", "fault")})
    assert {r.mutated: r.score for r in grading.facet_grid(truths, ["component", "fault", "note"], score).collect()} == {None: 1.0, "component": 0.5, "fault": 0.5, "note": 1.0}


def test_text_readings(spark):
    read = lambda t: one(spark, misses.denial(F.lit(t), "network"))
    assert [read(t) for t in ("The network was not slow, cpu was.", "Network loss. No disk issue.", "cpu only", " ")] == ["denied-only", "also-asserted", "absent", "not-assessable"]
    judge = lambda a, b: tuple(one(spark, misses.adjudicate(F.lit(a), F.lit(b))))
    assert judge("replica-lag", "replication-apply") == ("same-fault-different-altitude", "replica")
    assert judge("pod-kill", "kubelet-eviction") == ("different-fault", None) and judge("the error", "x")[0] == "undecided"
    assert judge("network-loss", "network-delay") == ("same-fault-different-altitude", "network")
    assert tuple(one(spark, misses.counter_evidence(F.lit("All was Steady"), ("unchanged", "steady")))) == ("counter-evidence-present", "steady")


def test_multisets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "x int"), spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert sorted(map(tuple, compare.multiset_difference(a, b, "x").collect())) == [(1, 2, 1), (2, 0, 1)]
