"""References of checkpoints and steps, and records of runs."""

import hashlib

import pytest

from rootgrain.operators import records, references

ENTITIES = [(0, "cluster:/c", "cluster", "c", []), (1, "node:/n", "node", "n", ["N1"]), (2, "service:/s", "service", "shop", []), (3, "pod:/p", "pod", "p", []), (4, "service:/t", "service", "till", []), (5, "pod:/q", "pod", "p2", ["twin"]), (6, "pod:/r", "pod", "", ["twin"]), (7, "db:/d", "db", "shop", [])]
EDGES = [(0, "cluster:/c", "node:/n", "contains"), (1, "node:/n", "service:/s", "hosts"), (2, "service:/s", "pod:/p", "contains"), (3, "service:/t", "pod:/q", "contains"), (4, "service:/t", "service:/s", "calls"), (5, "pod:/q", "pod:/q", "contains")]


@pytest.fixture(scope="module")
def world(spark):
    return spark.createDataFrame(ENTITIES, "entity_ord long, entity_id string, kind string, name string, aliases array<string>"), spark.createDataFrame(EDGES, "edge_ord long, src string, dst string, relation string")


def test_readings_by_tier(spark, world):
    series = [("a", "pod:/p", "m"), ("a", "service:/s", "m"), ("a", "till", "m"), ("a", "node:/n", "only"), ("a", "service:/t", "dup"), ("a", "till", "dup"), ("a", None, "far"), ("a", "pod:/q", "far"), ("a", "x", None), ("b", "x", "m")]
    asked = {
        "exact": ("pod:/p", "m"), "by name": ("TILL", "m"), "above": ("pod:/p", "only"), "twice": ("service:/t", "dup"), "near twice": ("node:/n", "m"), "elsewhere": ("pod:/p", "far"),
        "nobody": ("pod:/zz", "m"), "no metric": ("pod:/p", "zz"), "two owners": ("twin", "m"), "empty": (None, None),
    }
    cps = spark.createDataFrame([("a", k, e, m) for k, (e, m) in asked.items()] + [("c", "x", "pod:/p", "m")] + [("a", "exact", "pod:/p", "m")], "case_id string, checkpoint_id string, entity_ref string, metric string")
    got = references.resolve_readings(cps, spark.createDataFrame(series, "case_id string, service string, metric string"), *world).collect()
    assert len(got) == 12
    told = {(r.case_id, r.checkpoint_id): (r.kind, r.via, r.service, r.carriers, r.declares) for r in got}
    assert told == {
        ("a", "exact"): ("resolved", "entity", "pod:/p", None, None), ("a", "by name"): ("resolved", "entity", "till", None, None), ("a", "above"): ("resolved", "component", "node:/n", None, None),
        ("a", "twice"): ("ambiguous", None, None, ["service:/t", "till"], None), ("a", "near twice"): ("ambiguous", None, None, ["pod:/p", "service:/s"], None), ("a", "elsewhere"): ("otherComponent", None, None, ["", "pod:/q"], None),
        ("a", "nobody"): ("unknownEntity", None, None, None, None), ("a", "two owners"): ("unknownEntity", None, None, None, None), ("a", "no metric"): ("unknownMetric", None, None, None, ["dup", "far", "m", "only"]),
        ("a", "empty"): ("unknownEntity", None, None, None, None), ("c", "x"): ("unknownMetric", None, None, None, []),
    }


def test_published_references(spark, world):
    text = "case_id string, checkpoint_id string, entity_ref string, signal_ref string, signal_kind string"
    rows = [("entity", "pod:/p", "m", None), ("container", "pod:/p", "k", "series"), ("noRow", "pod:/p", "z", "series"), ("otherEntity", "pod:/q", "m", "series"), ("log", "service:/s", "l1", "log"), ("noLog", "pod:/p", "m", "log"), ("key", "x", "p1", "configuration"), ("noKey", "x", "m", "configuration"), ("none", "x", None, "derived")]
    cps = spark.createDataFrame([("a", *r) for r in rows], text)
    metrics = spark.createDataFrame([("a", "m", "pod:/p"), ("a", "k", "node:/n"), ("a", "k", "pod:/q"), ("b", "z", "pod:/p"), ("a", None, "pod:/p")], "case_id string, metric string, entity_id string")
    logs = spark.createDataFrame([("a", "l1", "pod:/p")], "case_id string, id string, entity_id string")
    got = references.join_published(cps, metrics, logs, spark.createDataFrame([("a", "p1")], "case_id string, key string"), world[1])
    assert {r.checkpoint_id: (r.kind, r.carrier, r.match, r.reason) for r in got.collect()} == {
        "entity": ("joined", "metrics", "entity", None), "container": ("joined", "metrics", "container", None), "noRow": ("dangling", "metrics", None, "noRow"), "otherEntity": ("dangling", "metrics", None, "otherEntity"), "log": ("joined", "logs", "container", None),
        "noLog": ("dangling", "logs", None, "noRow"), "key": ("joined", "parameters", "key", None), "noKey": ("dangling", "parameters", None, "noKey"), "none": ("none", None, None, None),
    }
    assert [tuple(r) for r in references.reference_tally(got).collect()] == [("a", 8, 4, 1, 2, 1, 4)]


def test_signal_refs(spark, world):
    rows = [("good", "node:/n", "m"), ("none", "node:/n", None), ("lost", "nope", "m"), ("unnamed", "pod:/r", "m"), ("empty", "node:/n", ""), ("written", "node:/n", "a|m"), ("two", "service:/s", "m"), ("two, none", "service:/s", None)]
    cps = spark.createDataFrame([("a", *r) for r in rows], "case_id string, checkpoint_id string, entity_ref string, signal_ref string")
    assert {r.checkpoint_id: (r.ref, r.fault, r.candidates) for r in references.signal_refs(cps, world[0]).collect()} == {
        "good": ("n|m", None, None), "none": (None, None, None), "lost": (None, "unresolved", None), "unnamed": (None, "unnamed", None), "empty": (None, "emptyRef", None), "written": (None, "preQualified", None),
        "two": (None, "ambiguous", ["db:/d", "service:/s"]), "two, none": (None, None, None),
    }


STEPS = "case_id string, step int, from_entity string, to_entity string, evidence_refs array<string>"


def test_layers_and_evidence(spark, world):
    steps = spark.createDataFrame([("a", 1, "pod:/p", "pod:/q", ["k2", "k1", "k2"]), ("b", 1, "pod:/p", "zz", ["k9"]), ("b", 2, "pod:/q", "pod:/p", None), ("d", 1, "N1", "shop", [])], STEPS)
    cps = spark.createDataFrame([("a", "k1", "pod:/p"), ("a", "k2", "node:/n"), ("b", "k1", "yy"), ("b", "k1", "pod:/p")], "case_id string, checkpoint_id string, entity_ref string")
    assert {(r.case_id, r.step): (r.checkpoints, r.unknown) for r in references.step_evidence(steps, cps).collect()} == {("a", 1): (["k2", "k1", "k2"], []), ("b", 1): ([], ["k9"]), ("b", 2): ([], []), ("d", 1): ([], [])}
    cases = spark.createDataFrame([("a", "pod:/p", "cpu", "resource"), ("b", None, "", "resource"), ("c", "pod:/p", "cpu", "unknown"), ("d", "pod:/p", "cpu", None)], "case_id string, root_entity_id string, fault_type string, category string")
    got = {r.case_id: tuple(r)[1:] for r in references.four_layers(cases, steps, cps, world[0]).collect()}
    assert got["a"] == (True, True, True, True, 1, 2, 0, [], [], True)
    assert got["b"] == (False, False, False, False, 2, 2, 1, ["entity:", "evidence:yy", "process:zz"], ["k1", "k1"], False)
    assert got["c"] == (True, False, False, False, 0, 0, 0, [], [], False)
    assert got["d"] == (True, False, False, False, 1, 0, 0, ["process:shop"], [], False)  # two entities are called shop


def test_calls_across_a_chain(spark, world):
    steps = spark.createDataFrame([("a", 1, "pod:/p", "pod:/q", []), ("a", 2, "service:/s", "service:/t", []), ("a", 3, "pod:/q", "pod:/p", []), ("a", 4, "pod:/p", "service:/s", []), ("a", 5, "node:/n", "pod:/q", []), ("b", 1, "pod:/r", "pod:/q", [])], STEPS)
    assert sorted(tuple(r) for r in references.calls_across(steps, *world).collect()) == [("a", "shop", "till"), ("a", "till", "shop")]
    assert {tuple(r) for r in references.owners(*world).collect()} == {("service:/s", "service:/s"), ("pod:/p", "service:/s"), ("service:/t", "service:/t"), ("pod:/q", "service:/t")}


KEY = "sample_id string, type string, category string, component string"


def test_records_of_runs(spark, monkeypatch):
    key = spark.createDataFrame([("s2", "cpu", "resource", "shop"), ("s1", "é|x", "code", "till"), ("s3", "net", "network", "db")], KEY).repartition(3)
    lines = "s1|é|x|code|till\ns2|cpu|resource|shop\ns3|net|network|db\n"
    for piece in (1, 1 << 20):
        assert tuple(records.key_digest(key, piece).first()) == (3, hashlib.sha256(lines.encode()).hexdigest())
    assert tuple(records.key_digest(key.limit(0)).first()) == (0, hashlib.sha256(b"\n").hexdigest())
    with pytest.raises(Exception, match="an expectation is missing"):
        records.key_digest(key.selectExpr("sample_id", "type", "category", "CAST(NULL AS STRING) AS component")).collect()
    answers = spark.createDataFrame([("s1", True, "é|x", None, "till"), ("s2", True, "cpu", "resource", "shop"), ("s3", True, "net", "code", "db")], "sample_id string, parsed boolean, type string, category string, component string")
    read = records.reading(key, answers)
    assert {r.sample_id: (r.told_type, r.told_category) for r in read.collect()} == {"s1": ("é|x", None), "s2": ("cpu", "resource"), "s3": ("net", "code")}
    assert tuple(records.totals(read).first()) == (3, 1, 3, 1)
    with pytest.raises(Exception, match="not a reading"):
        records.reading(key, answers.withColumn("parsed", answers.sample_id != "s3")).collect()
    with pytest.raises(Exception, match="not one sample"):
        records.reading(key, answers.where("sample_id != 's3'")).collect()
    later = spark.createDataFrame([("s1", True, "é|x", "code", "till"), ("s3", False, "net", "code", "db"), ("s4", True, None, None, "new")], answers.schema)
    got = records.differences(read, later, {"type": 3, "category": 2, "component": 3, "strict": 1}).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("field", "s1", "category", None, "code"), ("field", "s3", "type", "net", None), ("field", "s3", "category", "code", None), ("field", "s3", "component", "db", None), ("missing", "s2", None, "shop", None), ("extra", "s4", None, None, "new"), ("total", None, "category", "2", "1")], key=repr)
