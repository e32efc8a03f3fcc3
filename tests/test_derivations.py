"""Categories that follow from types and components."""

from pyspark.sql import functions as F

from rootgrain.operators import derivations as d

SAMPLES = "sample_id long, type string, category string"
ROWS = [(1, "redis-latency", "middleware"), (2, "Network delay", "network"), (3, "planet", "unknown"), (4, "feature-flag-misconfiguration", "config"),
        (5, "queue-disk", "middleware"), (6, "queue-disk", "middleware"), (7, " \t", "code"), (8, None, "code"), (9, "cpu", None), (10, "pod-kill", "")]


def test_readings_of_types(spark):
    told = {r.sample_id: (r.derived, r.by_letters, r.by_all_rows, r.conforms) for r in d.readings(spark.createDataFrame(ROWS, SAMPLES)).collect()}
    assert told == {
        1: ("middleware", "middleware", "middleware,network", True), 2: ("network", "network", "network", True), 3: ("unknown", "network", "unknown", True),
        4: ("config", "middleware", "unknown", True), 5: ("middleware", "middleware", "middleware,resource", True), 6: ("middleware", "middleware", "middleware,resource", True),
        9: ("resource", "resource", "resource", None), 10: ("runtime", "runtime", "runtime", None),
    }


def test_conformance_and_power(spark):
    samples = spark.createDataFrame([*ROWS, (11, "cpu", "code")], SAMPLES).repartition(4)
    assert tuple(d.conformance(samples).first()) == (7, 6, 6 / 7, False, 9, 8, False)
    # by letters 3, 4, 9 and 11 (one type), 10 (no label); by rows 1, 4, 5 and 6 (one type), 9, 10
    assert tuple(d.power(samples).first()) == (9, 4, 5, 6, 6 / 9, True)
    none = samples.limit(0)
    assert tuple(d.conformance(none).first()) == (0, 0, 0.0, True, 0, 0, True)
    assert tuple(d.power(none).first()) == (0, 0, 0, 0, 0.0, False)


def test_words_beyond_the_vocabulary(spark):
    words = spark.createDataFrame([("planet",), ("flag",), ("podium",), (None,), ("tree",)], "word string")
    assert tuple(d.excess(words).first()) == (4, 0, 3, 0.0, True)
    assert tuple(d.excess(words.unionByName(words.select(F.lit("redis").alias("word")))).first()) == (9, 5, 8, 5 / 9, False)


def test_runs_of_misses(spark):
    rows = [("a", 1, "redis", "middleware"), ("b", 1, "kafka", "middleware"), ("a", 2, "cpu", "resource"), ("b", 2, "cpu", "code"), ("a", 3, " ", "code"), ("b", 3, "regex", "code"), ("a", 4, "tree", "tree"), ("a", 1, "tree", "code"), ("b", 4, "tree", None)]
    misses = spark.createDataFrame(rows, "run string, sample_id long, type string, category string")
    assert sorted(map(tuple, d.runs(misses).collect())) == [("a", 4, 2, 3, False), ("b", 4, 2, 3, False)]
    assert sorted(map(tuple, d.stability(misses).collect())) == [(1, 2, 2, True, True), (2, 2, 1, True, False), (3, 1, 1, True, False), (4, 2, 0, False, False)]
    assert d.stability(misses.limit(0)).count() == 0


def test_agreement_of_component_and_category(spark):
    rows = [("session Redis cache", "middleware"), ("kubelet", "resource"), ("", "code"), (None, "code"), ("redis", "unknown"), ("redis", None), ("WAF rule", "config")]
    answers = spark.createDataFrame(rows, "component string, category string")
    told = answers.select(d.agreement(F.col("component"), F.col("category")), d.supporting_terms(F.col("component"), F.col("category"))).collect()
    assert [r[0] for r in told] == ["agrees", "disagrees", "not-assessable", "not-assessable", "disagrees", "disagrees", "disagrees"]
    assert told[0][1] == ["redis", "cache"] and all(r[1] == [] for r in told[1:])
    assert tuple(d.inventory(answers).first()) == (5, 1, 4, 2, 0.8)
    assert tuple(d.inventory(answers.limit(0)).first()) == (0, 0, 0, 0, 0.0)
    one = d.contrast(answers, answers.where("category = 'resource'")).first()
    assert (one.expected_graded, one.expected_supporting, one.predicted_graded, one.predicted_supporting, one.share_delta, one.separates) == (5, 1, 1, 0, 0.2, False)
