"""Arithmetic over readings with units."""

import pytest

from rootgrain.functions import quantities as q
from rootgrain.operators import derived

SERIES = "case_id string, entity string, metric string, unit string, baseline double, post double"
ROWS = [
    ("c", "shop", "proc_s", "s", 0.02, 0.06), ("c", "shop", "client_ms", "ms", 12.0, 900.0), ("c", "shop", "handler_ms", "ms", 11.0, 11.0), ("c", "shop", "slow_s", "s", None, 0.9),
    ("c", "node-1", "members", "count", 6.0, 3.0), ("c", "node-4", "members", "count", 6.0, 4.0), ("c", "shop", "twice", "s", 1.0, 1.0), ("c", "shop", "twice", "s", 2.0, 2.0),
    ("c", "shop", "rate", "1/s", 1.0, 20.0), ("c", "shop", "flow", "MiB/s", 1.0, 4.0), ("c", "shop", "odd_flow", "KiB/s", 1.0, 4.0), ("c", "shop", "area", "m^2", 1.0, 6.0), ("c", "shop", "len", "m", 1.0, 3.0), ("c", "shop", "path", "m*s/s", 1.0, 7.0),
    ("c", "shop", "pct", "%", 1.0, 50.0), ("c", "shop", "share", "1", 0.0, 0.2), ("c", "shop", "x", "x", 0.0, 2.0), ("c", "shop", "mins", "min", 0.0, 1.0), ("c", "shop", "secs", "s", 0.0, 30.0), ("c", "shop", "s_per", "s/MiB", 0.0, 2.0),
    ("c", "shop", "bad", "per request", 0.0, 2.0), ("c", "shop", "bad2", "ms^0", 0.0, 2.0), ("c", "shop", "bad3", "*ms", 0.0, 2.0), ("c", "shop", "bad4", None, 0.0, 2.0), ("c", "shop", "huge", "s", 1e300, 1e300), (None, "shop", "proc_s", "s", 5.0, 5.0), ("d", None, None, None, None, None),
]

VALUES = {
    "2 + 3 * 4": (14, "1"), "(2 + 3) * 4": (20, "1"), "10 - 3 - 4": (3, "1"), "8 / 4 / 2": (1, "1"), "20 / 4 - 2": (3, "1"), "1e3 + 1": (1001, "1"), "1.5e-2 * 100": (1.5, "1"), "-2 * 3": (-6, "1"), "-(2 + 3)": (-5, "1"), "--3": (3, "1"), "  2  *  ( 3 + 4 )  ": (14, "1"),
    "proc_s.post": (0.06, "s"), "proc_s.post / proc_s.baseline": (3, "1"), "client_ms.post - handler_ms.post": (889, "ms"), "client_ms.post - slow_s.post": (0, "ms"), "members@node-1.post + members@node-4.post": (7, "count"),
    "flow.post * secs.post": (120, "MiB"), "rate.post": (20, "1/s"), "1 / rate.post": (0.05, "s"), "area.post / len.post": (2, "m"), "len.post * len.post": (9, "m^2"), "path.post": (7, "m"), "mins.post + secs.post": (1.5, "min"), "pct.post + share.post": (70, "%"),
    "len.post * proc_s.baseline * secs.post / area.post": (0.3, "s^2/m"), "s_per.post": (2, "s/MiB"), "-client_ms.post": (-900, "ms"), "rate.post / secs.post": (20 / 30, "1/s^2"),
}

PROBLEMS = {
    "2 +": ("syntax", 3), "3 4": ("syntax", 2), "(2": ("syntax", 2), "": ("syntax", 0), "proc_s@.post": ("syntax", 7), "proc_s": ("syntax", 6), "2 * )": ("syntax", 4), "proc_s.after": ("unknownPoint", 7), "(" * 33 + "1" + ")" * 33: ("tooDeep", 32),
    "nothing.post": ("unknownSeries", None), "members.post": ("ambiguousSeries", None), "twice@shop.post": ("ambiguousSeries", None), "members@node-9.post": ("unknownEntity", None), "slow_s.baseline": ("missingPoint", None),
    "bad.post": ("unsupportedUnit", None), "bad2.post": ("unsupportedUnit", None), "bad3.post": ("unsupportedUnit", None), "bad4.post": ("unsupportedUnit", None), "client_ms.post - members@node-1.post": ("unitMismatch", None), "flow.post + odd_flow.post": ("unitMismatch", None),
    "client_ms.post + x.post": ("unitMismatch", None), "1 / (2 - 2)": ("divisionByZero", 2), "huge.post * huge.post": ("notFinite", None), "nothing.post + bad.post": ("unknownSeries", None), "bad.post + nothing.post": ("unsupportedUnit", None),
}


@pytest.fixture(scope="module")
def told(spark):
    texts = [*VALUES, *PROBLEMS]
    rows = derived.evaluate(spark.createDataFrame(ROWS, SERIES), {t: t for t in texts}).collect()
    assert {r.case_id for r in rows} == {"c", "d"} and len(rows) == 2 * len(texts)
    return {(r.case_id, r.name): r for r in rows}


@pytest.mark.parametrize("text", VALUES)
def test_values(told, text):
    r = told["c", text]
    assert r.problem is None and r.unit == VALUES[text][1] and r.value == pytest.approx(VALUES[text][0], rel=1e-12)


@pytest.mark.parametrize("text", PROBLEMS)
def test_problems(told, text):
    r = told["c", text]
    assert (r.problem.kind, r.problem.at) == PROBLEMS[text] and r.value is None and r.unit is None and r.references is None


def test_details(told):
    refs = told["c", "client_ms.post - handler_ms.post"].references
    assert [tuple(x) for x in refs] == [("shop", "client_ms", "post"), ("shop", "handler_ms", "post")]
    assert [tuple(x) for x in told["c", "len.post * len.post"].references] == [("shop", "len", "post")]
    assert told["c", "2 + 3 * 4"].references == []
    assert told["c", "members.post"].problem.carriers == ["node-1", "node-4"]
    assert told["c", "twice@shop.post"].problem.carriers == ["shop", "shop"]
    assert told["c", "members@node-9.post"].problem.entity == "node-9"
    p = told["c", "client_ms.post - members@node-1.post"].problem
    assert (p.operator, p.left, p.right, p.left_dimension, p.right_dimension) == ("-", "ms", "count", "time", "count")
    p = told["c", "client_ms.post + x.post"].problem
    assert (p.left, p.right, p.left_dimension, p.right_dimension) == ("ms", "x", None, None)
    p = told["c", "flow.post + odd_flow.post"].problem
    assert (p.left, p.right) == ("MiB/s", "KiB/s")


def test_a_case_without_series(told):
    assert told["d", "proc_s.post"].problem.kind == "unknownSeries" and told["d", "2 + 3 * 4"].value == 14


def test_given_cases_empty_tables_and_claims(spark):
    none = spark.createDataFrame([], SERIES)
    assert derived.evaluate(none, {"a": "1"}).count() == 0
    cases = spark.createDataFrame([("a",), ("a",), (None,)], "case_id string")
    rows = derived.hold(derived.evaluate(none, {"one": "1 + 1", "odd": "1 +", "free": "3"}, cases), {"one": (">=", 2, "1"), "odd": ("==", 1, "1")}).collect()
    assert {(r.case_id, r.name, r.holds) for r in rows} == {("a", "one", True), ("a", "odd", None), ("a", "free", None)}
    assert derived.evaluate(none, {}).count() == 0


def test_expressions_as_rows(spark):
    texts = spark.createDataFrame([("c", "a", "proc_s.post * 2"), ("c", "b", None), ("z", "a", "1 + 1"), ("z", "b", "proc_s.post"), (None, "a", "1")], "case_id string, name string, expression string")
    rows = {(r.case_id, r.name): (r.value, r.problem and r.problem.kind) for r in derived.evaluate(spark.createDataFrame(ROWS, SERIES), texts).collect()}
    assert rows == {("c", "a"): (0.12, None), ("c", "b"): (None, "syntax"), ("z", "a"): (2.0, None), ("z", "b"): (None, "unknownSeries")}


def test_long_texts(spark):
    row = derived.evaluate(spark.createDataFrame(ROWS, SERIES), {"sum": "+".join(["proc_s.post"] * 2000)}).where("case_id = 'c'").first()
    assert row.value == pytest.approx(120) and row.unit == "s" and len(row.references) == 1


def test_steps():
    steps, readings = q.compiled("-a.post * (2 - b@x.post) / a.post")
    assert [s[0] for s in steps] == ["reading", "~", "number", "reading", "-", "*", "reading", "/"] and readings == [("a", None, "post"), ("b", "x", "post")]
