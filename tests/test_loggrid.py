"""Published grids of log counts."""

from rootgrain.operators import loggrid

LOGS = "case_id string, container string, cluster_id string, template string, at_seconds double"
CLUSTERS = "case_id string, key string, container string, template string"
LINES = "case_id string, line int, cells array<string>"
KNOWN = [("a", "10", "cart", "T ten"), ("a", "2", "cart", "T two"), ("a", "2", "shop", "T two"), ("a", "3", "cart", "T two"), ("a", "2", "cart", "T two")]
ROWS = [
    ("a", "cart", "10", "T ten", 30.0), ("a", "cart", "10", "masked", 31.0), ("a", "cart", "10", "T two", 44.9), ("a", "cart", None, "T two", 75.0), ("a", "cart", "", "nothing", 90.0),
    ("a", "cart", "99", "T ten", 60.0), ("a", "shop", "2", None, 30.0), ("b", "cart", "1", "x", 5.0),
]
HEAD = ["time", "cart_2", "shop_2", "cart_3", "cart_10"]
GOOD = [["30", "0", "1", "0", "3"], ["45", "0", "0", "0", "0"], ["60", "0", "0", "0", "1"], ["75", "1", "0", "1", "0"], ["90", "0", "0", "0", "0"]]


def frames(spark, lines, logs=ROWS, clusters=KNOWN):
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(logs, LOGS), spark.createDataFrame(clusters, CLUSTERS)


def lines(case, rows):
    return [(case, 3 * n + 1, r) for n, r in enumerate(rows)]


def test_assignment(spark):
    _, logs, clusters = frames(spark, [])
    held = loggrid.assigned(logs, clusters)
    assert sorted((r.tier, tuple(r.into or ()), r.masked, r.contradicted, r.n) for r in held.collect() if True) == [
        ("dropped", (), False, False, 1), ("dropped", (), False, False, 1), ("id", ("cart_10",), False, False, 1), ("id", ("cart_10",), False, True, 1), ("id", ("cart_10",), True, False, 1),
        ("id", ("shop_2",), True, False, 1), ("template", ("cart_10",), False, False, 1), ("template", ("cart_2", "cart_3"), False, False, 1),
    ]
    assert [(r.bucket, [str(c) for c in r.cells]) for r in loggrid.dense(held, clusters).orderBy("bucket").collect()] == [(int(g[0]), g[1:]) for g in GOOD]


def compared(spark, rows, **how):
    return loggrid.compare(*frames(spark, lines("a", rows), **how)).first()


def test_whole_tables(spark):
    r = compared(spark, [HEAD, *GOOD])
    assert (r.outcome, r.contradicted, r.wrong, r.rows, r.expected_rows, r.columns, r.cells) == ("disagreed", 1, 0, 5, 5, 4, 20)
    assert (r.seen, r.by_id, r.by_template, r.dropped, r.masked, r.lowest, r.highest) == (7, 4, 2, 1, 2, 30, 90)
    r = compared(spark, [HEAD, ["30", "0", "1", "0", "2"], *GOOD[1:]], logs=[x for x in ROWS if x[4] != 44.9])
    assert (r.outcome, r.contradicted, r.wrong) == ("reproduced", 0, 0)


def test_differences(spark):
    r = compared(spark, [HEAD, ["30", "0", "x", "0"], *GOOD[1:4], ["90", "0", "0", "0", "0", "7"], ["105", "0", "0", "0", "0"]])
    assert (r.wrong, r.rows, r.expected_rows, r.cells) == (3, 6, 5, 25)
    assert [tuple(e) for e in r.examples] == [(0, "shop_2", "x", "1"), (0, "cart_10", "", "3"), (4, "?", "7", "")]
    r = compared(spark, [["time", "cart_2"], *GOOD])
    assert (r.outcome, r.header_matches, r.rows, r.columns, r.cells, r.wrong, r.seen) == ("disagreed", False, 0, 0, 0, 0, 7)
    r = compared(spark, [HEAD, *[["1"] * 5] * 9])
    assert len(r.examples) == 5 and r.wrong == 9 * 5 - 4


def test_no_logs_and_no_tables(spark):
    r = compared(spark, [HEAD, GOOD[0]], logs=[])
    assert (r.outcome, r.seen, r.expected_rows, r.rows) == ("disagreed", 0, 0, 1)
    r = compared(spark, [["time"]], logs=[], clusters=[])
    assert (r.outcome, r.rows) == ("reproduced", 0)
    assert loggrid.compare(*frames(spark, [])).count() == 0 and loggrid.bound(*frames(spark, [])[:2]).count() == 0


def test_bounds(spark):
    logs = [("a", "cart", None, None, float(s)) for s in (0, 1, 14, 15)] + [("a", "shop", None, None, 0.0)]
    tables = {
        "a": [["time", "cart_1", "cart_2", "shop_1"], ["0", "1", "2", "1"], ["15", "", "1", "0"]],
        "over": [["time", "cart_1"], ["0", "1"]],
        "odd": [["time", "cart_1"], ["0", "-1"], ["x", "1"], ["15", "1.5"], ["30", "1"]],
        "head": [["when", "cart_1"]],
        "column": [["time", "cart"], ["0", "1"]],
        "_": [["time", "_1"], ["0", "1"]],
        "off": [["time", "cart_1"], ["7", "1"]],
        "zero": [["time", "cart_1"], ["0", "0"]],
    }
    published, held, _ = frames(spark, [x for c, rows in tables.items() for x in lines(c, rows)], [*logs, *[("odd", "cart", None, None, 30.0)]])
    got = {r.case_id: r for r in loggrid.bound(published, held).collect()}
    assert {c: (r.outcome, r.reason) for c, r in got.items()} == {
        "a": ("bounded", None), "over": ("disagreed", None), "odd": ("disagreed", None), "head": ("refused", "unreadable-header"), "column": ("refused", "unreadable-column"), "_": ("refused", "unreadable-column"),
        "off": ("refused", "off-grid-table"), "zero": ("refused", "no-published-cells"),
    }
    r = got["a"]
    assert (r.pairs, r.over, r.unreadable, r.tightest, r.published_total, r.published_rows, r.columns, r.cells, r.log_rows) == (3, 0, 0, 0, 5, 2, 3, 4, 5)
    assert (got["over"].over, got["over"].tightest, got["over"].log_rows) == (1, -1, 0)
    assert (got["odd"].unreadable, got["odd"].over) == (3, 0)
