"""Cuts between classes of scores."""

import random

from rootgrain.operators import thresholds

SCORES = "model string, positive boolean, value double"


def plain(rows):
    out = {}
    for model in {m for m, _, v in rows if m is not None and v is not None}:
        p = [v for m, x, v in rows if m == model and x and v is not None]
        q = [v for m, x, v in rows if m == model and not x and v is not None]
        cuts = [(sum(v < c for v in p) + sum(v >= c for v in q), c, sum(v < c for v in p), sum(v >= c for v in q)) for c in set(p + q)]
        errors, c, refused, credited = min(cuts)
        out[model] = (round(c, 3), errors, refused, credited)
    return out


def test_cuts_with_the_fewest_errors(spark):
    r = random.Random(4)
    rows = [(m, r.random() < 0.5, r.choice([round(r.random(), 2), None, 0.5])) for m in ("a", "b", "hot", "hot", "hot") for _ in range(200)] + [("one", True, 0.25), ("other", False, 0.25), ("apart", True, 0.9), ("apart", False, 0.1), (None, True, 1.0), ("ties", True, 0.5), ("ties", False, 0.5)]
    df = spark.createDataFrame(rows, SCORES).repartition(5)
    assert {x.model: tuple(x)[1:] for x in thresholds.least_bad(df).collect()} == plain(rows)
    told = {x.model: x for x in thresholds.measure(df).collect()}
    assert (told["apart"].gap, told["apart"].separates, told["apart"].threshold, told["apart"].errors) == (0.8, True, 0.5, 0)
    assert (told["one"].gap, told["one"].separates, told["one"].threshold) == (None, False, None) and told["ties"].separates is False
    assert tuple(thresholds.verdict(thresholds.measure(df)).first()) == (True, ["apart"], "apart", 0.8, -0.75)
    assert {(x.model, x.positive): (x.n, x.min, x.max, x.mean) for x in thresholds.spreads(df).where("model = 'apart'").collect()} == {("apart", True): (1, 0.9, 0.9, 0.9), ("apart", False): (1, 0.1, 0.1, 0.1)}


def test_no_scores(spark):
    none = spark.createDataFrame([], SCORES)
    assert thresholds.measure(none).count() == 0
    assert tuple(thresholds.verdict(thresholds.measure(none)).first()) == (False, [], None, None, None)
