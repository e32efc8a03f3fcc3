from rootgrain.operators import chains


def graph(spark):
    entities = spark.createDataFrame([(1, "service:/a", "service", "a", []), (2, "service:/b", "service", "b", []), (3, "pod:/p", "pod", "p", []), (4, "db:/d", "db", "d", ["x"]), (5, "db:/e", "db", "e", ["x"])], "entity_ord int, entity_id string, kind string, name string, aliases array<string>")
    edges = spark.createDataFrame([(0, "service:/a", "service:/b", "calls"), (1, "service:/b", "pod:/p", "contains")], "edge_ord int, src string, dst string, relation string")
    return entities, edges


def cases(spark, *rows):
    return spark.createDataFrame(rows, "case_id string, root_entity_id string, component string, difficulty string")


def steps(spark, **chain):
    return spark.createDataFrame([(c, *s) for c, ss in chain.items() for s in ss], "case_id string, step int, from_entity string, to_entity string")


def test_chain_issues(spark):
    entities, edges = graph(spark)
    c = cases(spark, *[(k, "service:/a", "a", None) for k in ("good", "gap", "far", "loop", "off", "odd")])
    s = steps(spark, good=[(1, "service:/a", "service:/b"), (2, "service:/b", "pod:/p")], gap=[(1, "service:/a", "service:/b"), (3, "pod:/p", "service:/b")], far=[(1, "service:/a", "db:/d")], loop=[(1, "service:/a", "service:/b"), (2, "service:/b", "service:/a")], off=[(1, "service:/b", "pod:/p")], odd=[(1, "service:/a", "x"), (2, "x", "x")])
    got = {}
    for r in chains.chain_issues(c, s, entities, edges).collect():
        got.setdefault(r.case_id, set()).add(r.code)
    assert got == {
        "gap": {"CAUSAL_CHAIN_BREAK", "CAUSAL_STEPS_NOT_NUMBERED"},
        "far": {"CAUSAL_HOP_NOT_IN_TOPOLOGY"},
        "loop": {"CAUSAL_CHAIN_REVISITS"},
        "off": {"ROOT_OFF_ITS_CHAIN"},
        "odd": {"UNRESOLVED_CAUSAL_FROM", "UNRESOLVED_CAUSAL_TO"},
    }


def test_difficulty(spark):
    entities, _ = graph(spark)
    c = cases(spark, ("1", "service:/a", "a", "L1"), ("2", "service:/a", "a", "L1"), ("3", "service:/a", "a", "L4"), ("4", None, "a", None))
    s = steps(spark, **{"2": [(1, "service:/a", "pod:/p")], "3": [(1, "a", "b"), (2, "b", "c")]})
    floors = chains.difficulty_floor(c, s, entities)
    assert {r.case_id: r.floor for r in floors.collect()} == {"1": "L1", "2": "L2", "3": "L3", "4": "L1"}
    assert [r.case_id for r in chains.shortfalls(c, floors).collect()] == ["2"]


def test_rankings(spark):
    entities, edges = graph(spark)
    c = cases(spark, ("1", "service:/b", "b", None))
    rows = [("1", "lead", "b", "service", 3.0), ("1", "tie", "a", "service", 2.0), ("1", "tie", "b", "service", 2.0), ("1", "strict", "a", "service", 3.0), ("1", "strict", "b", "service", 2.0), ("1", "inner", "p", "pod", 3.0), ("1", "inner", "b", "service", 1.0), ("1", "gone", "a", "service", 1.0), ("1", "zero", "a", "service", 0.0), ("1", "zero", "b", "service", 0.0)]
    r = spark.createDataFrame(rows, "case_id string, method string, service string, kind string, statistic double")
    assert {x.method: x.kind for x in chains.displacement(c, r, entities, edges).collect()} == {"lead": "none", "tie": "tie", "strict": "strict", "inner": "same-component", "gone": "none", "zero": "tie"}
    assert {x.method: (x.before, x.after) for x in chains.pool_narrowing(c, r).collect()}["inner"] == (2, 1)
    told = {x.method: (x.rank_of_truth, x.candidate_count) for x in chains.outcomes(c, r).collect()}
    assert told["inner"] == (2, 2) and told["zero"] == (None, 2) and told["gone"] == (None, 1)
