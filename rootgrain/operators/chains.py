"""Checks of causal chains, difficulty of cases, and how rankings miss the truth.

steps: (case_id, step, from_entity, to_entity). cases as in gates. rankings: (case_id, method, service,
kind, statistic).
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, lookup


def resolved(steps: DataFrame, entities: DataFrame) -> DataFrame:
    """steps with `src` and `dst`, the entities that both ends name, null where they name none or several."""
    known = graph.resolve(steps, entities, "from_entity").withColumnRenamed("entity_id", "src")
    return graph.resolve(known, entities, "to_entity").withColumnRenamed("entity_id", "dst")


def chain_issues(cases: DataFrame, steps: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, code) of broken chains: ends that name no entity, a step that does not begin where the one
    before ended, hops between entities that no path of the graph joins, steps not numbered from 1 on,
    a chain that comes back, and a root cause off its chain. The last three are told once for each case."""
    known = resolved(steps, entities)
    order = Window.partitionBy("case_id").orderBy("step")
    rows = known.withColumns({"_before": F.lag("to_entity").over(order), "_place": F.row_number().over(order)})
    parts = graph.connected(edges.select("src", "dst"), entities.select(F.col("entity_id").alias("node")))
    hops = known.where("src IS NOT NULL AND dst IS NOT NULL").join(parts.toDF("src", "_a"), "src").join(parts.toDF("dst", "_b"), "dst")
    # a chain visits its first beginning, and every end that is not where it stands already
    ends = rows.where("_place = 1").select("case_id", F.col("from_entity").alias("at")).unionAll(rows.where("to_entity != coalesce(_before, from_entity)").select("case_id", F.col("to_entity").alias("at")))
    roots = graph.resolve(cases.where("trim(root_entity_id) != ''").select("case_id", F.col("root_entity_id").alias("ref")), entities).select("case_id", F.col("entity_id").alias("root"))
    touched = known.select("case_id", F.explode(F.array("src", "dst")).alias("root")).where("root IS NOT NULL").distinct()
    off = roots.where("root IS NOT NULL").join(steps.select("case_id").distinct(), "case_id", "left_semi").join(touched, ["case_id", "root"], "left_anti")
    found = [
        (rows.where("src IS NULL"), "UNRESOLVED_CAUSAL_FROM"),
        (rows.where("dst IS NULL"), "UNRESOLVED_CAUSAL_TO"),
        (rows.where("_before != from_entity"), "CAUSAL_CHAIN_BREAK"),
        (hops.where("_a != _b"), "CAUSAL_HOP_NOT_IN_TOPOLOGY"),
        (rows.where("step != _place").dropDuplicates(["case_id"]), "CAUSAL_STEPS_NOT_NUMBERED"),
        (ends.groupBy("case_id", "at").agg(F.count("*").alias("n")).where("n > 1").dropDuplicates(["case_id"]), "CAUSAL_CHAIN_REVISITS"),
        (off, "ROOT_OFF_ITS_CHAIN"),
    ]
    return reduce(DataFrame.unionByName, [df.select("case_id", F.lit(code).alias("code")) for df, code in found])


def difficulty_floor(cases: DataFrame, steps: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, depth, breadth, floor): L4 from three steps on, L3 from two, L2 where root and chain are
    of two kinds of entity or more, L1 else."""
    refs = cases.select("case_id", F.col("root_entity_id").alias("entity_id")).unionByName(steps.select("case_id", F.explode(F.array("from_entity", "to_entity")).alias("entity_id")))
    known = entities.select(F.col("entity_id").alias("_key"), "kind")
    kinds = lookup.looked_up(refs, "entity_id", lambda keys: keys.join(known, "_key", "left")).groupBy("case_id").agg(F.countDistinct("kind").alias("breadth"))
    depth = steps.groupBy("case_id").agg(F.count("*").alias("depth"))
    out = cases.select("case_id").join(depth, "case_id", "left").join(kinds, "case_id", "left").select("case_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("breadth", F.lit(0)).alias("breadth"))
    return out.withColumn("floor", F.when(F.col("depth") >= 3, "L4").when(F.col("depth") >= 2, "L3").when(F.col("breadth") >= 2, "L2").otherwise("L1"))


def shortfalls(cases: DataFrame, floors: DataFrame) -> DataFrame:
    """(case_id, difficulty, floor) of cases whose declared level is below their floor."""
    return cases.select("case_id", "difficulty").join(floors.select("case_id", "floor"), "case_id").where("difficulty IS NOT NULL AND difficulty < floor")


def displacement(cases: DataFrame, rankings: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, method, kind): what stands before the answer. none where the answer leads or is not
    ranked, same-component where the leader contains it or is contained in it, tie where both have one
    statistic, strict otherwise. Names of several entities stand for none."""
    order = Window.partitionBy("case_id", "method").orderBy(F.desc("statistic"), "service")
    ranked = rankings.withColumn("_n", F.row_number().over(order))
    top = ranked.where("_n = 1").select("case_id", "method", F.col("service").alias("leader"), F.col("statistic").alias("_top"))
    answer = ranked.join(cases.select("case_id", F.col("component").alias("service"), "root_entity_id"), ["case_id", "service"]).select("case_id", "method", "service", "root_entity_id", "statistic")
    names = entities.groupBy(F.col("name").alias("leader")).agg(F.min("entity_id").alias("_entity"), F.count("*").alias("_owners")).where("_owners = 1").drop("_owners")
    inside = graph.closure(edges)
    either = inside.union(inside.select("inner", "outer")).distinct().toDF("_entity", "root_entity_id").withColumn("_same", F.lit(True))
    rows = top.join(answer, ["case_id", "method"], "left").join(names, "leader", "left").join(either, ["_entity", "root_entity_id"], "left")
    same = F.coalesce("_same", F.col("_entity") == F.col("root_entity_id"), F.lit(False))
    kind = F.when(F.col("service").isNull() | (F.col("service") == F.col("leader")), "none").when(same, "same-component").when(F.col("_top") == F.col("statistic"), "tie").otherwise("strict")
    return rows.select("case_id", "method", kind.alias("kind"))


def pool_narrowing(cases: DataFrame, rankings: DataFrame, kind: str = "service") -> DataFrame:
    """(case_id, method, before, after): the answer's rank among all candidates and among those of one
    kind of entity; null where it is not ranked."""
    of = lambda rows: rows.withColumn("_r", F.row_number().over(Window.partitionBy("case_id", "method").orderBy(F.desc("statistic"), "service"))).join(cases.select("case_id", F.col("component").alias("service")), ["case_id", "service"]).select("case_id", "method", "_r")
    runs = rankings.join(cases.select("case_id"), "case_id", "left_semi").select("case_id", "method").distinct()
    out = runs.join(of(rankings).withColumnRenamed("_r", "before"), ["case_id", "method"], "left")
    return out.join(of(rankings.where(F.col("kind") == kind)).withColumnRenamed("_r", "after"), ["case_id", "method"], "left")


def outcomes(cases: DataFrame, rankings: DataFrame) -> DataFrame:
    """(case_id, method, rank_of_truth, candidate_count): rankings as solvability and saturation take them.
    A truth with a statistic of 0 or none is not located."""
    order = Window.partitionBy("case_id", "method").orderBy(F.desc("statistic"), "service")
    ranked = rankings.join(cases.select("case_id", "component"), "case_id").withColumn("_n", F.row_number().over(order))
    hit = (F.col("service") == F.col("component")) & (F.coalesce("statistic", F.lit(0.0)) != 0)
    return ranked.groupBy("case_id", "method").agg(F.min(F.when(hit, F.col("_n"))).alias("rank_of_truth"), F.count("*").alias("candidate_count"))
