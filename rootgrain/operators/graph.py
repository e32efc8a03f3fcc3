"""The entity graph: references, containment, aliases, and checks of its edges.

entities: (entity_ord, entity_id, kind, name, aliases). edges: (edge_ord, src, dst, relation).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import EDGE_RELATIONS, RELATION_SIDES
from ..sources.shared import kept
from . import lookup


def entity_id(kind: Column, namespace: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.coalesce(namespace, F.lit("")), F.lit("/"), name)


def reference_keys(entities: DataFrame) -> DataFrame:
    """(ref, entity_id, exact): every way to name an entity, ids as they are, names and aliases in lower case."""
    ids = entities.select(F.col("entity_id").alias("ref"), "entity_id", F.lit(True).alias("exact"))
    words = F.explode(F.array_distinct(F.transform(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name")), lambda a: F.lower(a))))
    return ids.unionByName(entities.select(words.alias("ref"), "entity_id", F.lit(False).alias("exact")).distinct())


def resolve(refs: DataFrame, entities: DataFrame, ref: str = "ref") -> DataFrame:
    """refs with the entity that each names: an id before a name or alias (case aside); null where
    nothing or more than one entity answers to it."""
    keys = reference_keys(entities)
    ids = keys.where("exact").select(F.col("ref").alias("_id"), F.col("entity_id").alias("_by_id"))
    names = keys.where("NOT exact").groupBy("ref").agg(F.min("entity_id").alias("_by_name"), F.countDistinct("entity_id").alias("_owners")).where("_owners = 1").select(F.col("ref").alias("_name"), "_by_name")

    def answer(words: DataFrame) -> DataFrame:
        met = words.join(ids, F.col("_key") == F.col("_id"), "left").join(names, F.lower("_key") == F.col("_name"), "left")
        return met.select("_key", "_n", F.coalesce("_by_id", "_by_name").alias("entity_id"))

    return lookup.looked_up(refs, ref, answer)


def ambiguous_aliases(entities: DataFrame) -> DataFrame:
    """(ref, owners): names and aliases, in lower case, of more than one entity."""
    keys = reference_keys(entities).where("NOT exact")
    return keys.groupBy("ref").agg(F.array_sort(F.collect_set("entity_id")).alias("owners")).where(F.size("owners") > 1)


def closure(edges: DataFrame, relations: tuple[str, ...] = ("contains", "hosts")) -> DataFrame:
    """(outer, inner): which entity lies within which, over one edge or more. Paths double in length
    each round, so that the rounds are the logarithm of the depth; a cycle ends as nothing new comes."""
    direct = edges.where(F.col("relation").isin(*relations)).select(F.col("src").alias("outer"), F.col("dst").alias("inner")).distinct()
    reached, count = kept(direct, "closure"), -1
    while (now := reached.count()) != count:
        count = now
        step = reached.select(F.col("outer").alias("_a"), F.col("inner").alias("_b")).join(reached, F.col("_b") == F.col("outer")).select(F.col("_a").alias("outer"), "inner")
        reached = kept(reached.unionByName(step).distinct(), "closure")
    return reached


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that can be reached over edges in either direction.

    Each round a node takes the smallest label of its neighbours, then that label's own label, so that
    reach doubles in the usual case; it ends when no label changes, however long the paths are.
    """
    both = kept(edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct(), "neighbours")
    labels = kept(nodes.select(F.col("node"), F.col("node").alias("label")).distinct(), "labels")
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("_near"))
        taken = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "label", F.least("label", F.coalesce("_near", "label")).alias("_next"))
        jump = labels.select(F.col("node").alias("_next"), F.col("label").alias("_jump"))
        moved = taken.join(jump, "_next", "left").select("node", "label", F.least("_next", F.coalesce("_jump", "_next")).alias("_next"))
        moved = kept(moved.select("node", F.col("_next").alias("label"), (F.col("_next") != F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def merge_aliases(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities joined by same_as edges become their first one in input order, with all names as sorted
    aliases; other edges move to it, those within it go."""
    same = edges.where("relation = 'same_as'")
    numbered = entities.select("entity_id", "entity_ord")
    ends = same.join(numbered.toDF("src", "a"), "src").join(numbered.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected(ends, entities.select(F.col("entity_ord").alias("node")))
    member = entities.join(groups, F.col("entity_ord") == F.col("node")).drop("node")
    first = entities.select(F.col("entity_ord").alias("label"), F.col("entity_id").alias("primary"), F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))))))
    merged = member.groupBy("label").agg(names.alias("aliases"), F.count("*").alias("members")).join(first, "label")
    merged = merged.select(F.col("label").alias("entity_ord"), F.col("primary").alias("entity_id"), F.col("_kind").alias("kind"), F.col("_name").alias("name"), F.array_remove("aliases", F.col("_name")).alias("aliases"), "members")
    to = member.join(first, "label").select("entity_id", "primary")
    moved = edges.where("relation != 'same_as'").join(to.toDF("src", "_s"), "src").join(to.toDF("dst", "_d"), "dst")
    return merged, moved.where("_s != _d").select("edge_ord", F.col("_s").alias("src"), F.col("_d").alias("dst"), "relation")


def edge_issues(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_ord, code, side): DANGLING_EDGE_REF for ends that no entity has, INVALID_RELATION, SELF_EDGE,
    and IMPLAUSIBLE_EDGE_DIRECTION for the first end whose kind the relation does not admit."""
    kinds = entities.select("entity_id", "kind")
    known = edges.join(kinds.toDF("src", "src_kind"), "src", "left").join(kinds.toDF("dst", "dst_kind"), "dst", "left")
    issue = lambda code, side: F.struct(F.lit(code).alias("code"), F.lit(side).alias("side"))
    nothing = F.lit(None).cast("struct<code:string,side:string>")
    self_edge = F.col("src") == F.col("dst")
    implausible = nothing
    for relation, (sources, targets) in RELATION_SIDES.items():
        wrong = F.when(F.col("src_kind").isNotNull() & ~F.col("src_kind").isin(*sources), issue("IMPLAUSIBLE_EDGE_DIRECTION", "from")).when(F.col("dst_kind").isNotNull() & ~F.col("dst_kind").isin(*targets), issue("IMPLAUSIBLE_EDGE_DIRECTION", "to"))
        implausible = F.when(F.col("relation") == relation, wrong).otherwise(implausible)
    found = F.array(
        F.when(F.col("src_kind").isNull(), issue("DANGLING_EDGE_REF", "from")),
        F.when(F.col("dst_kind").isNull(), issue("DANGLING_EDGE_REF", "to")),
        F.when(~F.col("relation").isin(*EDGE_RELATIONS), issue("INVALID_RELATION", "")),
        F.when(self_edge & F.col("src_kind").isNotNull(), issue("SELF_EDGE", "")).otherwise(implausible),
    )
    return known.select("edge_ord", F.explode(F.array_compact(found)).alias("issue")).select("edge_ord", "issue.code", "issue.side")


def dangling_parents(spans: DataFrame) -> DataFrame:
    """Distinct (trace_id, parent) that no span of the trace has."""
    wanted = spans.where("parent IS NOT NULL").select("trace_id", F.col("parent").alias("span_id")).distinct()
    return wanted.join(spans.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti").select("trace_id", F.col("span_id").alias("parent"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, relation) once each, without edges from an entity to itself, which assert nothing."""
    return edges.where("src != dst").select("src", "dst", "relation").distinct()


def foreign_logs(checkpoints: DataFrame, lines: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """checkpoints (case_id, checkpoint_id, entity_ref, signal_ref) of logs, lines (case_id, log_id, service)
    -> (case_id, checkpoint_id, code): UNKNOWN_AUTHOR where the cited line's service names no single entity,
    FOREIGN_AUTHOR where that entity is not the checkpoint's and neither lies within the other. Checkpoints
    of unknown entities, or that cite no line of their case, tell nothing; of lines with one id the one with
    the largest service counts."""
    one = lines.where("log_id != ''").groupBy("case_id", F.col("log_id").alias("signal_ref")).agg(F.max("service").alias("service"))
    known = resolve(checkpoints, entities, "entity_ref").where("entity_id IS NOT NULL").withColumnRenamed("entity_id", "_own")
    cited = resolve(known.join(one, ["case_id", "signal_ref"]).withColumn("service", F.coalesce("service", F.lit(""))), entities, "service").withColumnRenamed("entity_id", "_author")
    inside = closure(edges)
    either = inside.union(inside.select("inner", "outer")).distinct().toDF("_own", "_author").withColumn("_near", F.lit(True))
    told = cited.join(either, ["_own", "_author"], "left").where("_author IS NULL OR (_near IS NULL AND _own != _author)")
    return told.select("case_id", "checkpoint_id", F.when(F.col("_author").isNull(), "UNKNOWN_AUTHOR").otherwise("FOREIGN_AUTHOR").alias("code"))
