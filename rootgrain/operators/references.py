"""What checkpoints and causal steps refer to: series, published rows, evidence, and calls between owners.

checkpoints: case_id, checkpoint_id, entity_ref and, where they are asked for, metric, signal_ref,
signal_kind. steps: case_id, step, from_entity, to_entity, evidence_refs. Entities and edges as in graph.

A reference is met tier by tier. Each tier is a join on equal keys, the second over what holds an entity
in the closure of containment, so that neither two lists of a case nor all that one entity holds are crossed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import graph

#: What parts owner and reading in a published reference (a fixed value of the format).
SEPARATOR = "|"


def _resolved(refs: DataFrame, entities: DataFrame, ref: str) -> DataFrame:
    """graph.resolve(), with nothing for an empty reference, whatever entities have no name."""
    return graph.resolve(refs, entities, ref).withColumn("entity_id", F.when(F.col(ref) != "", F.col("entity_id")))


def holders(edges: DataFrame) -> DataFrame:
    """(entity_id, near): every entity with those that it lies within. They are few; what lies within one is not,
    so that both ways between two entities go from the inner one outwards."""
    return graph.closure(edges).select(F.col("inner").alias("entity_id"), F.col("outer").alias("near")).where("entity_id != near").distinct()


def resolve_readings(checkpoints: DataFrame, series: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, checkpoint_id, kind, via, service, carriers, declares): the series that each metric means.

    series has case_id, service and metric. kind is resolved with the one service that carries the
    metric on the checkpoint's entity (via entity) or else on one that holds it or lies within it (via
    component); unknownMetric where no series of the case has it, with the metrics that are declared;
    unknownEntity where the checkpoint's entity is none; ambiguous where several services fit on the
    tier that has any; otherComponent where none does. carriers are the services in question, in order,
    once for each series. Equal checkpoints are told each; a null service or metric is an empty text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    declared = series.select("case_id", text("service"), text("metric"))
    counted = declared.groupBy("case_id", "metric", "service").agg(F.count(F.lit(1)).alias("n"))
    carried = kept(_resolved(counted, entities, "service"), "carried")
    on_entity = carried.where("entity_id IS NOT NULL").groupBy("case_id", "metric", "entity_id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("service", "n")).alias("who"))
    of_metric = carried.groupBy("case_id", "metric").agg(F.collect_list(F.struct("service", "n")).alias("all"))
    of_case = counted.where("metric <> ''").groupBy("case_id").agg(F.array_sort(F.collect_set("metric")).alias("declares"))

    asked = kept(_resolved(checkpoints.select("case_id", "checkpoint_id", text("entity_ref"), text("metric")), entities, "entity_ref").withColumn("row", F.monotonically_increasing_id()), "asked")
    exact = asked.join(on_entity, ["case_id", "metric", "entity_id"]).select("row", F.col("n").alias("n1"), F.col("who").alias("who1"))
    by = ["case_id", "metric", "entity_id"]
    rest = asked.where("entity_id IS NOT NULL").join(exact.select("row"), "row", "left_anti").select("row", *by)
    around, told = holders(edges), ["row", F.col("entity_id").alias("carried_on"), "n", "who"]
    of_holder = rest.join(around, "entity_id").select("row", "case_id", "metric", F.col("near").alias("entity_id")).join(on_entity, by).select(*told)
    of_part = on_entity.join(around, "entity_id").select("case_id", "metric", F.col("near").alias("holder"), F.col("entity_id").alias("part"), "n", "who").join(rest.withColumnRenamed("entity_id", "holder"), ["case_id", "metric", "holder"])
    met = of_holder.union(of_part.select("row", "part", "n", "who")).dropDuplicates(["row", "carried_on"])  # on a cycle both ways lead there
    near = met.groupBy("row").agg(F.sum("n").alias("n2"), F.flatten(F.collect_list("who")).alias("who2"))
    out = asked.join(exact, "row", "left").join(near, "row", "left").join(of_metric, ["case_id", "metric"], "left").join(of_case, "case_id", "left")

    unknown, lost = F.col("all").isNull(), F.col("entity_id").isNull()
    kind = F.when(unknown, "unknownMetric").when(lost, "unknownEntity").when((F.col("n1") == 1) | (F.col("n1").isNull() & (F.col("n2") == 1)), "resolved").when(F.coalesce("n1", "n2").isNotNull(), "ambiguous").otherwise("otherComponent")
    who = F.when(~unknown & ~lost, F.coalesce("who1", "who2", "all"))
    names = F.flatten(F.transform(F.array_sort(who), lambda w: F.array_repeat(w["service"], w["n"].cast("int"))))
    done = F.col("kind") == "resolved"
    told = out.select("case_id", "checkpoint_id", kind.alias("kind"), F.when(F.col("n1").isNotNull(), "entity").otherwise("component").alias("via"), names.alias("names"), F.coalesce("declares", F.array().cast("array<string>")).alias("declares"))
    return told.select("case_id", "checkpoint_id", "kind", F.when(done, F.col("via")).alias("via"), F.when(done, F.get("names", F.lit(0))).alias("service"), F.when(F.col("kind").isin("ambiguous", "otherComponent"), F.col("names")).alias("carriers"), F.when(F.col("kind") == "unknownMetric", F.col("declares")).alias("declares"))


def carrier(signal_kind: Column, signal_ref: Column) -> Column:
    """The table in which a reference lives: logs, parameters or metrics; null without a reference."""
    return F.when(signal_ref.isNotNull(), F.when(signal_kind == "log", "logs").when(signal_kind == "configuration", "parameters").otherwise("metrics"))


def join_published(checkpoints: DataFrame, metrics: DataFrame, logs: DataFrame, parameters: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, checkpoint_id, kind, carrier, key, match, reason): what exported tables have for each reference.

    metrics (case_id, metric, entity_id), logs (case_id, id, entity_id), parameters (case_id, key) are
    what a case published. kind is none without a reference; joined, with the match: entity, container
    (only a row of an entity that holds the checkpoint's or lies within it) or key; or dangling, with the
    reason: noRow, otherEntity or noKey. Entities are compared by id.
    """
    rows = metrics.select("case_id", F.lit("metrics").alias("carrier"), F.col("metric").alias("key"), "entity_id").unionByName(logs.select("case_id", F.lit("logs").alias("carrier"), F.col("id").alias("key"), "entity_id"))
    rows = kept(rows.unionByName(parameters.select("case_id", F.lit("parameters").alias("carrier"), "key", F.lit(None).cast("string").alias("entity_id"))).where("key IS NOT NULL").distinct(), "published")
    asked = checkpoints.select("case_id", "checkpoint_id", F.col("entity_ref").alias("entity_id"), F.col("signal_ref").alias("key"), carrier(F.col("signal_kind"), F.col("signal_ref")).alias("carrier"))
    asked = kept(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    by_key, by_entity = ["case_id", "carrier", "key"], ["case_id", "carrier", "key", "entity_id"]
    there = asked.join(rows.select(*by_key).distinct(), by_key).select("row", F.lit(True).alias("there"))
    exact = asked.join(rows, by_entity).select("row", F.lit(True).alias("exact"))
    rest = asked.where("carrier != 'parameters'").join(exact, "row", "left_anti").select("row", *by_entity)
    around = holders(edges)
    of_holder = rest.join(around, "entity_id").select("row", *by_key, F.col("near").alias("entity_id")).join(rows, by_entity)
    of_part = rest.join(rows.join(around, "entity_id").select(*by_key, F.col("near").alias("entity_id")).distinct(), by_entity)
    near = of_holder.select("row").union(of_part.select("row")).distinct().withColumn("near", F.lit(True))
    out = asked.join(there, "row", "left").join(exact, "row", "left").join(near, "row", "left")
    by_name = F.col("carrier") == "parameters"
    match = F.when(by_name & F.col("there"), "key").when(F.col("exact"), "entity").when(F.col("near"), "container")
    reason = F.when(F.col("match").isNull() & F.col("carrier").isNotNull(), F.when(by_name, "noKey").when(F.col("there").isNull(), "noRow").otherwise("otherEntity"))
    kind = F.when(F.col("carrier").isNull(), "none").when(F.col("match").isNotNull(), "joined").otherwise("dangling")
    return out.withColumn("match", match).select("case_id", "checkpoint_id", kind.alias("kind"), "carrier", "key", "match", reason.alias("reason"))


def reference_tally(joined: DataFrame) -> DataFrame:
    """(case_id, published, joined, by_entity, by_container, by_key, dangling) of join_published()."""
    n = lambda of: F.count(F.when(of, 1))
    kind, match = F.col("kind"), F.col("match")
    return joined.groupBy("case_id").agg(n(kind != "none").alias("published"), n(kind == "joined").alias("joined"), n(match == "entity").alias("by_entity"), n(match == "container").alias("by_container"), n(match == "key").alias("by_key"), n(kind == "dangling").alias("dangling"))


def signal_refs(checkpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, checkpoint_id, ref, fault, candidates): each reference with its owner's name, as it is published.

    fault is the first of: unresolved (no entity has that id), unnamed, emptyRef, preQualified (the
    reference holds the separator), ambiguous (with all entities of that name, in order). Then ref is
    null, as it is for checkpoints without a reference. Names are compared as they are.
    """
    names = entities.groupBy("entity_id").agg(F.min(F.coalesce("name", F.lit(""))).alias("name"))
    owners = names.groupBy("name").agg(F.array_sort(F.collect_list("entity_id")).alias("owners")).where("size(owners) > 1 AND name <> ''")
    told = checkpoints.join(names, F.col("entity_ref") == F.col("entity_id"), "left").join(owners, "name", "left")
    ref = F.col("signal_ref")
    fault = F.when(F.col("entity_id").isNull(), "unresolved").when(F.col("name") == "", "unnamed").when(ref == "", "emptyRef").when(ref.contains(SEPARATOR), "preQualified").when(ref.isNotNull() & F.col("owners").isNotNull(), "ambiguous")
    return told.withColumn("fault", fault).select("case_id", "checkpoint_id", F.when(F.col("fault").isNull(), F.concat("name", F.lit(SEPARATOR), ref)).alias("ref"), "fault", F.when(F.col("fault") == "ambiguous", F.col("owners")).alias("candidates"))


def step_evidence(steps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(case_id, step, checkpoints, unknown): the checkpoints that a step cites, in the order in which it does,
    and the references that name none of the case. A reference that is cited twice is told twice."""
    cited = steps.select("case_id", "step", F.posexplode_outer("evidence_refs").alias("pos", "checkpoint_id"))
    known = checkpoints.select("case_id", "checkpoint_id", F.lit(True).alias("known")).distinct()
    met = cited.join(known, ["case_id", "checkpoint_id"], "left").groupBy("case_id", "step").agg(F.array_sort(F.collect_list(F.struct("pos", "checkpoint_id", "known"))).alias("refs"))
    of = lambda known: F.transform(F.filter("refs", lambda r: r["checkpoint_id"].isNotNull() & (r["known"].isNotNull() if known else r["known"].isNull())), lambda r: r["checkpoint_id"])
    return met.select("case_id", "step", of(True).alias("checkpoints"), of(False).alias("unknown"))


def four_layers(cases: DataFrame, steps: DataFrame, checkpoints: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each case: whether its entity, fault, process and evidence layers are filled.

    cases: case_id, root_entity_id, fault_type, category. Returned are case_id, entity_filled,
    fault_filled, process_filled, evidence_filled, n_steps, n_checkpoints, unresolved (references to
    entities that the graph cannot answer, by layer, as entity:, process: or evidence: and the
    reference, in order), n_dangling (references of steps that name no checkpoint), uncited (checkpoints
    that no step cites, in order) and complete. A process needs a step, evidence a checkpoint, and all of
    their entities; a fault needs a type and a category other than unknown.
    """
    listed = cases.select("case_id", F.coalesce("root_entity_id", F.lit("")).alias("ref"), F.lit("entity").alias("layer"))
    ends = steps.select("case_id", F.explode(F.array("from_entity", "to_entity")).alias("ref"), F.lit("process").alias("layer"))
    stated = checkpoints.select("case_id", F.col("entity_ref").alias("ref"), F.lit("evidence").alias("layer"))
    refs = listed.unionByName(ends).unionByName(stated).withColumn("ref", F.coalesce("ref", F.lit("")))
    lost = _resolved(refs, entities, "ref").where("entity_id IS NULL").groupBy("case_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "layer", "ref"))).alias("unresolved"), *[F.max(F.col("layer") == x).alias(f"{x}_lost") for x in ("entity", "process", "evidence")])
    cited = steps.select("case_id", F.explode("evidence_refs").alias("checkpoint_id")).groupBy("case_id", "checkpoint_id").agg(F.count(F.lit(1)).alias("n"))
    own = checkpoints.groupBy("case_id", "checkpoint_id").agg(F.count(F.lit(1)).alias("stated"))
    both = own.join(cited, ["case_id", "checkpoint_id"], "full").groupBy("case_id").agg(
        F.coalesce(F.sum("stated"), F.lit(0)).alias("n_checkpoints"), F.coalesce(F.sum(F.when(F.col("stated").isNull(), F.col("n"))), F.lit(0)).alias("n_dangling"),
        F.array_sort(F.flatten(F.collect_list(F.when(F.col("n").isNull(), F.array_repeat("checkpoint_id", F.col("stated").cast("int")))))).alias("uncited"),
    )
    counted = steps.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_steps"))
    out = cases.join(lost, "case_id", "left").join(both, "case_id", "left").join(counted, "case_id", "left")
    number, texts = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")), lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    fine = lambda x: ~F.coalesce(F.col(f"{x}_lost"), F.lit(False))
    filled = {
        "entity_filled": fine("entity"), "fault_filled": (F.coalesce("fault_type", F.lit("")) != "") & (F.coalesce("category", F.lit("unknown")) != "unknown"),
        "process_filled": (number("n_steps") > 0) & fine("process"), "evidence_filled": (number("n_checkpoints") > 0) & fine("evidence"),
    }
    told = out.select("case_id", *[c.alias(n) for n, c in filled.items()], *[number(c).alias(c) for c in ("n_steps", "n_checkpoints", "n_dangling")], texts("unresolved").alias("unresolved"), texts("uncited").alias("uncited"))
    return told.withColumn("complete", F.expr("entity_filled AND fault_filled AND process_filled AND evidence_filled AND n_dangling = 0 AND size(unresolved) = 0 AND size(uncited) = 0"))


def owners(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, owner): the nearest service that an entity is or lies within, of equally near ones the
    first by id; entities without one are left out. One round for each level of containment."""
    kinds = entities.select(F.col("entity_id").alias("at"), (F.col("kind") == "service").alias("own")).distinct()
    up = edges.where("relation IN ('contains', 'hosts')").select(F.col("dst").alias("at"), F.col("src").alias("next")).distinct()
    front = kept(entities.select("entity_id", F.col("entity_id").alias("at")).distinct(), "front")
    seen, found = front, []
    while True:
        reached = front.join(kinds.where("own"), "at").groupBy("entity_id").agg(F.min("at").alias("owner"))
        found.append(kept(reached, "owners"))
        further = front.join(found[-1], "entity_id", "left_anti").join(up, "at").select("entity_id", F.col("next").alias("at")).distinct()
        front = kept(further.join(seen, ["entity_id", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = kept(seen.unionByName(front), "seen")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def calls_across(steps: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, from, to): names of the owners at the two ends of causal steps between which a call goes,
    in either direction; each pair of a case once, as the first step that has it says. Steps within one
    owner, or with an end that nobody owns, tell nothing."""
    own = kept(owners(entities, edges), "owners")
    calls = edges.where("relation = 'calls'").select("src", "dst")
    either = calls.union(calls.select("dst", "src")).distinct()
    ends = steps.join(own.toDF("from_entity", "src"), "from_entity").join(own.toDF("to_entity", "dst"), "to_entity").where("src != dst")
    called = ends.select("case_id", "src", "dst").distinct().join(either, ["src", "dst"], "left_semi")
    names = entities.groupBy("entity_id").agg(F.min("name").alias("name"))
    return called.join(names.toDF("src", "from"), "src").join(names.toDF("dst", "to"), "dst").select("case_id", "from", "to")
