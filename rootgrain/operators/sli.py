"""Which series of a case is published as the latency of its service, and how a declaration can fail."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_sentence
from ..functions.vocab import UNITS

SUFFIX = "_latency"


def token(text: Column) -> Column:
    """A name as a part of a path: letters, digits and inner hyphens; never empty."""
    out = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9-]", ""), "^-+|-+$", "")
    return F.when(out == "", "unnamed").otherwise(out)


def column(service: Column) -> Column:
    return F.concat(token(service), F.lit(SUFFIX))


def declaration(text: Column, component: Column) -> Column:
    """struct(fault, service, metric, reason) of a JSON text {service, metric} or {none: reason}. fault is
    absent (null, or a JSON null), unreadable, vague (a reason that is no sentence), foreign (a service
    other than the component) or null."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    part = lambda key: F.try_variant_get(value, f"$.{key}", "variant")
    # a field that is null is there, and is no text
    has = lambda key: F.coalesce(F.array_contains(F.map_keys(F.when(kind.startswith("OBJECT"), value.cast("map<string,variant>"))), key), F.lit(False))
    word = lambda key: F.when(F.schema_of_variant(part(key)) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))
    none, service, metric, reason = has("none"), word("service"), word("metric"), word("none")
    empty = F.coalesce((service == "") | (metric == ""), F.lit(True)) & ~none
    unreadable = ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)) | (none & (has("service") | has("metric"))) | (none & reason.isNull()) | empty
    fault = F.when(text.isNull() | F.coalesce(kind == "VOID", F.lit(False)), "absent").when(unreadable, "unreadable").when(none & ~looks_like_sentence(reason), "vague").when(~none & (token(service) != token(component)), "foreign")
    told = lambda c: F.when(fault.isNull(), c)
    return F.struct(fault.alias("fault"), told(service).alias("service"), told(metric).alias("metric"), told(reason).alias("reason"))


def resolve(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """cases (case_id, component, sli), metric signals (case_id, service, name, unit, signal_idx) ->
    (case_id, fault, source, target): the column that is published under another name. Besides the faults
    of declaration(): unresolved (no such series), notDuration (its first unit measures no time) and
    collision (the name is taken by another series). Cases that say why nothing ranks them have neither.

    Series are counted once a case before they meet the declarations; no case's signals are gathered."""
    read = cases.select("case_id", declaration(F.col("sli"), F.col("component")).alias("d"))
    series = signals.groupBy("case_id", F.concat_ws("_", "service", "name").alias("_column")).agg(F.min_by("unit", "signal_idx").alias("_unit"))
    wanted = F.concat(F.col("d.service"), F.lit("_"), F.col("d.metric"))
    own = read.withColumn("_wanted", wanted).withColumn("_target", column(F.col("d.service")))
    named = lambda prefix: series.select(F.col("case_id").alias(f"{prefix}_case"), F.col("_column").alias(f"{prefix}_column"), F.col("_unit").alias(f"{prefix}_unit"))
    met = own.join(named("_s"), (F.col("case_id") == F.col("_s_case")) & (F.col("_wanted") == F.col("_s_column")), "left")
    met = met.join(named("_t"), (F.col("case_id") == F.col("_t_case")) & (F.col("_target") == F.col("_t_column")), "left")
    durations = [u for u, (dimension, *_) in UNITS.items() if dimension == "time"]
    asks = F.col("d.fault").isNull() & F.col("d.service").isNotNull()
    fault = F.coalesce(F.col("d.fault"), F.when(asks & F.col("_s_column").isNull(), "unresolved").when(asks & ~F.coalesce(F.col("_s_unit").isin(*durations), F.lit(False)), "notDuration").when(asks & (F.col("_target") != F.col("_wanted")) & F.col("_t_column").isNotNull(), "collision"))
    publish = fault.isNull() & asks
    return met.select("case_id", fault.alias("fault"), F.when(publish, F.col("_wanted")).alias("source"), F.when(publish, F.col("_target")).alias("target"))
