"""Samples of faults beside what cases and predictions say of them: coverage, vocabulary, verdicts of fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fault_type

FIELDS = ("type", "category", "component", "description")


def coverage_issues(entries: DataFrame, samples: DataFrame) -> DataFrame:
    """entries (case_id, sample_id), samples (sample_id) -> (sample_id, code, n): `duplicate` for samples of
    several cases, `missing` for those of none. The latter are only told where there are as many entries as
    samples or more: a shorter index is not finished."""
    counted = entries.groupBy("sample_id").agg(F.count("*").alias("n"))
    twice = counted.where("n > 1").select("sample_id", F.lit("duplicate").alias("code"), "n")
    none = samples.select("sample_id").distinct().join(counted, "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("code"), F.lit(0).cast("long").alias("n"))
    whole = entries.agg(F.count("*").alias("_e")).join(samples.agg(F.count("*").alias("_s")), F.col("_e") >= F.col("_s")).select(F.lit("missing").alias("code"))
    return twice.unionByName(none.join(F.broadcast(whole), "code", "left_semi").select("sample_id", "code", "n"))


def vocabulary_issues(declared: DataFrame, labelled: DataFrame, word: str = "type") -> DataFrame:
    """(word, code): `unoffered` for labels that the vocabulary lacks, `unlabelled` for members without one."""
    sides = declared.select(word, F.lit(True).alias("_d")).unionByName(labelled.select(word, F.lit(False).alias("_d")))
    told = sides.groupBy(word).agg(F.bool_or("_d").alias("_offered"), F.bool_or(~F.col("_d")).alias("_used"))
    return told.where("NOT (_offered AND _used)").select(word, F.when(F.col("_used"), "unoffered").otherwise("unlabelled").alias("code"))


def pair(samples: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """samples beside the predictions of their keys. Raises, when rows are read, where a key has none or
    several on either side: predictions are told by key, so the two tables disagree there."""
    mine, theirs = samples.withColumn("_m", F.lit(1)), predictions.withColumnRenamed(key, "_key").withColumn("_t", F.lit(1))
    m, t = samples.groupBy(key).agg(F.count("*").alias("_mn")), predictions.groupBy(key).agg(F.count("*").alias("_tn"))
    counts = m.join(t.withColumnRenamed(key, "_k2"), F.col(key) == F.col("_k2"), "full").select(F.coalesce(key, "_k2").alias("_k"), F.coalesce("_mn", F.lit(0)).alias("_mn"), F.coalesce("_tn", F.lit(0)).alias("_tn"))
    bad = (F.col("_mn") != 1) | (F.col("_tn") != 1)
    checked = counts.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("not one sample and one prediction of "), F.col("_k").cast("string"))).cast("boolean")).otherwise(True)).where("_ok")
    return checked.join(mine, F.col(key) == F.col("_k")).join(theirs, F.col("_key") == F.col("_k")).drop("_k", "_key", "_m", "_t", "_mn", "_tn", "_ok")


def verdict(expected: dict[str, Column], actual: dict[str, Column], parsed: Column, valid: Column, verifiable: Column) -> Column:
    """struct(state, type, category, component, description): unparseable, unvalidated, unverifiable or
    graded. Only graded samples have fields: null where nothing is expected, false where nothing is told,
    else whether both are one slug."""
    state = F.when(~F.coalesce(parsed, F.lit(False)), "unparseable").when(~F.coalesce(valid, F.lit(False)), "unvalidated").when(~F.coalesce(verifiable, F.lit(True)), "unverifiable").otherwise("graded")
    same = lambda f: F.when((state == "graded") & expected[f].isNotNull(), F.coalesce(fault_type(expected[f]) == fault_type(actual[f]), F.lit(False)))
    return F.struct(state.alias("state"), *[same(f).alias(f) for f in FIELDS])


def recoverable(misses: DataFrame, sample: str = "sample_id") -> DataFrame:
    """misses (sample, verdict) -> (sample, miss_count, recoverable): no miss is a different fault."""
    return misses.groupBy(sample).agg(F.count("*").alias("miss_count"), F.bool_and(F.col("verdict") != "different-fault").alias("recoverable"))


def binding_field(verdicts: DataFrame, misses: DataFrame) -> DataFrame:
    """(recoverable_samples, blocked_samples, field, hits, total): one row; field is the one with the fewest
    hits of those that are scored at all, the first of equal ones; null where none is."""
    counts = [F.struct(F.count(F.when(F.col(f), 1)).alias("hits"), F.lit(i).alias("i"), F.lit(f).alias("field"), F.count(f).alias("total")) for i, f in enumerate(FIELDS)]
    scored = verdicts.agg(F.array_min(F.filter(F.array(*counts), lambda c: c["total"] > 0)).alias("b"))
    samples = recoverable(misses).agg(F.count(F.when(F.col("recoverable"), 1)).alias("recoverable_samples"), F.count(F.when(~F.col("recoverable"), 1)).alias("blocked_samples"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(samples).join(one(scored), "_one").select("recoverable_samples", "blocked_samples", "b.field", "b.hits", "b.total")
