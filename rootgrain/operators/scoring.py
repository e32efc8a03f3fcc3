"""Evaluation metrics of root-cause predictions, as columns and aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at(ranks: Column, truth: Column, k: int) -> Column:
    """Whether truth is among the first k of an array."""
    return F.coalesce(F.array_position(ranks, truth).between(1, k), F.lit(False))


def accuracy_at(rows: DataFrame, ranks: str, truth: str, most: int = 5, *key: str) -> DataFrame:
    """AC@1 to AC@most and their mean, for each key."""
    shares = [F.avg(hit_at(F.col(ranks), F.col(truth), k).cast("double")).alias(f"ac_{k}") for k in range(1, most + 1)]
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), *shares)
    return out.withColumn(f"avg_{most}", sum((F.col(f"ac_{k}") for k in range(1, most + 1)), F.lit(0.0)) / most)


def entity_term(predicted: Column, truth: Column, adjacent: Column) -> Column:
    """1 for the entity itself, 0.4 for one next to it, 0 else; null without a truth."""
    return F.when(truth.isNull(), None).when(predicted == truth, 1.0).when(F.coalesce(adjacent, F.lit(False)), 0.4).otherwise(0.0)


def final_a(entity: Column, fault: Column, process: Column) -> Column:
    """0.4 E + 0.3 F + 0.3 P over the terms that are there; null where none is."""
    weights = ((0.4, entity), (0.3, fault), (0.3, process))
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in weights), F.lit(0.0))
    return sum((F.coalesce(c, F.lit(0.0)) * w for w, c in weights), F.lit(0.0)) / F.when(total > 0, total)


def final_b(located: Column, typed: Column, evidence: Column, steps: Column) -> Column:
    """0.4 location + 0.4 type + 0.1 evidence + 0.1 efficiency; a path of more than 5 steps loses
    efficiency, and without the location there is none."""
    efficiency = F.when(located, F.least(F.lit(1.0), F.exp(-(steps - 5) / 5.0))).otherwise(0.0)
    return 0.4 * located.cast("double") + 0.4 * typed.cast("double") + 0.1 * evidence + 0.1 * efficiency


def keyword_hit(answer: Column, description: Column, words: int = 20) -> Column:
    """Whether one of the first words of the answer is a word of three letters or more of the description."""
    split = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.arrays_overlap(F.slice(split(answer), 1, words), F.filter(split(description), lambda w: F.length(w) > 2))


def normal(text: Column) -> Column:
    """For equality without case and white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def time_matches(a: Column, b: Column, seconds: int = 60) -> Column:
    """Whether two `YYYY-MM-DD HH:MM:SS` texts are at most so far apart; false where one is not read."""
    read = lambda c: F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(c, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.abs(read(a) - read(b)) <= seconds, F.lit(False))


def rates(rows: DataFrame, fields: dict[str, tuple[Column, Column]], *key: str) -> DataFrame:
    """Layered rates: for each field the share of right values among those that can be judged (truth is
    there) and can be read (prediction is there), and among all that can be judged; null without any."""
    aggregates = [F.count("*").alias("n")]
    for name, (predicted, truth) in fields.items():
        right = F.coalesce(predicted == truth, F.lit(False))
        judged = truth.isNotNull()
        aggregates += [F.avg(F.when(judged & predicted.isNotNull(), right.cast("double"))).alias(f"{name}_graded"), F.avg(F.when(judged, right.cast("double"))).alias(f"{name}_overall")]
    return rows.groupBy(*key).agg(*aggregates)


def census(cases: DataFrame, case: str, *levels: str) -> DataFrame:
    """Distinct cases for each level and for each prefix of the levels, as a rollup; null is `all`."""
    return cases.dropDuplicates([case]).rollup(*levels).agg(F.count("*").alias("cases"))


def coverage(cases: DataFrame, signals: DataFrame, weights: dict[str, float], targets: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """(kind, share) of cases that have a signal of each kind, and (target, status, loss): ready where
    every case has all kinds, degraded where some lack one, unavailable where a kind is nowhere."""
    kinds = list(weights)
    has = signals.groupBy("case_id").agg(*[F.bool_or(F.col("signal") == k).alias(k) for k in kinds])
    rows = cases.select("case_id").join(has, "case_id", "left")
    shares = rows.agg(*[F.avg(F.coalesce(F.col(k), F.lit(False)).cast("double")).alias(k) for k in kinds])
    by_kind = shares.unpivot([], kinds, "kind", "share")
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(t, k, float(weights[k])) for t, ks in targets.items() for k in ks], "target string, kind string, weight double")
    told = wanted.join(F.broadcast(by_kind), "kind").groupBy("target").agg(F.min("share").alias("_low"), F.max(F.when(F.col("share") < 1, F.col("weight"))).alias("loss"))
    status = F.when(F.col("_low") == 0, "unavailable").when(F.col("_low") < 1, "degraded").otherwise("ready")
    return by_kind, told.select("target", status.alias("status"), F.coalesce("loss", F.lit(0.0)).alias("loss"))
