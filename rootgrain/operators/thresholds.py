"""Whether a similarity tells two classes of pairs apart, and where to cut if it has to.

scores: model, positive (whether the pair belongs together), value.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import kept

#: By how much the classes have to lie apart, and the digits of what is told (fixed values of the data model).
MARGIN = 0.05
DIGITS = 3


def spreads(scores: DataFrame) -> DataFrame:
    """(model, positive, n, min, max, mean) of the classes of each model; null scores are left out."""
    v = F.col("value")
    return scores.where(v.isNotNull()).groupBy("model", "positive").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(v), DIGITS).alias("min"), F.round(F.max(v), DIGITS).alias("max"), F.round(F.avg(v), DIGITS).alias("mean"))


def least_bad(scores: DataFrame) -> DataFrame:
    """(model, threshold, errors, false_refusals, false_credits): the cut with the fewest errors, the lowest of
    equal ones. Each score is a candidate: positives below it are refused falsely, others from it on are
    credited falsely.

    Scores are summed by value before the shuffle, sorted over all tasks, and counted up within each
    range; what earlier ranges hold is added, so that one model may have most of the scores.
    """
    own = scores.where("value IS NOT NULL AND model IS NOT NULL")
    n = lambda of: F.sum(F.when(of, 1).otherwise(0)).cast("long")
    values = own.groupBy("model", "value").agg(n(F.col("positive")).alias("p"), n(~F.col("positive")).alias("q"))
    ranged = kept(values.repartitionByRange("model", "value").withColumn("part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy("model", "part").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    earlier = Window.partitionBy("model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = parts.select("model", "part", F.coalesce(F.sum("p").over(earlier), F.lit(0)).alias("p0"), F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q0"), F.sum("q").over(Window.partitionBy("model")).alias("all_q"))
    below = Window.partitionBy("model", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    cuts = ranged.withColumns({"p1": before("p"), "q1": before("q")}).join(held, ["model", "part"])
    cuts = cuts.select("model", "value", (F.col("p0") + F.col("p1")).alias("refused"), (F.col("all_q") - F.col("q0") - F.col("q1")).alias("credited"))
    best = cuts.groupBy("model").agg(F.min(F.struct((F.col("refused") + F.col("credited")).alias("errors"), "value", "refused", "credited")).alias("b"))
    return best.select("model", F.round("b.value", DIGITS).alias("threshold"), "b.errors", F.col("b.refused").alias("false_refusals"), F.col("b.credited").alias("false_credits"))


def measure(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(model, gap, separates, threshold and the cut of least_bad() as fitted_threshold, errors, false_refusals,
    false_credits): gap is what lies between the lowest positive and the highest other; from margin on the
    classes are apart, and threshold is the middle of it. Models without scores of both classes have no gap."""
    v, p = F.col("value"), F.col("positive")
    ends = scores.where("value IS NOT NULL AND model IS NOT NULL").groupBy("model").agg(F.round(F.min(F.when(p, v)), DIGITS).alias("low"), F.round(F.max(F.when(~p, v)), DIGITS).alias("high"))
    told = ends.withColumn("gap", F.round(F.col("low") - F.col("high"), DIGITS)).withColumn("separates", F.coalesce(F.col("gap") >= margin, F.lit(False)))
    return told.join(least_bad(scores).withColumnRenamed("threshold", "fitted_threshold"), "model").select("model", "gap", "separates", F.when(F.col("separates"), F.round((F.col("low") + F.col("high")) / 2, DIGITS)).alias("threshold"), "fitted_threshold", "errors", "false_refusals", "false_credits")


def verdict(measured: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(shipped, separating, best_model, best_gap, shortfall): one row. separating are the models whose classes are
    apart, in order; the best has the largest gap, the first by name of equal ones; shortfall is what its
    gap lacks to the margin. No models, nothing shipped."""
    told = measured.agg(F.array_sort(F.collect_list(F.when(F.col("separates"), F.col("model")))).alias("separating"), F.max("gap").alias("best_gap"))
    first = measured.join(F.broadcast(told.select("best_gap")), F.col("gap") == F.col("best_gap")).agg(F.min("model").alias("best_model"))
    both = told.crossJoin(F.broadcast(first))  # one row each
    return both.select((F.size("separating") > 0).alias("shipped"), "separating", "best_model", "best_gap", F.round(F.lit(margin) - F.col("best_gap"), DIGITS).alias("shortfall"))
