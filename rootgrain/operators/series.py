"""Statistics of metric series around an injection instant.

A series is the rows of one key (case, service, metric name). Rows before the instant are its
baseline, the others its post part. Every operator is one grouping or one window over the key, so
that the series is shuffled once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import resolution

FLOOR = 1e-6


def split_stats(signals: DataFrame, inject_ms: Column | int, *key: str) -> DataFrame:
    """One row for each series with rows on both sides: baseline mean, population deviation, minimum
    and maximum, and the post part's extremes. The extremes suffice for the largest deviation, so
    that no row is joined back."""
    before = F.col("ts_ms") < inject_ms
    base, post = F.when(before, F.col("value")), F.when(~before, F.col("value"))
    out = signals.groupBy(*key).agg(
        F.avg(base).alias("mean"), F.coalesce(F.stddev_pop(base), F.lit(0.0)).alias("sigma"), F.min(base).alias("low"), F.max(base).alias("high"),
        F.count(base).alias("n_base"), F.min(post).alias("post_low"), F.max(post).alias("post_high"), F.count(post).alias("n_post"), F.first("unit", ignorenulls=True).alias("unit"),
    )
    return out.where("n_base > 0 AND n_post > 0")


def peak_z(signals: DataFrame, inject_ms: Column | int, *key: str) -> DataFrame:
    """Services ranked by their largest peak: over their metrics, the largest deviation of a post value
    from the baseline's mean in baseline deviations. A flat baseline counts in steps of its unit.
    key ends in (service, name); ties go by service."""
    *groups, service, _ = key
    stats = split_stats(signals, inject_ms, *key)
    scale = F.when(F.col("low") == F.col("high"), resolution(F.col("unit"))).otherwise(F.greatest("sigma", F.lit(FLOOR)))
    peak = F.greatest(F.col("post_high") - F.col("mean"), F.col("mean") - F.col("post_low")) / scale
    best = stats.groupBy(*groups, service).agg(F.max(peak).alias("peak"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("peak"), service)))


def median_shift(signals: DataFrame, inject_ms: Column | int, *key: str) -> DataFrame:
    """Services ranked by the largest shift of a metric's median, in 1.4826 median absolute deviations
    of the baseline; a flat baseline counts in steps of its unit. Medians are exact."""
    *groups, service, _ = key
    before = F.col("ts_ms") < inject_ms
    series = Window.partitionBy(*key)
    with_median = signals.withColumn("_m", F.median(F.when(before, F.col("value"))).over(series))
    stats = with_median.groupBy(*key).agg(
        F.first("_m").alias("m"), F.median(F.when(~before, F.col("value"))).alias("post"), F.median(F.when(before, F.abs(F.col("value") - F.col("_m")))).alias("mad"),
        F.min(F.when(before, F.col("value"))).alias("low"), F.max(F.when(before, F.col("value"))).alias("high"), F.first("unit", ignorenulls=True).alias("unit"),
    ).where("m IS NOT NULL AND post IS NOT NULL")
    scale = F.when(F.col("low") == F.col("high"), resolution(F.col("unit"))).otherwise(F.greatest(1.4826 * F.col("mad"), F.lit(FLOOR)))
    best = stats.groupBy(*groups, service).agg(F.max(F.abs(F.col("post") - F.col("m")) / scale).alias("shift"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("shift"), service)))


def z_rows(signals: DataFrame, inject_ms: Column | int, *key: str) -> DataFrame:
    """The post rows of series with a baseline, with z and their ordinal in arrival order (signal_idx)."""
    series = Window.partitionBy(*key)
    before = F.col("ts_ms") < inject_ms
    base = F.when(before, F.col("value"))
    known = signals.withColumns({"_mean": F.avg(base).over(series), "_sigma": F.coalesce(F.stddev_pop(base).over(series), F.lit(0.0))})
    post = known.where(~before & F.col("_mean").isNotNull())
    z = F.abs(F.col("value") - F.col("_mean")) / F.greatest("_sigma", F.lit(FLOOR))
    return post.withColumns({"z": z, "ord": F.row_number().over(series.orderBy("signal_idx"))}).drop("_mean", "_sigma")


def longest_run(rows: DataFrame, threshold: float, *key: str) -> DataFrame:
    """For each series, the most consecutive rows (by ord) with z of the threshold or more, and how
    many there are at its end."""
    hit = F.col("z") >= threshold
    order = Window.partitionBy(*key).orderBy("ord")
    islands = rows.withColumns({"_hit": hit, "_misses": F.sum(F.when(hit, 0).otherwise(1)).over(order)})
    runs = islands.groupBy(*key, "_misses").agg(F.count_if("_hit").alias("run"), F.max("ord").alias("_last"))
    return runs.groupBy(*key).agg(F.max("run").alias("longest_run"), F.max_by("run", "_last").alias("trailing_run"))


def flip_point(rows: DataFrame, samples: int, *key: str) -> DataFrame:
    """The largest threshold at which a run of `samples` rows exists: over all windows of that many
    rows, the largest of the smallest z. Null where the series is shorter."""
    window = Window.partitionBy(*key).orderBy("ord").rowsBetween(0, samples - 1)
    low = rows.withColumns({"_low": F.min("z").over(window), "_n": F.count("z").over(window)})
    return low.groupBy(*key).agg(F.max(F.when(F.col("_n") == samples, F.col("_low"))).alias("flip"))


def threshold_grid(rows: DataFrame, thresholds: list[float], samples: list[int], case: str, *key: str) -> DataFrame:
    """How many cases each pair of threshold and run length admits. Flip points are computed once for a
    run length; every threshold is then a comparison."""
    spark = rows.sparkSession
    flips = None
    for k in samples:
        own = flip_point(rows, k, case, *key).groupBy(case).agg(F.max("flip").alias("flip")).withColumn("samples", F.lit(k))
        flips = own if flips is None else flips.unionByName(own)
    grid = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    admitted = F.coalesce(F.col("threshold") <= F.col("flip"), F.lit(False))
    # the grid has a row for each threshold given
    return flips.crossJoin(F.broadcast(grid)).groupBy("samples", "threshold").agg(F.count_if(admitted).alias("admitted"), F.count_if(~admitted).alias("refused"))


def onsets(signals: DataFrame, inject_ms: Column | int, threshold: float, samples: int, *key: str) -> DataFrame:
    """For each series in time order: the start of the first run of `samples` post rows that deviate
    from the baseline by `threshold` sample deviations or more; null where there is none."""
    series = Window.partitionBy(*key)
    before = F.col("ts_ms") < inject_ms
    base = F.when(before, F.col("value"))
    known = signals.withColumns({"_mean": F.avg(base).over(series), "_sigma": F.coalesce(F.stddev_samp(base).over(series), F.lit(0.0))})
    order = series.orderBy("ts_ms", "signal_idx")
    hit = F.abs(F.col("value") - F.col("_mean")) / F.greatest("_sigma", F.lit(FLOOR)) >= threshold
    rows = known.where(~before & F.col("_mean").isNotNull()).withColumn("_hit", hit)
    islands = rows.withColumn("_misses", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(order))
    runs = islands.groupBy(*key, "_misses").agg(F.count_if("_hit").alias("run"), F.min(F.when(F.col("_hit"), F.col("ts_ms"))).alias("start"))
    return runs.groupBy(*key).agg(F.min(F.when(F.col("run") >= samples, F.col("start"))).alias("onset_ms"), F.max("run").alias("longest_run"))


def preexisting(signals: DataFrame, inject_ms: Column | int, first: int, threshold: float, *key: str) -> DataFrame:
    """Baseline rows after the first `first` ones that deviate from those by `threshold` or more: an
    anomaly that was there before the injection."""
    order = Window.partitionBy(*key).orderBy("ts_ms", "signal_idx")
    rows = signals.where(F.col("ts_ms") < inject_ms).withColumn("_n", F.row_number().over(order))
    series = Window.partitionBy(*key)
    head = F.when(F.col("_n") <= first, F.col("value"))
    known = rows.withColumns({"_mean": F.avg(head).over(series), "_sigma": F.coalesce(F.stddev_samp(head).over(series), F.lit(0.0))})
    z = F.abs(F.col("value") - F.col("_mean")) / F.greatest("_sigma", F.lit(FLOOR))
    return known.groupBy(*key).agg(F.count("*").alias("n_base"), F.count_if((F.col("_n") > first) & (z >= threshold)).alias("n_anomalous"))
