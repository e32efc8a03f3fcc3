"""Whether the telemetry of a case shows the fault that the case declares.

cases: (case_id, category, service, inject_ms); service is the name of the root cause, null where the
graph has none. signals: (case_id, service, name, semantic, ts_ms, signal_idx, value) metric rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import FLOOR

#: For each category of faults, the kinds of metric that it moves, and names of such metrics.
EXPECTED = {
    "resource": (("saturation",), "cpu|mem|memory|disk|io|fs|load|usage"),
    "network": (("latency", "error_rate", "throughput"), "latency|duration|rtt|error|fail|timeout|throughput|qps|rps"),
    "runtime": (("error_rate",), "error|fail|crash|restart|oom|exception"),
    "middleware": (("latency", "error_rate"), "latency|error|fail|timeout|queue|pool|conn"),
    "code": (("error_rate",), "error|fail|exception|http_5|status_5"),
    "config": (("error_rate",), "error|fail|restart|reload|config"),
    "dependency": (("latency", "error_rate"), "latency|error|fail|timeout|upstream|downstream"),
}


def expected(category: Column, name: Column, semantic: Column) -> Column:
    """Whether a metric of this name and kind is what a fault of the category moves."""
    out = F.lit(False)
    for known, (kinds, names) in EXPECTED.items():
        out = F.when(category == known, F.coalesce(semantic.isin(*kinds), F.lit(False)) | F.lower(name).rlike(names)).otherwise(out)
    return out


def series_readings(cases: DataFrame, signals: DataFrame, min_z: float = 2.0, samples: int = 3, preexisting_z: float = 4.0) -> DataFrame:
    """(case_id, service, name, ts_ms, ord, hit, post, matches, established, onset_ms, n_before): the rows of
    the series of each case's root cause, judged by the first `samples` values of the baseline.

    hit marks values that lie min_z sample deviations off or more (with another one of that instant),
    onset_ms begins the first run of `samples` of them after the injection, n_before counts later
    values of the baseline that lie preexisting_z off. A baseline of fewer values establishes nothing.
    """
    key = ("case_id", "service", "name")
    own = signals.join(cases.select("case_id", "service", "category", "inject_ms"), ["case_id", "service"])
    series = Window.partitionBy(*key)
    order = series.orderBy("ts_ms", "signal_idx")
    before = F.col("ts_ms") < F.col("inject_ms")
    rows = own.withColumns({"ord": F.row_number().over(order), "post": ~before, "matches": expected(F.col("category"), F.col("name"), F.col("semantic"))})
    head = F.when(before & (F.col("ord") <= samples), F.col("value"))
    known = rows.withColumns({"_mean": F.avg(head).over(series), "_sigma": F.coalesce(F.stddev_samp(head).over(series), F.lit(0.0)), "established": F.count(head).over(series) >= samples})
    z = F.abs(F.col("value") - F.coalesce("_mean", F.lit(0.0))) / F.greatest("_sigma", F.lit(FLOOR))
    told = known.withColumn("_z", z).withColumn("_hit", F.col("post") & F.col("established") & (F.col("_z") >= min_z))
    told = told.withColumn("n_before", F.count_if(~F.col("post") & (F.col("ord") > samples) & (F.col("_z") >= preexisting_z)).over(series))
    told = told.withColumn("_misses", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(order))
    island = Window.partitionBy(*key, "_misses")
    told = told.withColumns({"_run": F.count_if("_hit").over(island), "_start": F.min(F.when(F.col("_hit"), F.col("ts_ms"))).over(island)})
    told = told.withColumn("onset_ms", F.min(F.when(F.col("_hit") & (F.col("_run") >= samples), F.col("_start"))).over(series))
    return told.select(*key, "ts_ms", "ord", F.max("_hit").over(Window.partitionBy(*key, "ts_ms")).alias("hit"), "post", "matches", "established", "onset_ms", "n_before", "inject_ms")


def report(cases: DataFrame, signals: DataFrame, min_z: float = 2.0, samples: int = 3, tolerance_seconds: int = 120, preexisting_z: float = 4.0) -> DataFrame:
    """(case_id, target_resolves, target_observed, mechanism_manifested, onset_precision, sustained_duration,
    no_preexisting_anomaly, onset_offset_seconds, sustained, verdict): six checks of each case.

    The verdict is valid where all hold; unverifiable where one fails but nothing could speak (a
    category without a mechanism, no series of the root cause, or only series without a baseline);
    else invalid. A case whose root cause the graph lacks is invalid.
    """
    rows = series_readings(cases, signals, min_z, samples, preexisting_z)
    moved = F.col("matches") & F.col("established") & F.col("onset_ms").isNotNull()
    first = rows.where(moved).groupBy("case_id").agg(F.min("onset_ms").alias("first"))
    after = rows.where(moved).join(first, "case_id").where(F.col("ts_ms") >= F.col("first"))
    ends = Window.partitionBy("case_id", "service", "name").orderBy("ord")
    led = after.withColumn("_misses", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(ends)).where("_misses = 0")
    runs = led.groupBy("case_id", "name").agg(F.count("*").alias("run")).groupBy("case_id").agg(F.max("run").alias("sustained"))
    each = rows.groupBy("case_id", "name").agg(F.bool_or("matches").alias("matches"), F.bool_or("established").alias("established"), F.max("n_before").alias("n_before"), F.bool_or(moved).alias("moved"))
    told = each.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if("matches").alias("n_matching"), F.count_if(F.col("matches") & F.col("established")).alias("n_readable"), F.count_if("moved").alias("n_moved"), F.count_if(F.col("n_before") > 0).alias("n_old"))
    all_ = cases.select("case_id", "category", "service", "inject_ms").join(told, "case_id", "left").join(first, "case_id", "left").join(runs, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    unknown = ~F.coalesce(F.col("category").isin(*EXPECTED), F.lit(False))
    offset = F.floor((F.col("first") - F.col("inject_ms")) / 1000 + 0.5)
    checks = all_.select(
        "case_id", F.col("service").isNotNull().alias("target_resolves"), (zero("n") > 0).alias("target_observed"), (unknown | (zero("n_moved") > 0)).alias("mechanism_manifested"),
        F.coalesce(F.abs(offset) <= tolerance_seconds, F.lit(False)).alias("onset_precision"), (zero("sustained") >= samples).alias("sustained_duration"), (zero("n_old") == 0).alias("no_preexisting_anomaly"),
        offset.alias("onset_offset_seconds"), zero("sustained").alias("sustained"),
        (~unknown & (F.col("service").isNull() | ((zero("n") > 0) & ((zero("n_matching") == 0) | (zero("n_readable") > 0))))).alias("_speaks"),
    )
    names = ["target_resolves", "target_observed", "mechanism_manifested", "onset_precision", "sustained_duration", "no_preexisting_anomaly"]
    whole = F.forall(F.array(*names), lambda x: x)
    return checks.withColumn("verdict", F.when(whole, "valid").when(~F.col("_speaks"), "unverifiable").otherwise("invalid")).drop("_speaks")
