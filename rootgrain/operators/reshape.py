"""Wide and long forms of metrics, and dense grids of log counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(signals: DataFrame, column: Column, names: list[str], *key: str) -> DataFrame:
    """A row for each key and second, a column for each name with the value that arrived last.
    The names are given, so that no pass is spent on finding them."""
    rows = signals.select(*key, F.floor(F.col("ts_ms") / 1000).cast("bigint").alias("time"), column.alias("_name"), "value", "signal_idx")
    return rows.groupBy(*key, "time").pivot("_name", names).agg(F.max_by("value", "signal_idx"))


def long(rows: DataFrame, time: str, entity: str | None = None) -> DataFrame:
    """The reverse of wide() for one table: (time, name, value) of the cells that hold a number.

    Where all columns carry entity prefixes, of more than one entity, only those of `entity` are
    taken, without the prefix.
    """
    names = [c for c in rows.columns if c != time]
    heads = {n.split("_", 1)[0] for n in names if "_" in n}
    if entity is not None and len(heads) > 1 and all("_" in n for n in names):
        names = [n for n in names if n.startswith(entity + "_")]
    cells = rows.select(F.col(time), *[F.col(f"`{n}`").try_cast("double").alias(n) for n in names]).unpivot(time, names, "name", "value")
    if entity is not None and len(heads) > 1:
        cells = cells.withColumn("name", F.regexp_replace("name", f"^{entity}_", ""))
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col(time).isNotNull())


def log_grid(logs: DataFrame, cluster: Column, seconds: int, *key: str) -> DataFrame:
    """(key, bucket_ms, cluster, n): counts of log rows in buckets of so many seconds, with a row for
    each bucket between the first and the last of the key and each cluster of the key, 0 where none
    was logged. Buckets of rows without a cluster widen the grid and are not counted."""
    at = F.floor(F.col("ts_ms") / (seconds * 1000)).cast("bigint") * (seconds * 1000)
    rows = logs.select(*key, at.alias("bucket_ms"), cluster.alias("cluster"))
    counts = rows.groupBy(*key, "bucket_ms", "cluster").agg(F.count("*").alias("n"))
    spans = counts.groupBy(*key).agg(F.min("bucket_ms").alias("_low"), F.max("bucket_ms").alias("_high"))
    clusters = counts.where("cluster IS NOT NULL").select(*key, "cluster").distinct()
    grid = clusters.join(spans, list(key)).select(*key, "cluster", F.explode(F.sequence("_low", "_high", F.lit(seconds * 1000))).alias("bucket_ms"))
    return grid.join(counts, [*key, "bucket_ms", "cluster"], "left").select(*key, "bucket_ms", "cluster", F.coalesce("n", F.lit(0)).alias("n"))
