"""Set and multiset comparison of tables, and of files by checksum."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """(columns, left_n, right_n) of the rows that one side holds more often than the other. Each side
    is counted before they meet; nulls are equal to nulls."""
    sides = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counted = sides.groupBy(*columns).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))
    return counted.where("left_n != right_n")


def checksums(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path, content)."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict): match, mismatch, missing (in the manifest only) or extra (among the files only)."""
    found = checksums(files).toDF("_path", "_sha256", "_bytes")
    both = manifest.join(found, F.col("path") == F.col("_path"), "full")
    verdict = F.when(F.col("_path").isNull(), "missing").when(F.col("path").isNull(), "extra").when((F.col("sha256") == F.col("_sha256")) & (F.col("bytes") == F.col("_bytes")), "match").otherwise("mismatch")
    return both.select(F.coalesce("path", "_path").alias("path"), verdict.alias("verdict"))


def set_f1(a: Column, b: Column) -> Column:
    """2 |A and B| / (|A| + |B|) of two arrays as sets; null where both are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total)
