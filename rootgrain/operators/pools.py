"""What a loader takes for candidates and for a baseline when it opens a table of a case."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what the loader cuts from a name.
DATABASE = "-db"


def candidates(headers: DataFrame, *key: str) -> DataFrame:
    """headers (key, head) -> (key, head, name, candidate): the name before the first underscore of each
    column but `time`, and that name without its first `-db`."""
    name = F.substring_index("head", "_", 1)
    return headers.where("head != 'time'").select(*key, "head", name.alias("name"), F.regexp_replace(name, f"^(.*?){DATABASE}", "$1").alias("candidate"))


def pool(headers: DataFrame, entities: DataFrame, *key: str) -> DataFrame:
    """(key, candidate, kind, heads, rewritten): each distinct candidate with the kind of the entity of its
    name (null: unknown), the number of its columns, and whether any of them had another name."""
    kinds = entities.groupBy(F.col("name").alias("candidate")).agg(F.max("kind").alias("kind"))
    own = candidates(headers, *key).groupBy(*key, "candidate").agg(F.count("*").alias("heads"), F.bool_or(F.col("name") != F.col("candidate")).alias("rewritten"))
    return own.join(kinds, "candidate", "left").select(*key, "candidate", "kind", "heads", "rewritten")


def baseline_window(times: DataFrame, at: Column, inject: Column, *key: str) -> DataFrame:
    """(key, rows, earliest, latest): instants before the injection, and the range of all; an instant that
    is no finite number does not count, and without any the range is 0 to 0."""
    finite = at.isNotNull() & ~F.isnan(at) & (F.abs(at) != float("inf"))
    return times.groupBy(*key).agg(F.count(F.when(finite & (at < inject), 1)).alias("rows"), F.coalesce(F.min(F.when(finite, at)), F.lit(0.0)).alias("earliest"), F.coalesce(F.max(F.when(finite, at)), F.lit(0.0)).alias("latest"))
