"""Joins on a key that few values may share among them."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

#: A value with more than this share of the rows is met by broadcast; there are fewer than 1000 of them.
FREQUENT = 0.001


def looked_up(rows: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what answer() adds to the distinct values of `key`.

    answer gets (_key, _n), each value once with its count, null included, and returns all of them with
    more columns, few rows for each. No task gets all rows of a frequent value: those stay where
    they are, the others go by a shuffle. rows are read three times.
    """
    told = kept(answer(rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))), "answers")
    least = told.select("_key", "_n").distinct().agg((F.sum("_n") * FREQUENT).alias("_least"))
    marked = told.join(F.broadcast(least), how="cross")
    frequent, others = (marked.where(w).drop("_n", "_least") for w in ("_n > _least", "_n <= _least"))
    same = lambda df: F.col(key).eqNullSafe(df["_key"])
    names = F.broadcast(frequent.select("_key").distinct())
    rest = rows.join(names, same(names), "left_anti")
    return rows.join(F.broadcast(frequent), same(frequent)).drop("_key").unionByName(rest.join(others, same(others)).drop("_key"))
