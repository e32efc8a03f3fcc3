"""Connected components of a table of links, without gathering it anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, keep: bool = False) -> DataFrame:
    """links (a, b) -> (node, label): label is the smallest node that can be reached.

    Each round every node takes the smallest label among its neighbours', then the label of that
    label, until nothing changes; the number of rounds grows with the logarithm of the diameter in
    the usual case. Only aggregates of single rows reach the driver. keep is that of stored().
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        taken = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        moved = stored(taken.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jumped", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("jumped", "next"))).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return stored(labels, "labels", keep) if keep else labels


def merged(labels: DataFrame, links: DataFrame, keep: bool = False) -> DataFrame:
    """labels (node, label) of components() with further links (a, b): the components are joined as
    nodes of a smaller graph. Nodes without a label are their own."""
    of = lambda c: labels.toDF(c, f"_{c}")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = components(ends.where("a != b")).toDF("label", "_new")
    old = labels.join(joined, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))
    fresh = joined.toDF("node", "label").join(labels.select("node"), "node", "left_anti")
    return stored(old.unionByName(fresh), "labels", keep)
