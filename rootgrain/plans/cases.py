"""Registered queries of rankings and difficulty."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains
from .queries import query
from .views import table


@query("""WITH t AS (SELECT l_orderkey, max(l_partkey) AS truth FROM lineitem GROUP BY ALL), l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey, max(l_quantity) OVER (PARTITION BY l_orderkey, l_returnflag, l_partkey) AS q FROM lineitem),
r AS (SELECT l.*, truth, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY q DESC, CAST(l_partkey AS VARCHAR)) AS n FROM l JOIN t USING (l_orderkey))
SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS method, min(CASE WHEN l_partkey = truth THEN n END) AS rank_of_truth, count(*) AS candidate_count FROM r GROUP BY ALL""")
def ranking_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order ranked by quantity, for each flag; the truth is the largest part key."""
    li = table(spark, d, "lineitem")
    rankings = li.groupBy(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("method"), F.col("l_partkey").cast("string").alias("service")).agg(F.max("l_quantity").alias("statistic"))
    cases = li.groupBy(F.col("l_orderkey").cast("string").alias("case_id")).agg(F.max("l_partkey").cast("string").alias("component"))
    return chains.outcomes(cases, rankings)


@query("""WITH s AS (SELECT o_orderkey, count(l_orderkey) AS depth FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, depth, CASE WHEN depth > 0 THEN 2 ELSE 1 END AS breadth, CASE WHEN depth >= 3 THEN 'L4' WHEN depth >= 2 THEN 'L3' WHEN depth >= 1 THEN 'L2' ELSE 'L1' END AS floor FROM s""")
def difficulty_floors(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases, their returned lines as steps from a service to a node."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_returnflag = 'R'")
    entities = spark.createDataFrame([("service:/a", "service"), ("node:/b", "node")], "entity_id string, kind string")
    cases = o.select(F.col("o_orderkey").cast("string").alias("case_id"), F.lit("service:/a").alias("root_entity_id"))
    steps = li.select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("step"), F.lit("service:/a").alias("from_entity"), F.lit("node:/b").alias("to_entity"))
    return chains.difficulty_floor(cases, steps, entities)
