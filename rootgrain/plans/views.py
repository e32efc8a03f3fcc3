"""The driver's tables seen as cases, signals, entities and records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

#: The injection instant of all cases: 2024-01-16T00:00:00Z.
INJECT_MS = 1_705_363_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric signals from events, in 25 cases and 10 services."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("case-"), (F.col("user_id") % 25).cast("string")).alias("case_id"), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("service"),
        F.col("event_type").alias("name"), "value", F.lit("1").alias("unit"), times.epoch_ms(F.col("ts")).alias("ts_ms"), F.col("event_id").alias("signal_idx"), F.lit("metric").alias("signal"), F.col("props").alias("body"),
    )


SIGNALS = """SELECT 'case-' || (user_id % 25) AS case_id, 'svc-' || (user_id % 10) AS service, event_type AS name, value, '1' AS unit,
  epoch_us(ts) // 1000 AS ts_ms, event_id AS signal_idx, 'metric' AS signal, props AS body FROM events"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each customer: its window is an hour to three days from an instant made of the key."""
    c = table(spark, sf_dir, "customer")
    start = F.lit(INJECT_MS) + (F.col("c_custkey") * 7919 % 1000) * 3_600_000
    end = start + ((F.col("c_custkey") % 72) + 1) * 3_600_000
    return c.select(
        F.col("c_custkey").alias("case_ord"), F.concat(F.lit("case-"), F.col("c_custkey").cast("string")).alias("case_id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("system"),
        F.lower("c_mktsegment").alias("fault_type"), times.iso_utc(start + 600_000).alias("inject_time"), times.iso_utc(start).alias("window_start"), times.iso_utc(end).alias("window_end"),
        F.concat(F.lit("service:/"), F.col("c_nationkey").cast("string")).alias("root_entity_id"), F.col("c_name").alias("query"),
    )


_ISO = "strftime(make_timestamp(({}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
_START = f"CAST({INJECT_MS} AS BIGINT) + (c_custkey * 7919 % 1000) * 3600000"
CASES = f"""SELECT c_custkey AS case_ord, 'case-' || c_custkey AS case_id, c_mktsegment || '-' || c_nationkey AS system, lower(c_mktsegment) AS fault_type,
  {_ISO.format(_START + " + 600000")} AS inject_time, {_ISO.format(_START)} AS window_start, {_ISO.format(_START + " + ((c_custkey % 72) + 1) * 3600000")} AS window_end,
  'service:/' || c_nationkey AS root_entity_id, c_name AS query, {_START} AS lo, {_START} + ((c_custkey % 72) + 1) * 3600000 AS hi FROM customer"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions contain nations, nations host suppliers and customers."""
    t = lambda n: table(spark, sf_dir, n)
    ent = lambda df, key, kind, name: df.select(F.concat(F.lit(f"{kind}:/"), F.col(key).cast("string")).alias("entity_id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.array(F.split(name, "[# ]")[0]).alias("aliases"))
    entities = ent(t("region"), "r_regionkey", "cluster", "r_name").unionByName(ent(t("nation"), "n_nationkey", "node", "n_name")).unionByName(ent(t("supplier"), "s_suppkey", "service", "s_name")).unionByName(ent(t("customer"), "c_custkey", "external", "c_name"))
    edge = lambda df, a, ka, b, kb, rel: df.select(F.concat(F.lit(f"{ka}:/"), F.col(a).cast("string")).alias("src"), F.concat(F.lit(f"{kb}:/"), F.col(b).cast("string")).alias("dst"), F.lit(rel).alias("relation"))
    edges = edge(t("nation"), "n_regionkey", "cluster", "n_nationkey", "node", "contains").unionByName(edge(t("supplier"), "s_nationkey", "node", "s_suppkey", "service", "hosts")).unionByName(edge(t("customer"), "c_nationkey", "node", "c_custkey", "external", "hosts"))
    return entities, edges


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root span for each order of a status other than P, a child for each of all lines."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    roots = o.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("trace_id"), F.col("o_orderkey").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent"))
    return roots.unionByName(li.select(F.col("l_orderkey").alias("trace_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("span_id"), F.col("l_orderkey").cast("string").alias("parent")))
