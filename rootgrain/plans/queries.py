"""Registered queries over the driver's tables, one for each family of operators, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, times, units, vocab
from ..operators import compare, gates, graph, reshape, rules, scoring, series
from ..operators.rules import Rule
from .views import CASES, INJECT_MS, SIGNALS, cases, signals, spans, table
from .views import graph as graph_view

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

KEY = ("case_id", "service", "name")


def query(sql: str | None = None):
    """Registers the function under its name, with the SQL that DuckDB runs for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_STATS = f"""s AS ({SIGNALS}), st AS (SELECT case_id, service, name, avg(value) FILTER (ts_ms < {INJECT_MS}) AS mean, coalesce(stddev_pop(value) FILTER (ts_ms < {INJECT_MS}), 0) AS sigma,
  min(value) FILTER (ts_ms < {INJECT_MS}) AS low, max(value) FILTER (ts_ms < {INJECT_MS}) AS high, count(value) FILTER (ts_ms < {INJECT_MS}) AS n_base,
  min(value) FILTER (ts_ms >= {INJECT_MS}) AS post_low, max(value) FILTER (ts_ms >= {INJECT_MS}) AS post_high, count(value) FILTER (ts_ms >= {INJECT_MS}) AS n_post
  FROM s GROUP BY ALL HAVING n_base > 0 AND n_post > 0)"""
_Z = f"""s AS ({SIGNALS}), m AS (SELECT case_id, service, name, avg(value) AS mean, coalesce(stddev_pop(value), 0) AS sigma FROM s WHERE ts_ms < {INJECT_MS} GROUP BY ALL),
  z AS (SELECT s.*, abs(value - mean) / greatest(sigma, 1e-6) AS z, row_number() OVER (PARTITION BY case_id, service, name ORDER BY signal_idx) AS ord FROM s JOIN m USING (case_id, service, name) WHERE ts_ms >= {INJECT_MS})"""


@query(f"""WITH {_STATS}, b AS (SELECT case_id, service, max(greatest(post_high - mean, mean - post_low) / CASE WHEN low = high THEN 0.01 ELSE greatest(sigma, 1e-6) END) AS p FROM st GROUP BY ALL)
SELECT case_id, service, round(p, 4) AS peak, CAST(row_number() OVER (PARTITION BY case_id ORDER BY p DESC, service) AS INT) AS rank FROM b""")
def peak_z_rank(spark: SparkSession, d: str) -> DataFrame:
    return series.peak_z(signals(spark, d), INJECT_MS, *KEY).withColumn("peak", F.round("peak", 4))


@query(f"""WITH s AS ({SIGNALS}), m AS (SELECT *, median(CASE WHEN ts_ms < {INJECT_MS} THEN value END) OVER (PARTITION BY case_id, service, name) AS m FROM s),
st AS (SELECT case_id, service, name, any_value(m) AS m, median(CASE WHEN ts_ms >= {INJECT_MS} THEN value END) AS post, median(CASE WHEN ts_ms < {INJECT_MS} THEN abs(value - m) END) AS mad,
 min(CASE WHEN ts_ms < {INJECT_MS} THEN value END) AS low, max(CASE WHEN ts_ms < {INJECT_MS} THEN value END) AS high FROM m GROUP BY ALL),
b AS (SELECT case_id, service, max(abs(post - m) / CASE WHEN low = high THEN 0.01 ELSE greatest(1.4826 * mad, 1e-6) END) AS x FROM st WHERE m IS NOT NULL AND post IS NOT NULL GROUP BY ALL)
SELECT case_id, service, round(x, 4) AS shift, CAST(row_number() OVER (PARTITION BY case_id ORDER BY x DESC, service) AS INT) AS rank FROM b""")
def median_shift_rank(spark: SparkSession, d: str) -> DataFrame:
    return series.median_shift(signals(spark, d), INJECT_MS, *KEY).withColumn("shift", F.round("shift", 4))


@query(f"""WITH {_Z}, i AS (SELECT *, z >= 1 AS hit, sum(CASE WHEN z >= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, service, name ORDER BY ord) AS g FROM z),
r AS (SELECT case_id, service, name, g, count(*) FILTER (hit) AS run, max(ord) AS last FROM i GROUP BY ALL)
SELECT case_id, service, name, max(run) AS longest_run, arg_max(run, last) AS trailing_run FROM r GROUP BY ALL""")
def g3_longest_run(spark: SparkSession, d: str) -> DataFrame:
    return series.longest_run(series.z_rows(signals(spark, d), INJECT_MS, *KEY), 1.0, *KEY)


_FLIP = """SELECT case_id, service, name, max(CASE WHEN n = {k} THEN low END) AS flip FROM (SELECT *, min(z) OVER w AS low, count(z) OVER w AS n FROM z
  WINDOW w AS (PARTITION BY case_id, service, name ORDER BY ord ROWS BETWEEN CURRENT ROW AND {k1} FOLLOWING)) GROUP BY ALL"""


@query(f"WITH {_Z} SELECT case_id, service, name, round(flip, 4) AS flip FROM ({_FLIP.format(k=3, k1=2)})")
def g3_flip_point(spark: SparkSession, d: str) -> DataFrame:
    return series.flip_point(series.z_rows(signals(spark, d), INJECT_MS, *KEY), 3, *KEY).withColumn("flip", F.round("flip", 4))


@query(f"""WITH {_Z}, f AS (SELECT case_id, 2 AS samples, max(flip) AS flip FROM ({_FLIP.format(k=2, k1=1)}) GROUP BY ALL UNION ALL SELECT case_id, 3, max(flip) FROM ({_FLIP.format(k=3, k1=2)}) GROUP BY ALL
 UNION ALL SELECT case_id, 4, max(flip) FROM ({_FLIP.format(k=4, k1=3)}) GROUP BY ALL), g AS (SELECT unnest([0.5, 1.0, 1.25, 1.5]) AS threshold)
SELECT CAST(samples AS INT) AS samples, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (coalesce(threshold <= flip, false)) AS admitted, count(*) FILTER (NOT coalesce(threshold <= flip, false)) AS refused FROM f, g GROUP BY ALL""")
def g3_threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return series.threshold_grid(series.z_rows(signals(spark, d), INJECT_MS, *KEY), [0.5, 1.0, 1.25, 1.5], [2, 3, 4], *KEY)


@query(f"""WITH s AS ({SIGNALS}), m AS (SELECT case_id, service, name, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sigma FROM s WHERE ts_ms < {INJECT_MS} GROUP BY ALL),
h AS (SELECT s.*, abs(value - mean) / greatest(sigma, 1e-6) >= 1 AS hit FROM s JOIN m USING (case_id, service, name) WHERE ts_ms >= {INJECT_MS}),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, service, name ORDER BY ts_ms, signal_idx) AS g FROM h),
r AS (SELECT case_id, service, name, g, count(*) FILTER (hit) AS run, min(ts_ms) FILTER (hit) AS start FROM i GROUP BY ALL)
SELECT case_id, service, name, min(start) FILTER (run >= 2) AS onset_ms, max(run) AS longest_run FROM r GROUP BY ALL""")
def validity_onset(spark: SparkSession, d: str) -> DataFrame:
    return series.onsets(signals(spark, d), INJECT_MS, 1.0, 2, *KEY)


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY case_id, service, name ORDER BY ts_ms, signal_idx) AS n FROM ({SIGNALS}) WHERE ts_ms < {INJECT_MS}),
m AS (SELECT case_id, service, name, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sigma FROM s WHERE n <= 5 GROUP BY ALL)
SELECT case_id, service, name, count(*) AS n_base, count(*) FILTER (n > 5 AND abs(value - mean) / greatest(sigma, 1e-6) >= 4) AS n_anomalous FROM s JOIN m USING (case_id, service, name) GROUP BY ALL""")
def preexisting_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return series.preexisting(signals(spark, d), INJECT_MS, 5, 4.0, *KEY)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    clock = F.when(F.col("o_orderkey") % 11 == 0, F.lit("not a time")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", clock.alias("clock"))


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN 'not a time' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS clock FROM orders"
_RULES = [
    Rule("t", "time", "at", source="clock", layout="iso8601", assume_offset_minutes=480),
    Rule("s", "map", "status", source="o_orderstatus", values={"F": "finished", "O": "open"}),
    Rule("p", "regex", "", source="o_orderpriority", pattern=r"^(?<level>\d)-(?<label>.+)$"),
]


@query(f"""WITH o AS ({_ORDERS}) SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate - INTERVAL 480 MINUTE, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS at,
CASE WHEN o_orderkey % 11 = 0 THEN 'BAD_TIMESTAMP' END AS code FROM o""")
def rule_time(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(_orders(spark, d), _RULES[:1]).select("o_orderkey", F.when(F.col("failure").isNull(), F.col("at")).alias("at"), F.col("failure.code").alias("code"))


@query("SELECT event_id, round(value / 1000, 9) AS seconds, round(value / 1000 / 60, 9) AS minutes FROM events")
def rule_unit(spark: SparkSession, d: str) -> DataFrame:
    out, _ = rules.transform(table(spark, d, "events").select("event_id", "value"), [Rule("a", "unit", "seconds", source="value", source_unit="ms", target_unit="s"), Rule("b", "unit", "minutes", source="seconds", source_unit="s", target_unit="min")])
    return out.select("event_id", F.round("seconds", 9).alias("seconds"), F.round("minutes", 9).alias("minutes"))


@query(f"WITH o AS ({_ORDERS}) SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'UNMAPPED_VALUE' END AS code FROM o")
def rule_map(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(_orders(spark, d), _RULES[1:2]).select("o_orderkey", "status", F.col("failure.code").alias("code"))


@query(f"""WITH o AS ({_ORDERS}) SELECT o_orderkey, regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 1) AS level, regexp_extract(o_orderpriority, '^(\\d)-(.+)$', 2) AS label,
CASE WHEN NOT regexp_matches(o_orderpriority, '^(\\d)-(.+)$') THEN 'PATTERN_MISMATCH' END AS code FROM o""")
def rule_regex(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(_orders(spark, d), _RULES[2:]).select("o_orderkey", "level", "label", F.col("failure.code").alias("code"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^Customer#(.+?)$') THEN 'customer' WHEN regexp_matches(c_name, '^(.+?) (.+?)$') THEN 'pair' END AS template,
CASE WHEN regexp_matches(c_name, '^Customer#(.+?)$') THEN regexp_extract(c_name, '^Customer#(.+?)$', 1) END AS number FROM customer""")
def rule_template(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("n", "template", "template", source="c_name", templates=(("bad", "{x} {x}"), ("customer", "Customer#{number}"), ("pair", "{first} {second}")))
    return rules.classify(table(spark, d, "customer"), [rule]).select("c_custkey", "template", F.col("template_params")["number"].alias("number"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS code FROM customer")
def rule_lookup(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(table(spark, d, "customer"), [Rule("l", "lookup", "code", source="c_mktsegment", values={"BUILDING": "b", "MACHINERY": "m"}, default="other")]).select("c_custkey", "code")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice * (1 - l_discount) / (l_discount * 10) - l_tax, 4) END AS net, CASE WHEN l_discount = 0 THEN 'EXPR_FAILED' END AS code FROM lineitem""")
def rule_expr(spark: SparkSession, d: str) -> DataFrame:
    rule = Rule("e", "expr", "net", expression="l_extendedprice * (1 - l_discount) / (l_discount * 10) - l_tax")
    return rules.classify(table(spark, d, "lineitem"), [rule]).select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"), F.col("failure.code").alias("code"))


@query(f"""WITH o AS ({_ORDERS}), c AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 't:BAD_TIMESTAMP' WHEN o_orderstatus NOT IN ('F', 'O') THEN 's:UNMAPPED_VALUE' WHEN NOT regexp_matches(o_orderpriority, '^(\\d)-(.+)$') THEN 'p:PATTERN_MISMATCH' ELSE 'ok' END AS outcome FROM o)
SELECT outcome, count(*) AS n FROM c GROUP BY outcome""")
def rule_quarantine_counts(spark: SparkSession, d: str) -> DataFrame:
    told = rules.classify(_orders(spark, d), _RULES)
    return told.groupBy(F.coalesce(F.concat_ws(":", F.col("failure.rule"), F.col("failure.code")), F.lit("")).alias("o")).agg(F.count("*").alias("n")).select(F.when(F.col("o") == "", "ok").otherwise(F.col("o")).alias("outcome"), "n")


@query("SELECT l_orderkey, second FROM (SELECT l_orderkey, l_linenumber AS second, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n = 2")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT l_orderkey AS trace_id, CAST(l_orderkey AS VARCHAR) AS parent FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dangling_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling_parents(spans(spark, d))


_ENTITIES = """ent AS (SELECT 'cluster:/' || r_regionkey AS entity_id, 'cluster' AS kind, r_name AS name FROM region UNION ALL SELECT 'node:/' || n_nationkey, 'node', n_name FROM nation
 UNION ALL SELECT 'service:/' || s_suppkey, 'service', s_name FROM supplier UNION ALL SELECT 'external:/' || c_custkey, 'external', c_name FROM customer),
 keys AS (SELECT DISTINCT entity_id, lower(k) AS ref FROM (SELECT entity_id, unnest([name, string_split_regex(name, '[# ]')[1]]) AS k FROM ent))"""
_EDGES = """edge AS (SELECT 'cluster:/' || n_regionkey AS src, 'node:/' || n_nationkey AS dst, 'contains' AS relation FROM nation UNION ALL SELECT 'node:/' || s_nationkey, 'service:/' || s_suppkey, 'hosts' FROM supplier
 UNION ALL SELECT 'node:/' || c_nationkey, 'external:/' || c_custkey, 'hosts' FROM customer)"""


@query(f"""WITH {_ENTITIES}, one AS (SELECT ref, min(entity_id) AS entity_id FROM keys GROUP BY ref HAVING count(DISTINCT entity_id) = 1),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Customer' WHEN o_orderkey % 3 = 1 THEN 'external:/' || o_custkey ELSE upper(c_name) END AS ref FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, coalesce(e.entity_id, one.entity_id) AS entity_id FROM r LEFT JOIN ent e ON e.entity_id = r.ref LEFT JOIN one ON one.ref = lower(r.ref)""")
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    entities, _ = graph_view(spark, d)
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    ref = F.when(F.col("o_orderkey") % 3 == 0, "Customer").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("external:/"), F.col("o_custkey").cast("string"))).otherwise(F.upper("c_name"))
    refs = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", ref.alias("ref"))
    return graph.resolve(refs, entities).select("o_orderkey", "entity_id")


@query(f"WITH {_ENTITIES} SELECT ref, count(DISTINCT entity_id) AS n_owners FROM keys GROUP BY ref HAVING count(DISTINCT entity_id) > 1")
def ambiguous_aliases(spark: SparkSession, d: str) -> DataFrame:
    return graph.ambiguous_aliases(graph_view(spark, d)[0]).select("ref", F.size("owners").cast("long").alias("n_owners"))


@query(f'WITH {_EDGES} SELECT src AS "outer", dst AS "inner" FROM edge UNION SELECT a.src, b.dst FROM edge a JOIN edge b ON a.dst = b.src')
def containment_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(graph_view(spark, d)[1])


@query(f"""WITH {_ENTITIES}, {_EDGES}, n AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS edge_ord FROM edge), x AS (SELECT edge_ord, src, CASE WHEN edge_ord % 10 = 0 THEN dst || '-gone' ELSE dst END AS dst, CASE WHEN edge_ord % 7 = 0 THEN 'calls' WHEN edge_ord % 13 = 0 THEN 'likes' ELSE relation END AS relation FROM n),
k AS (SELECT x.*, a.kind AS ka, b.kind AS kb FROM x LEFT JOIN ent a ON a.entity_id = src LEFT JOIN ent b ON b.entity_id = dst)
SELECT edge_ord, 'DANGLING_EDGE_REF' AS code, 'to' AS side FROM k WHERE kb IS NULL UNION ALL SELECT edge_ord, 'INVALID_RELATION', '' FROM k WHERE relation = 'likes'
UNION ALL SELECT edge_ord, 'IMPLAUSIBLE_EDGE_DIRECTION', CASE WHEN relation = 'calls' AND ka NOT IN ('service', 'external', 'container', 'host') THEN 'from' ELSE 'to' END FROM k
 WHERE (relation = 'calls' AND (ka NOT IN ('service', 'external', 'container', 'host') OR kb NOT IN ('service', 'external', 'db', 'mq'))) OR (relation = 'contains' AND kb NOT IN ('pod', 'container'))""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    entities, edges = graph_view(spark, d)
    n = edges.withColumn("edge_ord", F.row_number().over(Window.orderBy("src", "dst")).cast("long"))
    broken = n.select("edge_ord", "src", F.when(F.col("edge_ord") % 10 == 0, F.concat("dst", F.lit("-gone"))).otherwise(F.col("dst")).alias("dst"), F.when(F.col("edge_ord") % 7 == 0, "calls").when(F.col("edge_ord") % 13 == 0, "likes").otherwise(F.col("relation")).alias("relation"))
    return graph.edge_issues(entities, broken)


@query("""WITH c AS (SELECT DISTINCT user_id FROM events), w AS (SELECT user_id, unnest(['signup', 'purchase', 'error', 'view', 'click']) AS kind FROM c)
SELECT CAST(user_id AS VARCHAR) AS case_id, kind FROM w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.event_type = w.kind AND e.value > 300)""")
def g1_missing_signal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("signal"), "value")
    return gates.missing_kinds(e.select("case_id").distinct(), e.where("value > 300"), ("signup", "purchase", "error", "view", "click"))


@query(f"WITH s AS (SELECT *, lag(ts_ms) OVER (PARTITION BY case_id, service, name ORDER BY signal_idx) AS before FROM ({SIGNALS})) SELECT case_id, service, name, signal_idx FROM s WHERE before > ts_ms")
def g2_non_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return gates.non_monotonic(signals(spark, d))


def _outcomes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    out = li.select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("method"), F.when(F.col("l_quantity") <= 25, F.col("l_linenumber")).alias("rank_of_truth"), F.col("l_linenumber").alias("candidate_count"))
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("case_id")), out


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS case_id, count(DISTINCT CASE WHEN l_quantity <= 25 AND l_linenumber <= 3 THEN l_returnflag END) AS solvers, coalesce(bool_or(l_linenumber > 3), false) AS contested,
count(DISTINCT CASE WHEN l_quantity <= 25 AND l_linenumber <= 3 THEN l_returnflag END) >= 1 AS solvable FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def g4_solvability(spark: SparkSession, d: str) -> DataFrame:
    return gates.solvability(*_outcomes(spark, d))


@query("""WITH x AS (SELECT l_returnflag AS method, count(DISTINCT l_orderkey) AS asked, count(DISTINCT CASE WHEN l_quantity <= 25 AND l_linenumber <= 1 THEN l_orderkey END) AS hits FROM lineitem GROUP BY ALL)
SELECT method, asked, hits, hits / asked AS rate, hits / asked >= 0.95 AND asked >= 10 AS saturated FROM x""")
def g4_saturation(spark: SparkSession, d: str) -> DataFrame:
    return gates.saturation(_outcomes(spark, d)[1])


_STOP = ", ".join(f"'{w}'" for w in vocab.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]'), lambda t: t NOT IN ({_STOP}))"


@query(f"""WITH t AS (SELECT item_id, list_distinct({_TOKENS}) AS ts FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.ts, b.ts)) AS i, len(a.ts) + len(b.ts) AS n FROM t a JOIN t b ON a.item_id < b.item_id)
SELECT a, b, round(i / (n - i), 6) AS jaccard FROM p WHERE i / (n - i) >= 0.3""")
def g5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.lit("one").alias("system"), F.col("item_id").alias("case_id"), F.col("text").alias("query"))
    return gates.similar_texts(items, 0.3).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""WITH c AS ({CASES}), p AS (SELECT a.case_id AS a, b.case_id AS b, (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (greatest(a.hi, b.hi) - least(a.lo, b.lo)) AS iou FROM c a JOIN c b ON a.system = b.system AND a.case_id < b.case_id AND least(a.hi, b.hi) > greatest(a.lo, b.lo))
SELECT a, b, round(iou, 6) AS iou FROM p WHERE iou >= 0.5""")
def g5_window_iou(spark: SparkSession, d: str) -> DataFrame:
    return gates.overlapping_windows(cases(spark, d), 0.5).withColumn("iou", F.round("iou", 6))


_PII = " OR ".join(f"regexp_matches(text, '{p}')" for p in vocab.SENSITIVE)


@query(f"SELECT doc_id FROM documents WHERE {_PII}")
def g5_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(text.sensitive(F.col("text"))).select("doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM benchmark)
SELECT doc_id, count(*) AS n_lines FROM l SEMI JOIN b USING (line) WHERE length(line) >= 40 GROUP BY doc_id""")
def g5_contamination(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 40)
    public = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.join(public, "line", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"""WITH k AS (SELECT case_id, concat_ws('|', system, fault_type, inject_time, root_entity_id, window_start, window_end) AS t FROM ({CASES}))
SELECT case_id, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS fingerprint FROM k""")
def case_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("case_id", gates.fingerprint("system", "fault_type", "inject_time", "root_entity_id", "window_start", "window_end").alias("fingerprint"))


@query("""WITH k AS (SELECT user_id, unnest(['metric', 'log', 'trace', 'event', 'alert', 'profile']) AS kind FROM (SELECT DISTINCT user_id FROM events)),
h AS (SELECT k.user_id, k.kind, coalesce(bool_or(CASE event_type WHEN 'view' THEN 'metric' WHEN 'click' THEN 'log' WHEN 'purchase' THEN 'trace' WHEN 'error' THEN 'event' WHEN 'signup' THEN 'alert' END = k.kind AND value > 250), false) AS has FROM k LEFT JOIN events e ON e.user_id = k.user_id GROUP BY ALL)
SELECT kind, round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6) AS share FROM h GROUP BY kind""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for p in (("view", "metric"), ("click", "log"), ("purchase", "trace"), ("error", "event"), ("signup", "alert")) for x in p])
    e = table(spark, d, "events").select(F.col("user_id").alias("case_id"), kinds[F.col("event_type")].alias("signal"), "value")
    by_kind, _ = scoring.coverage(e.select("case_id").distinct(), e.where("value > 250"), vocab.KIND_WEIGHTS, vocab.TARGET_KINDS)
    return by_kind.select("kind", F.round("share", 6).alias("share"))


_NAMES = ["signup", "purchase", "error", "view", "click"]


@query("SELECT 'svc-' || (user_id % 10) AS service, epoch_us(ts) // 1000000 AS time, " + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{n}') AS {n}" for n in _NAMES) + " FROM events GROUP BY 1, 2")
def wide_metrics(spark: SparkSession, d: str) -> DataFrame:
    return reshape.wide(signals(spark, d), F.col("name"), _NAMES, "service")


@query("SELECT o_orderkey, 'totalprice' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'custkey', CAST(o_custkey AS DOUBLE) FROM orders")
def long_metrics(spark: SparkSession, d: str) -> DataFrame:
    return reshape.long(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("totalprice"), F.col("o_custkey").alias("custkey")), "o_orderkey")


@query("""WITH r AS (SELECT 'svc-' || (user_id % 10) AS service, epoch_us(ts) // 3600000000 * 3600000 AS b, CASE WHEN event_type <> 'view' THEN event_type END AS c FROM events),
s AS (SELECT service, min(b) AS lo, max(b) AS hi FROM r GROUP BY service), k AS (SELECT DISTINCT service, c FROM r WHERE c IS NOT NULL), g AS (SELECT service, c, unnest(generate_series(lo, hi, 3600000)) AS b FROM k JOIN s USING (service))
SELECT g.service, g.b AS bucket_ms, g.c AS cluster, count(r.b) AS n FROM g LEFT JOIN r ON r.service = g.service AND r.b = g.b AND r.c = g.c GROUP BY ALL""")
def log_grid(spark: SparkSession, d: str) -> DataFrame:
    return reshape.log_grid(signals(spark, d), F.when(F.col("name") != "view", F.col("name")), 3600, "service")


@query("""WITH b AS (SELECT event_id, to_timestamp((epoch_us(ts) + 28800000000) // 1800000000 * 1800) AT TIME ZONE 'UTC' AS s FROM events)
SELECT event_id, strftime(s, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(s + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS period FROM b""")
def occurrence_window(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).select(F.col("signal_idx").alias("event_id"), times.period(F.col("ts_ms")).alias("period"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[",\\n]') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || CASE WHEN regexp_matches(p_type || ', "' || p_brand || '"', '[",\\n]') THEN '"' || replace(p_type || ', "' || p_brand || '"', '"', '""') || '"' END || ',' || p_size AS line FROM part""")
def metric_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"'))
    return table(spark, d, "part").select("p_partkey", text.csv_line(F.col("p_name"), quoted, F.col("p_size").cast("string")).alias("line"))


@query("""WITH f AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'new/' ELSE '' END || doc_id AS path, text AS content FROM documents), m AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old/' ELSE '' END || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents)
SELECT coalesce(m.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN h = sha256(content) THEN 'match' ELSE 'mismatch' END AS verdict FROM m FULL JOIN f USING (path)""")
def checksum_diff(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files, against a manifest in which some have other names and some other contents."""
    docs = table(spark, d, "documents")
    path = lambda n, folder: F.concat(F.when(F.col("doc_id") % n == 0, folder).otherwise(""), F.col("doc_id").cast("string")).alias("path")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return compare.verify(compare.checksums(docs.select(path(3, "old/"), changed.alias("content"))), docs.select(path(5, "new/"), F.col("text").alias("content")))


@query("""WITH l AS (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS q, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL), r AS (SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS q, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL)
SELECT coalesce(l.f, r.f) AS l_returnflag, coalesce(l.s, r.s) AS l_linestatus, coalesce(l.q, r.q) AS l_quantity, coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n FROM l FULL JOIN r ON l.f = r.f AND l.s = r.s AND l.q = r.q WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""")
def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return compare.multiset_difference(li.where("l_linenumber % 2 = 0"), li.where("l_linenumber % 2 = 1"), "l_returnflag", "l_linestatus", "l_quantity")


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """For each order: its parts by price as the ranking, the part of the largest quantity as the truth."""
    li = table(spark, d, "lineitem")
    ranks = F.transform(F.sort_array(F.collect_list(F.struct(-F.col("l_extendedprice"), "l_linenumber"))), lambda x: x["l_linenumber"])
    return li.groupBy("l_orderkey").agg(ranks.alias("ranks"), F.max_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("truth"))


_RANKS = """r AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber) AS ranks, last(l_linenumber ORDER BY l_quantity, l_linenumber) AS truth FROM lineitem GROUP BY ALL),
 j AS (SELECT r.*, o_orderpriority FROM r JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"WITH {_RANKS}, a AS (SELECT o_orderpriority, count(*) AS n, " + ", ".join(f"avg(CASE WHEN list_position(ranks, truth) BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END) AS a{k}" for k in range(1, 6)) + " FROM j GROUP BY ALL) SELECT o_orderpriority, n, " + ", ".join(f"round(a{k}, 6) AS ac_{k}" for k in range(1, 6)) + ", round((a1 + a2 + a3 + a4 + a5) / 5, 6) AS avg_5 FROM a")
def ac_at_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _rankings(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    out = scoring.accuracy_at(rows, "ranks", "truth", 5, "o_orderpriority")
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in (*[f"ac_{k}" for k in range(1, 6)], "avg_5")])


@query("""WITH x AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 0) AS a, list(DISTINCT l_returnflag) FILTER (l_linenumber % 2 = 1) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CASE WHEN coalesce(len(a), 0) + coalesce(len(b), 0) > 0 THEN round(2.0 * len(list_intersect(coalesce(a, []), coalesce(b, []))) / (coalesce(len(a), 0) + coalesce(len(b), 0)), 6) END AS f1 FROM x""")
def set_f1(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(even, F.col("l_returnflag"))).alias("a"), F.collect_set(F.when(~even, F.col("l_returnflag"))).alias("b"))
    return x.select("l_orderkey", F.round(compare.set_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_custkey % 2 = 0 THEN 0.4 ELSE 0.0 END AS e, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 3) / 2.0 END AS f, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 7) / 6.0 END AS p FROM orders),
w AS (SELECT *, CASE WHEN e IS NULL THEN 0 ELSE 0.4 END + CASE WHEN f IS NULL THEN 0 ELSE 0.3 END + CASE WHEN p IS NULL THEN 0 ELSE 0.3 END AS w FROM t)
SELECT o_orderkey, CASE WHEN w > 0 THEN round(CAST((coalesce(e, 0) * 0.4 + coalesce(f, 0) * 0.3 + coalesce(p, 0) * 0.3) / w AS DOUBLE), 5) END AS score FROM w""")
def final_a(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    entity = scoring.entity_term(F.col("o_orderstatus"), F.when(F.col("o_orderstatus") != "P", F.lit("F")), F.col("o_custkey") % 2 == 0)
    return o.select("o_orderkey", F.round(scoring.final_a(entity, F.when(k % 4 != 0, (k % 3) / 2.0), F.when(k % 5 != 0, (k % 7) / 6.0)), 5).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, round(0.4 * CAST(l_returnflag = 'R' AS DOUBLE) + 0.4 * CAST(l_linestatus = 'F' AS DOUBLE) + 0.1 * l_discount + 0.1 * CASE WHEN l_returnflag = 'R' THEN least(1.0, exp(-(l_quantity - 5) / 5.0)) ELSE 0.0 END, 6) AS score FROM lineitem""")
def final_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.final_b(F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.col("l_discount"), F.col("l_quantity")), 6).alias("score"))


@query("SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS cases FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def census(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.census(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "cases")


@query("""WITH x AS (SELECT lang, CASE WHEN d.doc_id % 6 <> 0 THEN CAST(length(text) > 500 AS INT) END AS p, quality, toxic, CAST(d.doc_id % 2 AS INT) AS q FROM documents d LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS n, round(avg(CAST(p = quality AS INT)) FILTER (p IS NOT NULL AND quality IS NOT NULL), 6) AS quality_graded, round(avg(CAST(coalesce(p = quality, false) AS INT)) FILTER (quality IS NOT NULL), 6) AS quality_overall,
round(avg(CAST(q = toxic AS INT)) FILTER (toxic IS NOT NULL), 6) AS toxic_graded, round(avg(CAST(q = toxic AS INT)) FILTER (toxic IS NOT NULL), 6) AS toxic_overall FROM x GROUP BY lang""")
def extraction_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    long = F.when(F.col("doc_id") % 6 != 0, (F.length("text") > 500).cast("int"))
    out = scoring.rates(rows, {"quality": (long, F.col("quality")), "toxic": ((F.col("doc_id") % 2).cast("int"), F.col("toxic"))}, "lang")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    later = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", "text", later.alias("answer")).where("answer IS NOT NULL AND text IS NOT NULL")


_TURNS = "t AS (SELECT * FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE answer IS NOT NULL AND text IS NOT NULL)"


@query(f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS a, list_distinct({_TOKENS.replace("(text)", "(answer)")}) AS b FROM t)
SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) END AS dice FROM k""")
def token_dice(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.round(text.dice(text.task_tokens(F.col("text")), text.task_tokens(F.col("answer"))), 6).alias("dice"))


@query(f"""WITH {_TURNS}, g AS (SELECT conv_id, turn, 'a' AS s, substr(lower(text), i, 3) AS g FROM (SELECT *, unnest(generate_series(1, length(text) - 2)) AS i FROM t) UNION ALL SELECT conv_id, turn, 'b', substr(lower(answer), i, 3) FROM (SELECT *, unnest(generate_series(1, length(answer) - 2)) AS i FROM t)),
c AS (SELECT conv_id, turn, g, count(*) FILTER (s = 'a') AS x, count(*) FILTER (s = 'b') AS y FROM g GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN sum(x * x) = 0 OR sum(y * y) = 0 THEN 0.0 ELSE round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) END AS cosine FROM c GROUP BY ALL""")
def ngram_cosine(spark: SparkSession, d: str) -> DataFrame:
    return text.gram_cosines(_turns(spark, d), ["conv_id", "turn"], "text", "answer", 3, "cosine")


def _category_sql() -> str:
    def pattern(k: str) -> str:
        return "|".join([k] + ([k + "s", k + "es"] if len(k) >= 4 else []) + ([k + ".*"] if len(k) >= 5 else []) + [f"(mis|non|un){k}.*"])

    whens = " ".join(f"WHEN len(list_filter(string_split(slug, '-'), lambda t: regexp_full_match(t, '{'|'.join(pattern(k) for k in ks)}'))) > 0 THEN '{c}'" for c, ks in vocab.CATEGORY_KEYWORDS)
    return f"CASE {whens} ELSE 'unknown' END"


_SLUG = "regexp_replace(regexp_replace(lower(trim({})), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g')"


@query(f"WITH x AS (SELECT p_partkey, {_SLUG.format('p_type')} AS slug FROM part UNION ALL SELECT -event_id, {_SLUG.format(chr(39) + 'pod ' + chr(39) + ' || event_type')} FROM events) SELECT p_partkey AS id, slug, {_category_sql()} AS category FROM x")
def category_inference(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("t")).unionByName(table(spark, d, "events").select((-F.col("event_id")).alias("id"), F.concat(F.lit("pod "), "event_type").alias("t")))
    return rows.select("id", text.fault_type(F.col("t")).alias("slug")).withColumn("category", text.category(F.col("slug")))


@query("""SELECT event_id, CASE upper(event_type) WHEN 'ERROR' THEN 'ERROR' END AS severity, CASE WHEN user_id % 2 = 0 THEN 'WARN' END AS folded FROM events""")
def severity_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.severity(F.col("event_type")).alias("severity"), text.severity(F.when(F.col("user_id") % 2 == 0, "Warning").otherwise("loud")).alias("folded"))


@query("SELECT p_partkey, round(p_retailprice / 1024, 6) AS kib, least(greatest(p_retailprice, 0), 100) AS percent, floor(p_retailprice + 0.5) AS whole FROM part")
def unit_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(units.convert(v, "By", "KiBy"), 6).alias("kib"), units.clamp(v, F.lit("%")).alias("percent"), units.quantize(v, F.lit("count")).alias("whole"))


@query(f"""WITH s AS ({SIGNALS}), c AS (SELECT DISTINCT case_id FROM s), w AS (SELECT DISTINCT case_id FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY case_id, service, name ORDER BY signal_idx) AS b FROM s) WHERE b > ts_ms)
SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM w) THEN 'rejected' ELSE 'admitted' END AS status FROM c""")
def gate_status(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d)
    broken = gates.non_monotonic(s).select("case_id").distinct()
    told = gates._violations(broken, "G2", "NON_MONOTONIC_TIMESTAMP", "a series goes back in time", "signals")
    return gates.status(s.select("case_id").distinct(), told)
