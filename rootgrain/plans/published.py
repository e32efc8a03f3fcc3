"""Registered queries of published tables and answers: comparison, scoring, labels, coverage, latency columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, units
from ..operators import graph, pools, published, samples, sli
from ..operators.published import Planned
from ..sources import answers
from . import documents, exports, structure
from .queries import query
from .views import INJECT_MS, SIGNALS, signals, table
from .views import graph as graph_view

_PLAN = [Planned("ts", "truncated", unit="ns"), Planned("level", "normalised", transform="upper-case"), Planned("status"), Planned("minute", "derived", source="ts"), Planned("note", "not-carried")]


@query(f"""WITH o AS (SELECT o_orderkey AS k, {INJECT_MS} * 1000000 + o_orderkey * 1234567 AS ns, o_orderpriority AS level, o_orderstatus AS status FROM orders),
b AS (SELECT *, ns - ns % 1000000 AS ts, CASE WHEN k % 3 = 0 THEN lower(level) ELSE level END AS told, CASE WHEN k % 7 = 0 THEN 'X' ELSE status END AS put, strftime(make_timestamp((ns // 1000000) * 1000), '%H:%M') AS hm FROM o),
p AS (SELECT ts, upper(told) AS level, status FROM b), e AS (SELECT ts, level, put AS status FROM b)
SELECT 'ts' AS "column", 'truncated' AS kind, 0::BIGINT AS differ, count(*) FILTER (ns <> ts) AS lossy FROM b
UNION ALL SELECT 'level', 'normalised', (SELECT count(*) FROM (SELECT level FROM p EXCEPT ALL SELECT level FROM e)), count(*) FILTER (told <> upper(told)) FROM b
UNION ALL SELECT 'status', 'exact', greatest((SELECT count(*) FROM (SELECT status FROM p EXCEPT ALL SELECT status FROM e)), (SELECT count(*) FROM (SELECT status FROM e EXCEPT ALL SELECT status FROM p))), 0
UNION ALL SELECT 'minute', 'derived', count(*) FILTER (k % 11 = 0), count(*) FILTER (k % 13 = 0 AND hm <> '00:00') FROM b
UNION ALL SELECT 'note', 'not-carried', count(*) FILTER (k % 17 = 0), count(*) FILTER (k % 5 = 0) FROM b
UNION ALL SELECT NULL, 'rows', (SELECT count(*) FROM (FROM p EXCEPT ALL FROM e)), (SELECT count(*) FROM (FROM e EXCEPT ALL FROM p))""")
def published_columns(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a published table, and as an exported one with other states, minutes and notes."""
    k = F.col("o_orderkey")
    ns = F.lit(INJECT_MS) * 1_000_000 + k * 1_234_567
    minute = published.minute(ns.cast("string"), "ns")
    orders = table(spark, d, "orders")
    level, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    theirs = orders.select(k.alias("line"), ns.cast("string").alias("ts"), F.when(k % 3 == 0, F.lower(level)).otherwise(level).alias("level"), status.alias("status"), F.when(k % 13 == 0, "00:00").otherwise(minute).alias("minute"), F.when(k % 5 == 0, "x").alias("note"))
    ours = orders.select(k.alias("line"), (ns - ns % 1_000_000).cast("string").alias("ts"), level.alias("level"), F.when(k % 7 == 0, "X").otherwise(status).alias("status"), F.when(k % 11 != 0, minute).alias("minute"), F.when(k % 17 == 0, "y").alias("note"))
    return published.compare(theirs, ours, _PLAN).drop("absent")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AS a, c_custkey % 3 <> 0 AS has_r, c_nationkey < 7 AS r, c_custkey % 4 <> 0 AS has_t, abs(c_custkey % 50 - 90) <= 60 AS t FROM customer)
SELECT 'shop-' || (k // 100) AS folder, 'case-' || k AS case_id, CASE WHEN k % 50 = 0 THEN 0 ELSE round((a::INT + (has_r AND r)::INT + (has_t AND t)::INT) / (1.0 + has_r::INT + has_t::INT), 6) END AS score FROM c""")
def published_scores(spark: SparkSession, d: str) -> DataFrame:
    """Files of truths and predictions of 100 customers each, read back and scored; every 50th prediction
    has a root too many."""
    k = F.col("c_custkey")
    clock = lambda second: F.concat(F.lit("2024-01-16 00:00:"), F.lpad(second.cast("string"), 2, "0"))
    time, reason = F.when(k % 4 != 0, clock(k % 50)), F.when(k % 3 != 0, F.concat(F.lit("r"), F.col("c_nationkey").cast("string")))
    truth = text.csv_line(answers.task(time, F.col("c_mktsegment"), reason), F.lit("Which component?"), answers.points_text(time, F.col("c_mktsegment"), reason))
    root = F.struct(F.when(k % 5 == 0, "none").otherwise(F.col("c_mktsegment")).alias("root cause component"), F.concat(F.lit("r"), (F.col("c_nationkey") % 7).cast("string")).alias("root cause reason"), F.lit("2024-01-16 00:01:30").alias("root cause occurrence datetime"))
    predicted = F.when(k % 50 == 0, F.to_json(F.struct(root.alias("1"), root.alias("2")))).when(k % 2 == 0, F.to_json(F.struct(root.alias("1")))).otherwise(F.to_json(root))
    record = text.csv_line(F.concat(F.lit("case-"), k.cast("string")), predicted)
    rows = table(spark, d, "customer").select(F.concat(F.lit("shop-"), F.floor(k / 100).cast("string")).alias("folder"), k.alias("k"), truth.alias("truth"), record.alias("record"))
    lines = rows.select("folder", "k", F.explode(F.array(F.struct(F.lit("groundtruth.csv").alias("name"), F.lit("task_index,instruction,scoring_points").alias("head"), F.col("truth").alias("line")), F.struct(F.lit("record.csv").alias("name"), F.lit("instruction_id,prediction").alias("head"), F.col("record").alias("line")))).alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("f.line").alias("l")))), lambda x: x["l"])
    files = lines.groupBy("folder", "f.name", "f.head").agg(F.array_join(ordered, "\n").alias("body")).select(F.concat_ws("/", "folder", "name").alias("path"), F.concat_ws("\n", "head", "body").alias("content"))
    return answers.root_scores(files).select("folder", "case_id", F.round("score", 6).alias("score"))


@query("""WITH p AS (SELECT p_partkey, 'RE' || (p_partkey % 5) || '-shop/' || CASE p_partkey % 4 WHEN 0 THEN 'cart' WHEN 1 THEN 'cart_f_1' WHEN 2 THEN '_cpu' ELSE 'cart_' || p_size END || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '/' || p_size END AS path FROM part),
m AS (SELECT *, p_partkey % 5 BETWEEN 1 AND 3 AND p_partkey % 4 IN (1, 3) AND p_partkey % 7 <> 0 AS ok FROM p)
SELECT p_partkey, CASE WHEN ok THEN split_part(path, '-', 1) END AS suite, CASE WHEN ok THEN regexp_extract(path, '/cart_([^/]+)', 1) END AS fault,
 CASE WHEN p_partkey % 7 = 0 THEN 'shape' WHEN p_partkey % 4 IN (0, 1) THEN 'unpack' END AS refused FROM m""")
def case_labels(spark: SparkSession, d: str) -> DataFrame:
    """What folder names say of cases, as a path is parsed and as a loader unpacks it."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    label = F.when(k % 4 == 0, "cart").when(k % 4 == 1, "cart_f_1").when(k % 4 == 2, "_cpu").otherwise(F.concat(F.lit("cart_"), size))
    path = F.concat(F.lit("RE"), (k % 5).cast("string"), F.lit("-shop/"), label, F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("/"), size)))
    return table(spark, d, "part").select(k, answers.case_path(path).alias("c"), answers.loader_label(path).alias("l")).select("p_partkey", F.col("c.suite").alias("suite"), F.col("c.fault").alias("fault"), F.col("l.fault_kind").alias("refused"))


@query("""WITH n AS (SELECT o_custkey AS sample_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT sample_id, 'duplicate' AS code, n FROM n WHERE n > 1 UNION ALL SELECT c_custkey, 'missing', 0 FROM customer WHERE c_custkey NOT IN (SELECT sample_id FROM n) AND (SELECT count(*) FROM orders) >= (SELECT count(*) FROM customer)""")
def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases that annotate customers."""
    entries = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("sample_id"))
    return samples.coverage_issues(entries, table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")))


@query("""WITH a AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS type FROM part), b AS (SELECT DISTINCT unnest(string_split(lower(p_type || ' ' || p_brand), ' ')) AS type FROM part)
SELECT type, 'unlabelled' AS code FROM (FROM a EXCEPT FROM b) UNION ALL SELECT type, 'unoffered' FROM (FROM b EXCEPT FROM a)""")
def vocabulary_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Words of the names of parts as a vocabulary, those of their types and brands as labels."""
    words = lambda *c: table(spark, d, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", *c)), " ")).alias("type"))
    return samples.vocabulary_issues(words("p_name"), words("p_type", "p_brand"))


_VERDICTS = """v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'unparseable' WHEN p_partkey % 7 = 0 THEN 'unvalidated' WHEN p_partkey % 2 = 1 AND p_partkey % 13 = 0 THEN 'unverifiable' ELSE 'graded' END AS state FROM part),
g AS (SELECT k, state, CASE WHEN state = 'graded' THEN k % 3 <> 0 END AS type, CASE WHEN state = 'graded' AND k % 4 <> 0 THEN k % 5 <> 0 END AS category, CASE WHEN state = 'graded' THEN k % 6 <> 0 END AS component, NULL::BOOLEAN AS description FROM v)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("sample_id")
    expected = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), "p_type", "p_brand", F.lower("p_name").alias("name"))
    told = table(spark, d, "part").select(
        F.col("p_partkey").alias("sample_id"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), F.translate(F.lower("p_type"), " ", "_"))).otherwise(F.concat("p_type", F.lit("x"))).alias("type"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("category"), F.when(F.col("p_partkey") % 6 != 0, F.upper("p_name")).otherwise("other").alias("component"),
    )
    want = {"type": F.col("p_type"), "category": F.when(k % 4 != 0, F.col("p_brand")), "component": F.col("name"), "description": F.lit(None).cast("string")}
    got = {f: F.col(f) for f in ("type", "category", "component")} | {"description": F.col("component")}
    verdict = samples.verdict(want, got, k % 11 != 0, k % 7 != 0, F.when(k % 2 == 1, k % 13 != 0))
    return samples.pair(expected, told).select(k, verdict.alias("v")).select("sample_id", "v.*")


@query(f"WITH {_VERDICTS} SELECT k AS sample_id, state, type, category, component, description FROM g")
def sample_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as samples, and predictions that miss some of their fields."""
    return _verdicts(spark, d)


@query(f"""WITH {_VERDICTS}, m AS (SELECT l_partkey, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL),
f AS (SELECT 'type' AS field, 0 AS i, count(*) FILTER (type) AS hits, count(type) AS total FROM g UNION ALL SELECT 'category', 1, count(*) FILTER (category), count(category) FROM g UNION ALL SELECT 'component', 2, count(*) FILTER (component), count(component) FROM g)
SELECT (SELECT count(*) FROM m WHERE ok) AS recoverable_samples, (SELECT count(*) FROM m WHERE NOT ok) AS blocked_samples, field, hits, total FROM f WHERE total > 0 ORDER BY hits, i LIMIT 1""")
def binding_field(spark: SparkSession, d: str) -> DataFrame:
    """The field with the fewest hits beside the samples that their misses block, returned lines being other faults."""
    misses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("sample_id"), F.when(F.col("l_returnflag") == "R", "different-fault").otherwise("undecided").alias("verdict"))
    return samples.binding_field(_verdicts(spark, d), misses)


@query(f"""WITH c AS (SELECT 'case-' || c_custkey AS case_id, c_custkey % 8 AS kind, 'svc-' || (c_custkey % 10) AS service FROM customer), s AS (SELECT DISTINCT case_id, service, name FROM ({SIGNALS})),
f AS (SELECT c.*, CASE kind WHEN 3 THEN 'view' WHEN 4 THEN 'click' ELSE 'none' END AS metric, CASE kind WHEN 0 THEN 'absent' WHEN 1 THEN 'vague' WHEN 5 THEN 'foreign' WHEN 7 THEN 'unreadable' END AS fault FROM c),
r AS (SELECT f.case_id, coalesce(fault, CASE WHEN kind IN (3, 4, 6) AND s.name IS NULL THEN 'unresolved' WHEN kind = 4 THEN 'notDuration' END) AS fault, kind, f.service, metric FROM f LEFT JOIN s ON s.case_id = f.case_id AND s.service = f.service AND s.name = metric)
SELECT case_id, fault, CASE WHEN fault IS NULL AND kind = 3 THEN service || '_' || metric END AS source, CASE WHEN fault IS NULL AND kind = 3 THEN service || '_latency' END AS target FROM r""")
def sli_columns(spark: SparkSession, d: str) -> DataFrame:
    """Customers' cases with declarations of all kinds, beside the events of their services."""
    k = F.col("c_custkey")
    service = F.concat(F.lit("svc-"), (k % 10).cast("string"))
    named = lambda s, metric: F.to_json(F.struct(s.alias("service"), F.lit(metric).alias("metric")))
    told = F.when(k % 8 == 1, '{"none": "no latency"}').when(k % 8 == 2, '{"none": "No service of this case has a latency that could rank it."}').when(k % 8 == 3, named(service, "view")).when(k % 8 == 4, named(service, "click")).when(k % 8 == 5, named(F.lit("svc-99"), "view")).when(k % 8 == 6, named(service, "none")).when(k % 8 == 7, '["service"]')
    cases = table(spark, d, "customer").select(F.concat(F.lit("case-"), k.cast("string")).alias("case_id"), service.alias("component"), told.alias("sli"))
    unit = F.when(F.col("name") == "view", "ms").when(F.col("name") == "click", "%")
    return sli.resolve(cases, signals(spark, d).withColumn("unit", unit))


@query(f"""WITH s AS (SELECT DISTINCT case_id, service, name FROM ({SIGNALS})), h AS (SELECT case_id, CASE WHEN name = 'view' THEN service || '-db' ELSE service END || '_' || name AS head FROM s),
n AS (SELECT case_id, split_part(head, '_', 1) AS name FROM h), e AS (SELECT 'svc-' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'service' ELSE 'db' END AS kind FROM nation WHERE n_nationkey < 8)
SELECT case_id, replace(n.name, '-db', '') AS candidate, kind, count(*) AS heads, bool_or(ends_with(n.name, '-db')) AS rewritten FROM n LEFT JOIN e ON e.name = replace(n.name, '-db', '') GROUP BY ALL""")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the events' cases, views being of databases, and nations as entities."""
    head = F.concat_ws("_", F.when(F.col("name") == "view", F.concat("service", F.lit("-db"))).otherwise(F.col("service")), "name")
    own = signals(spark, d).select("case_id", "service", "name").distinct().select("case_id", head.alias("head"))
    times = spark.createDataFrame([("time",)], "head string").select(F.lit("case-0").alias("case_id"), "head")
    n = F.col("n_nationkey")
    entities = table(spark, d, "nation").where(n < 8).select(F.concat(F.lit("svc-"), n.cast("string")).alias("name"), F.when(n % 2 == 0, "service").otherwise("db").alias("kind"))
    return pools.pool(own.unionByName(times), entities, "case_id")


@query(f"""SELECT case_id, count(*) FILTER (ts_ms < {INJECT_MS}) AS rows, min(ts_ms)::DOUBLE AS earliest, max(ts_ms)::DOUBLE AS latest FROM ({SIGNALS}) GROUP BY ALL""")
def baseline_windows(spark: SparkSession, d: str) -> DataFrame:
    """Instants before the injection in each case of the events."""
    return pools.baseline_window(signals(spark, d), F.col("ts_ms").cast("double"), F.lit(float(INJECT_MS)), "case_id")


@query("""SELECT 'case-' || o_orderkey AS case_id, 'cp' AS checkpoint_id, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN_AUTHOR' ELSE 'FOREIGN_AUTHOR' END AS code FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderkey % 5 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 = 0)""")
def foreign_logs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases whose checkpoint is their customer, and a log line of the customer, of its nation,
    of a region, or of nobody."""
    entities, edges = graph_view(spark, d)
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    case, own = F.concat(F.lit("case-"), k.cast("string")), F.concat(F.lit("external:/"), F.col("c_custkey").cast("string"))
    author = F.when(k % 5 == 0, "nobody").when((k % 3 == 0) & (k % 4 == 0), F.lit("service:/0")).when(k % 3 == 0, F.concat(F.lit("node:/"), F.col("c_nationkey").cast("string"))).otherwise(own)
    checkpoints = rows.select(case.alias("case_id"), F.lit("cp").alias("checkpoint_id"), own.alias("entity_ref"), F.lit("l").alias("signal_ref"))
    lines = rows.select(case.alias("case_id"), F.lit("l").alias("log_id"), author.alias("service"))
    return graph.foreign_logs(checkpoints, lines, entities, edges)


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity / 3 * 3 - l_quantity) <= 1e-9 * greatest(abs(l_quantity), 1) AS eq, NOT abs(l_extendedprice * l_discount - 1000) <= 1e-9 * greatest(abs(l_extendedprice * l_discount), 1000) AND l_extendedprice * l_discount > 1000 AS gt FROM lineitem""")
def tolerant_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Quantities that come back from a division, and discounts beyond a threshold."""
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", units.holds("==", q / 3 * 3, q).alias("eq"), units.holds(">", F.col("l_extendedprice") * F.col("l_discount"), F.lit(1000.0)).alias("gt"))


@query(f"""WITH c AS (SELECT 'case-' || c_custkey AS case_id, c_custkey % 10 = 3 AS leaks FROM customer), k AS (SELECT DISTINCT case_id FROM ({SIGNALS})), n AS (SELECT count(*) AS n, count(*) FILTER (leaks) AS n_leaks FROM c JOIN k USING (case_id)),
t AS (SELECT unnest(['query-csv', 'record-csv', 'query-header', 'record-header', 'answer-key-isolated', 'telemetry-present', 'metric-header', 'groundtruth-csv', 'groundtruth-header', 'scoring-points-present']) AS "check")
SELECT "check", n > 0 AS passed FROM t, n UNION ALL SELECT 'log-header', true UNION ALL SELECT 'trace-header', true UNION ALL SELECT 'row-alignment', true UNION ALL SELECT 'task-carries-no-scored-value', n_leaks = 0 FROM n""")
def exported_structure(spark: SparkSession, d: str) -> DataFrame:
    """The exported files of the events' cases; every tenth task names the component that is its answer."""
    cases, own = documents._bundle(spark, d)
    asked = cases.withColumn("query", F.when(F.col("case_ord") % 10 == 3, F.col("component")).otherwise(F.col("query")))
    return structure.openrca(exports.openrca_telemetry(asked, own).unionByName(exports.openrca_answers(asked, own)))
