"""Registered queries of sources, exports, grading and streams, over documents made of the driver's tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import CATEGORY_KEYWORDS
from ..operators import grading, misses
from ..operators.scoring import time_matches
from ..sources import backends, delimited, otlp
from ..sources import signals as records
from ..sources.shared import fresh_path
from ..streaming import telemetry
from . import exports
from .queries import query
from .views import CASES, INJECT_MS, SIGNALS, cases, signals, spans, table


def _document(rows: DataFrame, path: Column, order: str, line: Column, joined: str = "\n") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(path.alias("path")).agg(F.array_join(ordered, joined).alias("content"))


@query("SELECT p_partkey, p_name, p_type || ', \"' || p_brand || '\"' || chr(10) || p_name AS quoted FROM part")
def csv_dialect(spark: SparkSession, d: str) -> DataFrame:
    """Tables with quotes, commas and line feeds in cells, read back to their rows."""
    quoted = F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"\n'), "p_name")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", text.csv_line(F.col("p_partkey").cast("string"), F.col("p_name"), quoted).alias("line"))
    files = _document(parts, F.col("p_brand"), "p_partkey", F.col("line")).select("path", F.concat(F.lit("p_partkey,p_name,quoted\r\n"), "content").alias("content"))
    read = delimited.records(delimited.rows(files))
    return read.select(F.col("record")["p_partkey"].cast("long").alias("p_partkey"), F.col("record")["p_name"].alias("p_name"), F.col("record")["quoted"].alias("quoted"))


_BROKEN = "CASE WHEN event_id % 17 = 0 THEN 'malformed JSON' WHEN event_id % 19 = 0 THEN 'not a JSON object' END"


@query(f"SELECT 'user-' || (user_id % 20) AS path, coalesce({_BROKEN}, 'ok') AS outcome, count(*) AS n, sum(CASE WHEN {_BROKEN} IS NULL THEN event_id ELSE 0 END)::BIGINT AS ids FROM events GROUP BY ALL")
def json_line_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, some of them broken: records and errors by file."""
    e = table(spark, d, "events")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("{"), whole)).when(F.col("event_id") % 19 == 0, F.concat(F.lit("["), whole, F.lit("]"))).otherwise(whole)
    read = delimited.json_lines(_document(e, F.concat(F.lit("user-"), (F.col("user_id") % 20).cast("string")), "event_id", line))
    return read.groupBy("path", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("record")["event_id"].cast("long"), F.lit(0))).alias("ids"))


@query("""WITH r AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'timestamp cannot be read' WHEN event_id % 11 = 0 THEN 'missing service name' WHEN event_id % 7 = 0 THEN 'metric value ''oops'' is not a finite number' END AS reason FROM events)
SELECT CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN event_id % 5 = 0 THEN 'missing' ELSE 'signal' END AS outcome, coalesce(reason, '') AS reason, count(*) AS n,
 round(sum(CASE WHEN reason IS NULL AND event_id % 5 <> 0 THEN value END), 2) AS total FROM r GROUP BY ALL""")
def ingest_partition(spark: SparkSession, d: str) -> DataFrame:
    """The three-way split of metric records: signals, quarantine by first reason, missing."""
    e, k = table(spark, d, "events"), F.col("event_id")
    shown = F.when(k % 13 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    value = F.when(k % 7 == 0, "oops").when(k % 5 == 0, "NaN").otherwise(F.col("value").cast("string"))
    record = F.create_map(F.lit("Time"), shown, F.lit("svc"), F.when(k % 11 == 0, " ").otherwise("a"), F.lit("kpi-name"), F.col("event_type"), F.lit("Value"), value)
    rows = e.select(F.lit("events").alias("path"), k.alias("line"), record.alias("record"), F.lit(None).cast("string").alias("error"))
    told = records.classify(rows, "metric", records.detect_layout(["Time", "svc", "kpi-name", "Value"], "metric"))
    return told.groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("signal.value"), 2).alias("total"))


@query("""SELECT 'svc-' || (user_id % 10) AS service, event_type AS name, count(*) AS n, sum(epoch_us(ts) // 1000)::BIGINT AS ms, round(sum(value), 2) AS total FROM events WHERE event_id % 9 <> 0 AND event_type <> 'error' GROUP BY ALL""")
def otlp_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric documents, a resource for each user: sums and gauges are read, histograms and points without time are not."""
    e = table(spark, d, "events")
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")
    point = F.struct(F.when(F.col("event_id") % 9 != 0, nanos).alias("timeUnixNano"), F.col("value").alias("asDouble"))
    points = e.groupBy("user_id", "event_type").agg(F.struct(F.collect_list(point).alias("dataPoints")).alias("points"))
    kind = lambda *names: F.when(F.col("event_type").isin(*names), F.col("points"))
    metric = F.struct(F.col("event_type").alias("name"), kind("view", "click").alias("sum"), kind("purchase", "signup").alias("gauge"), kind("error").alias("histogram"))
    service = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")).alias("stringValue")).alias("value")))
    resource = F.struct(F.struct(service.alias("attributes")).alias("resource"), F.array(F.struct(F.collect_list(metric).alias("metrics"))).alias("scopeMetrics"))
    documents = points.groupBy("user_id").agg(F.to_json(F.struct(F.array(resource).alias("resourceMetrics"))).alias("content")).select(F.col("user_id").cast("string").alias("path"), "content")
    found, _ = otlp.metrics(documents)
    return found.groupBy("service", "name").agg(F.count("*").alias("n"), F.sum("ts_ms").alias("ms"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH s AS (SELECT o_orderkey AS t, CAST(o_orderkey AS VARCHAR) AS span, NULL AS parent, 0 AS i FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT l_orderkey, l_orderkey || '-' || l_linenumber, CAST(l_orderkey AS VARCHAR), l_linenumber FROM lineitem)
SELECT CASE WHEN t % 10 = 0 THEN 'span has a negative duration' WHEN t % 7 = 0 THEN 'invalid span status code ''9''' ELSE 'ok' END AS outcome, count(*) AS n, sum(CASE WHEN t % 10 <> 0 AND t % 7 <> 0 THEN i + 1 ELSE 0 END)::BIGINT AS ms FROM s GROUP BY ALL""")
def otlp_traces(spark: SparkSession, d: str) -> DataFrame:
    """Span documents by trace: durations in milliseconds, broken clocks and unknown statuses apart."""
    t, i = F.col("trace_id"), F.coalesce(F.regexp_extract("span_id", "-(.*)$", 1).try_cast("long"), F.lit(0))
    start = F.lit(INJECT_MS) * 1_000_000 + 999_999
    end = F.when(t % 10 == 0, start - 1).otherwise(start + (i + 1) * 1_000_000)
    span = F.struct(t.cast("string").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent").alias("parentSpanId"), F.lit("line").alias("name"), start.cast("string").alias("startTimeUnixNano"), end.cast("string").alias("endTimeUnixNano"), F.struct(F.when(t % 7 == 0, "9").otherwise("STATUS_CODE_OK").alias("code")).alias("status"))
    scope = F.struct(F.array(F.struct(F.collect_list(span).alias("spans"))).alias("scopeSpans"))
    documents = spans(spark, d).groupBy((t % 1000).cast("string").alias("path")).agg(F.to_json(F.struct(F.array(scope).alias("resourceSpans"))).alias("content"))
    told = otlp.judged_traces(documents, service="shop")
    return told.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.coalesce("signal.duration_ms", F.lit(0))).alias("ms"))


@query("SELECT 'svc-' || (user_id % 10) AS service, event_type AS name, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_id % 8 <> 0 GROUP BY ALL")
def prometheus_samples(spark: SparkSession, d: str) -> DataFrame:
    """Matrix answers: a series for each service and metric, samples of NaN apart."""
    e = table(spark, d, "events")
    sample = F.array((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.when(F.col("event_id") % 8 == 0, "NaN").otherwise(F.col("value").cast("string")))
    labels = F.create_map(F.lit("__name__"), F.col("event_type"), F.lit("service"), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")))
    series = e.groupBy("event_type", (F.col("user_id") % 10).alias("user_id")).agg(F.collect_list(sample).alias("values")).select(F.struct(labels.alias("metric"), "values").alias("s"), "user_id")
    answers = series.groupBy("user_id").agg(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("matrix").alias("resultType"), F.collect_list("s").alias("result")).alias("data"))).alias("body"))
    found, _ = backends.prometheus(answers)
    return found.groupBy("service", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_TEXT = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"


def _bundle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events as signals of the first 25 customers' cases."""
    nothing = F.lit(None).cast("string")
    s = signals(spark, d).select("case_id", "signal_idx", "signal", "ts_ms", "service", nothing.alias("pod"), nothing.alias("node"), "name", "value", nothing.alias("severity"), nothing.alias("body"), *[nothing.alias(c) for c in ("trace_id", "span_id", "parent", "status")], F.lit(None).cast("double").alias("duration_ms"))
    c = cases(spark, d).withColumns({"component": F.concat(F.lit("svc-"), (F.col("case_ord") % 10).cast("string")), "reason": F.col("fault_type"), "category": F.lit("resource"), "difficulty": F.concat(F.lit("L"), (F.col("case_ord") % 5).cast("string"))})
    return c, s


@query(f"""WITH s AS ({SIGNALS}), c AS ({CASES}), r AS (SELECT lower(system) AS sys, inject_time, case_id, strftime(make_timestamp((ts_ms + 28800000) * 1000), '%Y-%m-%d %H:%M:%S') AS clock, service, name, {_TEXT} AS v, signal_idx FROM s JOIN c USING (case_id))
SELECT regexp_replace(sys, '[^a-z0-9]+', '-', 'g') || '/' || strftime(CAST(replace(replace(inject_time, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 480 MINUTE, '%Y_%m_%d') || '/telemetry/metric/' || case_id || '.csv' AS path,
 sha256('timestamp,cmdb_id,kpi_name,value' || chr(10) || string_agg(clock || ',' || service || ',' || name || ',' || v, chr(10) ORDER BY clock, signal_idx) || chr(10)) AS digest FROM r GROUP BY 1, case_id""")
def openrca_metric_files(spark: SparkSession, d: str) -> DataFrame:
    c, s = _bundle(spark, d)
    return exports.openrca_telemetry(c, s).select("path", F.sha2("content", 256).alias("digest"))


@query(f"""WITH s AS ({SIGNALS}), c AS (SELECT *, row_number() OVER (ORDER BY case_ord) AS n FROM ({CASES})), k AS (SELECT case_id, 'RE1-' || regexp_replace(lower(system), '[^a-z0-9]+', '-', 'g') || '/svc-' || (case_ord % 10) || '_' || fault_type || '/' || n AS dir, lo FROM c),
p AS (SELECT case_id, ts_ms // 1000 AS t, service || '_' || name AS col, arg_max({_TEXT}, signal_idx) AS v FROM s GROUP BY ALL), cs AS (SELECT DISTINCT case_id, col FROM p), ts AS (SELECT DISTINCT case_id, t FROM p),
l AS (SELECT ts.case_id, ts.t, string_agg(coalesce(v, ''), ',' ORDER BY cs.col) AS cells FROM ts JOIN cs USING (case_id) LEFT JOIN p ON p.case_id = ts.case_id AND p.t = ts.t AND p.col = cs.col GROUP BY ALL),
h AS (SELECT case_id, string_agg(col, ',' ORDER BY col) AS head FROM cs GROUP BY ALL)
SELECT dir || '/data.csv' AS path, sha256('time,' || any_value(head) || chr(10) || string_agg(t || ',' || cells, chr(10) ORDER BY t) || chr(10)) AS digest FROM l JOIN h USING (case_id) JOIN k USING (case_id) GROUP BY dir
UNION ALL SELECT dir || '/inject_time.txt', sha256(((lo + 600000) // 1000) || chr(10)) FROM k WHERE case_id IN (SELECT case_id FROM s)""")
def rcaeval_files(spark: SparkSession, d: str) -> DataFrame:
    c, s = _bundle(spark, d)
    return exports.rcaeval(c, s).select("path", F.sha2("content", 256).alias("digest"))


@query("""WITH o AS (SELECT c_custkey AS k, lower(c_mktsegment) AS f, 'svc-' || (c_custkey % 10) AS s FROM customer)
SELECT 'cloud-opsbench/groundtruth.jsonl' AS path, sha256(string_agg('{"case_id":"case-' || k || '","component":"' || s || '","fault_type":"' || f || '","category":"resource","difficulty":"' || CASE k % 5 WHEN 1 THEN 'easy' WHEN 3 THEN 'hard' WHEN 4 THEN 'hard' ELSE 'medium' END || '"}', chr(10) ORDER BY k) || chr(10)) AS digest FROM o""")
def answer_key_file(spark: SparkSession, d: str) -> DataFrame:
    return exports.answer_keys(_bundle(spark, d)[0], "cloud-opsbench").select("path", F.sha2("content", 256).alias("digest"))


@query(None)
def assigned_roots(spark: SparkSession, d: str) -> DataFrame:
    """The best assignment of the predicted roots (odd lines of an order) to the true ones (even lines).
    SQL has no assignment of any size; the tests hold it against all permutations."""
    root = F.struct(F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("reason"), F.lit(None).cast("string").alias("time"))
    odd = F.col("l_linenumber") % 2 == 1
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(odd, root)).alias("predicted"), F.collect_list(F.when(~odd, root)).alias("truth"))
    return grading.assigned_scores(rows, "predicted", "truth", time_matches).select("l_orderkey", "score")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber % 2 AS side, l_returnflag || '->' || l_linestatus AS e, l_returnflag AS a, l_linestatus AS b FROM lineitem),
g AS (SELECT l_orderkey, coalesce(list(DISTINCT e) FILTER (side = 1), []) AS pe, coalesce(list(DISTINCT e) FILTER (side = 0), []) AS te, coalesce(list_distinct(flatten(list([a, b]) FILTER (side = 1))), []) AS pn, coalesce(list_distinct(flatten(list([a, b]) FILTER (side = 0))), []) AS tn FROM e GROUP BY ALL)
SELECT l_orderkey, round(2.0 * len(list_intersect(pn, tn)) / (len(pn) + len(tn)), 6) AS node_f1, round(2.0 * len(list_intersect(pe, te)) / (len(pe) + len(te)), 6) AS edge_f1,
 CASE WHEN len(te) > 0 THEN (list_contains(pn, 'R') AND len(list_filter(pe, lambda x: starts_with(x, 'R->') AND list_contains(tn, split_part(x, '->', 2)))) > 0)::INT END AS path FROM g""")
def chain_grades(spark: SparkSession, d: str) -> DataFrame:
    """Set F1 of nodes and edges, and reachability from the true root, of chains of flags to statuses."""
    odd, edge = F.col("l_linenumber") % 2 == 1, F.concat("l_returnflag", F.lit("->"), "l_linestatus")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(odd, edge)).alias("chain"), F.collect_set(F.when(~odd, edge)).alias("true_chain"))
    same = F.lit("R")
    told = grading.chain_scores(rows.select("l_orderkey", same.alias("component"), same.alias("fault"), "chain", same.alias("true_component"), same.alias("true_fault"), "true_chain"), "l_orderkey")
    return told.select("l_orderkey", F.round("node_f1", 6).alias("node_f1"), F.round("edge_f1", 6).alias("edge_f1"), "path")


@query("""SELECT c_custkey, ((replace(lower(c_mktsegment), ' ', '') = 'building')::INT + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey % 2 = 0)::INT END) / (1.0 + (c_custkey % 3 <> 0)::INT) AS score FROM customer""")
def folded_grades(spark: SparkSession, d: str) -> DataFrame:
    """Component and kind of fault compared without case and white space; fields that the truth lacks don't count."""
    k = F.col("c_custkey")
    score = grading.folded_equality(F.col("c_mktsegment"), F.when(k % 2 == 0, " CPU ").otherwise("disk"), F.lit("Build ing"), F.when(k % 3 != 0, "c p u"))
    return table(spark, d, "customer").select("c_custkey", score.alias("score"))


_UNINFORMATIVE = ", ".join(f"'{w}'" for w in misses.UNINFORMATIVE)
_SLUG_TOKENS = f"list_filter(regexp_split_to_array(lower({{}}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({_UNINFORMATIVE}))"


@query(f"""WITH p AS (SELECT p_partkey, {_SLUG_TOKENS.format('p_type')} AS a, {_SLUG_TOKENS.format("lead(p_type) OVER (ORDER BY p_partkey)")} AS b, lead(p_type) OVER (ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'undecided' WHEN len(list_intersect(a, b)) > 0 OR len(list_filter(a, lambda t: len(list_filter(b, lambda u: (len(t) >= 3 AND starts_with(u, t)) OR (len(u) >= 3 AND starts_with(t, u)) OR (len(t) >= 5 AND len(u) >= 5 AND left(t, 5) = left(u, 5)))) > 0)) > 0
 THEN 'same-fault-different-altitude' WHEN len(a) = 0 OR len(b) = 0 THEN 'undecided' ELSE 'different-fault' END AS verdict FROM p""")
def miss_adjudication(spark: SparkSession, d: str) -> DataFrame:
    """Names of neighbouring parts as an expected and an actual fault."""
    p = table(spark, d, "part")
    # keys are dense: the next part is found by its key, without a sort of all
    both = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("next")), "p_partkey", "left")
    return both.select("p_partkey", misses.adjudicate(F.col("p_type"), F.col("next"))["verdict"].alias("verdict"))


_DENIES = " OR ".join(f"contains(c, '{w}')" for w in misses.DENIALS)


def _denial_sql(category: str) -> str:
    has = lambda c: " OR ".join(f"contains({c}, '{w}')" for w in dict(CATEGORY_KEYWORDS)[category])
    return f"""CASE WHEN blank THEN 'not-assessable' WHEN NOT ({has('low')}) THEN 'absent' WHEN len(list_filter(parts, lambda c: ({has('c')}) AND NOT ({_DENIES}))) > 0 THEN 'also-asserted' ELSE 'denied-only' END AS {category}"""


@query(f"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, lower(text) AS low FROM documents), p AS (SELECT *, string_split(regexp_replace(low, '([.!?;])\\s+|,\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t)
SELECT doc_id, {_denial_sql('network')}, {_denial_sql('resource')}, {_denial_sql('code')} FROM p""")
def category_denial(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document only denies, asserts or does not mention each category."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *[misses.denial(F.col("text"), c).alias(c) for c in ("network", "resource", "code")])


@query("""SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS period_start, time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE AS period_end, count(*) AS n FROM events GROUP BY ALL""")
def stream_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """30-minute windows of the events by type, counted by a stream that reads the table to its end. Each
    micro-batch tells the windows that it changed, so that the last ones, which no watermark closes,
    count too; the last word on a window holds."""
    path = fresh_path(spark, "stream")
    batch = table(spark, d, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/events.parquet*").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    write = lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    started = telemetry.occurrences(stream, "event_type").writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    told = spark.read.schema("event_type string, period_start timestamp, period_end timestamp, n long, batch long").parquet(f"{path}/out")
    return told.groupBy("event_type", "period_start", "period_end").agg(F.max_by("n", "batch").alias("n")).select("event_type", F.col("period_start").cast("timestamp_ntz").alias("period_start"), F.col("period_end").cast("timestamp_ntz").alias("period_end"), "n")
