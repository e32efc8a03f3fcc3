"""Registered queries of readings: derived arithmetic, dataset descriptors, published grids and modalities."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import derived, loggrid, thresholds
from ..sources import descriptor, shared
from ..streaming import telemetry
from .queries import query
from .views import table

_EXPRESSIONS = {
    "ratio": "qty_n@node-0.post / qty_n@node-0.baseline",
    "gap": "qty_a@node-1.post - qty_n@node-1.post",
    "mixed": "qty_a@node-1.post + qty_r@node-1.post",
    "bare": "-qty_r.post",
    "zero": "1 / (qty_n.post - qty_n.post)",
    "power": "qty_n.post * qty_n.baseline / (2 * qty_a.post)",
    "broken": "(qty_n.post * 2",
}


@query("""WITH s AS (SELECT l_orderkey AS k, 'qty_' || lower(l_returnflag) AS metric, 'node-' || (l_suppkey % 3) AS entity, sum(l_quantity) FILTER (l_linenumber % 2 = 0) AS baseline, sum(l_quantity) FILTER (l_linenumber % 2 = 1) AS post FROM lineitem GROUP BY ALL),
c AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), t(name, ord, metric, entity, post) AS (VALUES ('ratio', 0, 'qty_n', 'node-0', true), ('ratio', 1, 'qty_n', 'node-0', false), ('gap', 0, 'qty_a', 'node-1', true), ('gap', 1, 'qty_n', 'node-1', true),
 ('mixed', 0, 'qty_a', 'node-1', true), ('mixed', 1, 'qty_r', 'node-1', true), ('bare', 0, 'qty_r', NULL, true), ('zero', 0, 'qty_n', NULL, true), ('power', 0, 'qty_n', NULL, true), ('power', 1, 'qty_n', NULL, false), ('power', 2, 'qty_a', NULL, true)),
r AS (SELECT c.k, t.name, t.ord, count(s.k) AS carried, count(s.k) FILTER (t.entity IS NULL OR s.entity = t.entity) AS n, max(CASE WHEN t.post THEN s.post ELSE s.baseline END) FILTER (t.entity IS NULL OR s.entity = t.entity) AS v FROM c CROSS JOIN t LEFT JOIN s ON s.k = c.k AND s.metric = t.metric GROUP BY ALL),
p AS (SELECT *, CASE WHEN carried = 0 THEN 'unknownSeries' WHEN n = 0 THEN 'unknownEntity' WHEN n > 1 THEN 'ambiguousSeries' WHEN v IS NULL THEN 'missingPoint' END AS problem FROM r),
e AS (SELECT k, name, coalesce(arg_min(problem, ord) FILTER (problem IS NOT NULL), CASE name WHEN 'mixed' THEN 'unitMismatch' WHEN 'zero' THEN 'divisionByZero' END) AS problem, max(v) FILTER (ord = 0) AS a, max(v) FILTER (ord = 1) AS b, max(v) FILTER (ord = 2) AS d FROM p GROUP BY k, name)
SELECT 'case-' || k AS case_id, name, CASE WHEN problem IS NULL THEN CASE name WHEN 'ratio' THEN a / b WHEN 'gap' THEN a - b * 1000 WHEN 'bare' THEN -a ELSE a * b / (2 * d) END END AS value,
 CASE WHEN problem IS NULL THEN CASE name WHEN 'ratio' THEN '1' WHEN 'gap' THEN 'ms' WHEN 'bare' THEN 'count' ELSE 's^2/ms' END END AS unit, problem, CASE WHEN problem IS NULL AND name = 'ratio' THEN a / b >= 1 END AS holds FROM e
UNION ALL SELECT 'case-' || k, 'broken', NULL, NULL, 'syntax', NULL FROM c""")
def derived_readings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases: quantities by return flag on three nodes, odd lines after a fault and even ones before."""
    flag, odd = F.lower("l_returnflag"), F.col("l_linenumber") % 2 == 1
    dealt = table(spark, d, "lineitem").select(F.concat(F.lit("case-"), F.col("l_orderkey").cast("string")).alias("case_id"), (F.col("l_suppkey") % 3).alias("node"), flag.alias("flag"), odd.alias("odd"), "l_quantity").repartition("case_id")
    sums = dealt.groupBy("case_id", "node", "flag").agg(F.sum(F.when(~F.col("odd"), F.col("l_quantity"))).alias("baseline"), F.sum(F.when(F.col("odd"), F.col("l_quantity"))).alias("post"))
    series = sums.select("case_id", F.concat(F.lit("node-"), F.col("node").cast("string")).alias("entity"), F.concat(F.lit("qty_"), F.col("flag")).alias("metric"), F.when(F.col("flag") == "a", "ms").when(F.col("flag") == "n", "s").otherwise("count").alias("unit"), "baseline", "post")
    told = derived.hold(derived.evaluate(series, _EXPRESSIONS), {"ratio": (">=", 1, "1")})
    return told.select("case_id", "name", "value", "unit", F.col("problem.kind").alias("problem"), "holds")


_KEYS = {"error": "1", "signup": "2", "view": "7", "purchase": "10", "click": "30"}
#: Events as log rows of 25 cases: a third of the templates is shared or masked, every fourth row names no cluster.
_LOGS = f"""l AS (SELECT user_id % 25 AS c, 'svc-' || (user_id % 10) AS container, (epoch_us(ts) // 240000000) AS at, (epoch_us(ts) // 240000000) // 15 * 15 AS bucket, event_id AS e,
 CASE event_type {" ".join(f"WHEN '{t}' THEN '{k}'" for t, k in _KEYS.items())} END AS key, CASE WHEN event_id % 5 = 0 THEN '<*>' WHEN event_id % 97 = 0 AND user_id % 25 % 2 = 0 THEN 'T error' WHEN event_type IN ('view', 'click') THEN 'T look' ELSE 'T ' || event_type END AS template FROM events)"""


def _grid_logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    case, container, at = F.col("user_id") % 25, F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string")), F.floor(times.epoch_ms(F.col("ts")) / 240_000)
    key = F.create_map(*[F.lit(x) for p in _KEYS.items() for x in p])[F.col("event_type")]
    text = F.when(F.col("event_id") % 5 == 0, "<*>").when((F.col("event_id") % 97 == 0) & (case % 2 == 0), "T error").when(F.col("event_type").isin("view", "click"), "T look").otherwise(F.concat(F.lit("T "), "event_type"))
    logs = table(spark, d, "events").select(F.concat(F.lit("case-"), case.cast("string")).alias("case_id"), case.alias("c"), container.alias("container"), F.when(F.col("event_id") % 4 != 0, key).alias("cluster_id"), text.alias("template"), at.alias("at_seconds"))
    template = F.when(F.col("k.type").isin("view", "click"), "T look").otherwise(F.concat(F.lit("T "), "k.type"))
    known = logs.select("case_id", "container").distinct().select("case_id", "container", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(k).alias("key")) for t, k in _KEYS.items()])).alias("k"))
    return logs, known.select("case_id", F.col("k.key").alias("key"), "container", template.alias("template"))


def _texts(*columns) -> Column:
    return F.array(*[c.cast("string") for c in columns])


@query(f"""WITH {_LOGS}, p AS (SELECT *, e % 4 <> 0 AS named, template <> '<*>' AS told FROM l),
t AS (SELECT c, count(*) AS seen, count(*) FILTER (named) AS by_id, count(*) FILTER (NOT named AND told) AS by_template, count(*) FILTER (NOT named AND NOT told) AS dropped, count(*) FILTER (named AND NOT told) AS masked,
 count(*) FILTER (named AND template = 'T error' AND key <> '1') AS contradicted, min(bucket) AS lo, max(bucket) AS hi, (max(bucket) - min(bucket)) // 15 + 1 AS expected, count(DISTINCT container) * 5 AS columns FROM p GROUP BY c),
w AS (SELECT *, CASE WHEN c % 5 = 3 THEN columns * len(list_filter(range(lo, hi + 1, 15), lambda b: b % 600 = 0)) ELSE 0 END AS bad, CASE WHEN c % 5 = 2 THEN expected - 1 ELSE expected END AS held FROM t)
SELECT 'case-' || c AS case_id, CASE WHEN c % 5 IN (2, 4) OR bad > 0 OR contradicted > 0 THEN 'disagreed' ELSE 'reproduced' END AS outcome, CASE WHEN c % 5 = 4 THEN 0 ELSE held END AS rows, expected AS expected_rows,
 CASE WHEN c % 5 = 4 THEN 0 ELSE columns END AS columns, CASE WHEN c % 5 = 4 THEN 0 ELSE held * columns END AS cells, bad AS wrong, seen, by_id, by_template, dropped, masked, contradicted FROM w""")
def published_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grids of the events' cases: some as the logs make them, some with other cells, names or ends."""
    logs, clusters = _grid_logs(spark, d)
    c, names = F.col("c"), lambda *keys: F.array(*[F.concat_ws("_", "container", F.lit(k)) for k in keys])
    of_text = F.when(F.col("template") == "T look", names("7", "30")).when(F.col("template") != "<*>", F.array(F.concat_ws("_", "container", F.create_map(*[F.lit(x) for t, k in _KEYS.items() for x in (f"T {t}", k)])[F.col("template")])))
    into = F.when(F.col("cluster_id").isNotNull(), F.array(F.concat_ws("_", "container", "cluster_id"))).otherwise(of_text)
    counted = logs.select("case_id", "c", (F.floor(F.col("at_seconds") / 15) * 15).alias("bucket"), F.explode(F.coalesce(into, F.array(F.lit("none")))).alias("name")).groupBy("case_id", "c", "bucket", "name").count()
    held = counted.groupBy("case_id", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("name", "count"))).alias("counts"))
    spans = counted.groupBy("case_id", "c").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    ordered = clusters.select("case_id", F.struct(F.col("key").cast("int").alias("k"), "container", F.concat_ws("_", "container", "key").alias("name")).alias("x")).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))
    table_ = spans.join(ordered, "case_id")
    end = F.col("hi") - F.when(c % 5 == 2, 15).otherwise(0)
    rows = table_.select("case_id", "c", "names", F.explode(F.sequence("lo", end, F.lit(15).cast("long"))).alias("bucket")).join(held, ["case_id", "bucket"], "left")
    extra = F.when((c % 5 == 3) & (F.col("bucket") % 600 == 0), 1).otherwise(0)
    cells = F.concat(_texts(F.col("bucket")), F.transform("names", lambda n: (F.coalesce(F.try_element_at("counts", n), F.lit(0)) + extra).cast("string")))
    heads = table_.select("case_id", F.lit(-1).cast("long").alias("line"), F.concat(F.array(F.lit("time")), F.when(c % 5 == 4, F.transform("names", lambda n, i: F.when(i == 0, "x_1").otherwise(n))).otherwise(F.col("names"))).alias("cells"))
    published = heads.unionByName(rows.select("case_id", F.col("bucket").alias("line"), cells.alias("cells")))
    return loggrid.compare(published, logs, clusters).select("case_id", "outcome", "rows", "expected_rows", "columns", "cells", "wrong", "seen", "by_id", "by_template", "dropped", "masked", "contradicted")


@query(f"""WITH {_LOGS}, n AS (SELECT c, container, bucket, count(*) AS n FROM l GROUP BY ALL), f AS (SELECT *, greatest(n - 1, 1) + CASE WHEN c % 5 = 3 AND bucket % 600 = 0 THEN n ELSE 0 END AS told FROM n),
a AS (SELECT c, count(*) AS pairs, count(*) FILTER (told > n) AS over, min(n - told) AS tightest, sum(told)::BIGINT AS published_total, count(DISTINCT bucket) AS published_rows, sum(n)::BIGINT AS log_rows FROM f GROUP BY c)
SELECT 'case-' || c AS case_id, CASE WHEN c % 5 IN (1, 2, 4) THEN 'refused' WHEN over > 0 THEN 'disagreed' ELSE 'bounded' END AS outcome, CASE c % 5 WHEN 1 THEN 'unreadable-header' WHEN 2 THEN 'unreadable-column' WHEN 4 THEN 'off-grid-table' END AS reason,
 CASE WHEN c % 5 IN (0, 3) THEN pairs END AS pairs, CASE WHEN c % 5 IN (0, 3) THEN over END AS over, CASE WHEN c % 5 IN (0, 3) THEN tightest END AS tightest, CASE WHEN c % 5 IN (0, 3) THEN published_total END AS published_total,
 CASE WHEN c % 5 IN (0, 3) THEN published_rows END AS published_rows, CASE WHEN c % 5 IN (0, 3) THEN log_rows END AS log_rows FROM a""")
def bounded_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grids by container of the events' cases, whose log rows name no cluster: one row less than there
    are, and in some cases twice as many, other headers, columns or times."""
    logs, _ = _grid_logs(spark, d)
    c = F.col("c")
    n = logs.withColumn("bucket", F.floor(F.col("at_seconds") / 15) * 15).groupBy("case_id", "c", "container", "bucket").count()
    told = F.greatest(F.col("count") - 1, F.lit(1)) + F.when((c % 5 == 3) & (F.col("bucket") % 600 == 0), F.col("count")).otherwise(0)
    held = n.groupBy("case_id", "c", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("container", told))).alias("m"))
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("svc-"), i.cast("string")))
    rows = held.select("case_id", F.col("bucket").alias("line"), F.concat(_texts(F.col("bucket") + F.when(c % 5 == 4, 1).otherwise(0)), F.transform(names, lambda s: F.coalesce(F.try_element_at("m", s).cast("string"), F.lit("")))).alias("cells"))
    head = F.concat(F.array(F.when(c % 5 == 1, "t").otherwise("time")), F.transform(names, lambda s: F.concat(s, F.when(c % 5 == 2, "").otherwise("_1"))))
    published = n.select("case_id", "c").distinct().select("case_id", F.lit(-1).cast("long").alias("line"), head.alias("cells")).unionByName(rows)
    return loggrid.bound(published, logs).select("case_id", "outcome", "reason", "pairs", "over", "tightest", "published_total", "published_rows", "log_rows")


@query("""WITH e AS (SELECT user_id % 25 AS n, event_id // 5000 AS part, event_type, CASE WHEN event_type = 'click' THEN 'logs' WHEN event_type = 'purchase' THEN 'traces' ELSE 'metrics' END AS folder FROM events),
c AS (SELECT CASE WHEN n < 20 THEN 'case-' || n ELSE 'rest' END AS case_id, min(CASE WHEN n < 20 THEN n % 10 ELSE 0 END) AS s, count(*) FILTER (n < 24 AND event_type IN ('view', 'click', 'purchase')) AS signals,
 count(*) FILTER (n < 24 AND event_type = 'signup') + count(DISTINCT (n, part, folder)) FILTER (n = 24) AS quarantined, count(*) FILTER (n < 24 AND event_type = 'error') AS missing, count(DISTINCT (n, part, folder)) AS files FROM e GROUP BY 1)
SELECT case_id, signals, quarantined, missing, files, 'service:shop/svc-' || s AS root_entity_id, '2024-01-15T23:50:00.000Z' AS window_start, 'resource' AS category FROM c""")
def ingested_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Events as the files of 25 folders: views, errors and signups as CSV (a number, a missing one, none), clicks
    as JSON lines, purchases as TSV; the files of one folder have an ending that says nothing."""
    n, kind = F.col("user_id") % 25, F.col("event_type")
    at, service = times.iso_utc(times.epoch_ms(F.col("ts"))), F.concat(F.lit("svc-"), (F.col("user_id") % 10).cast("string"))
    folder = F.when(kind == "click", "logs").when(kind == "purchase", "traces").otherwise("metrics")
    value = F.when(kind == "error", "NaN").when(kind == "signup", "x").otherwise(F.col("value").cast("string"))
    text = F.col("event_id").cast("string")
    line = F.when(kind == "click", F.to_json(F.struct(at.alias("ts"), service.alias("svc"), F.col("props").alias("msg")))).when(kind == "purchase", F.concat_ws("\t", at, service, text, text, kind, value)).otherwise(F.concat_ws(",", at, service, kind, value))
    rows = table(spark, d, "events").select(n.alias("n"), F.floor(F.col("event_id") / 5000).alias("part"), folder.alias("folder"), "event_id", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    head = F.when(F.col("folder") == "metrics", "time,service,metric,value\n").when(F.col("folder") == "traces", "time\tservice\ttrace_id\tspan_id\toperation\tduration\n").otherwise("")
    end = F.when(F.col("n") == 24, "bin").when(F.col("folder") == "metrics", "csv").when(F.col("folder") == "traces", "tsv").otherwise("jsonl")
    files = rows.groupBy("n", "part", "folder").agg(lines.alias("lines")).select(F.format_string("case-%d/%s/p%d.%s", "n", "folder", "part", end).alias("path"), F.concat(head, "lines").alias("content"))
    listed = rows.select("n").distinct().select(F.least("n", F.lit(20)).alias("n")).distinct()
    c, rest = F.col("n"), F.col("n") == 20
    name = F.when(rest, "rest").otherwise(F.concat(F.lit("case-"), c.cast("string")))
    none = F.lit(None).cast("string")
    cases = listed.select(
        c.cast("int").alias("case_ord"), name.alias("case_id"), F.concat(F.lit("svc-"), F.when(rest, 0).otherwise(c % 10).cast("string")).alias("component"), F.lit("CPU stress").alias("fault_type"), none.alias("fault_category"), F.lit("2024-01-16T00:00:00Z").alias("inject_time"),
        none.alias("window_start"), none.alias("window_end"), F.when(~rest, F.array(F.concat(name, F.lit("/")))).alias("prefixes"),
    )
    empty = lambda kind: spark.createDataFrame([], kind)
    specs = empty("case_id string, path string, " + ", ".join(f"{k} {t}" for k, t in descriptor.OPTIONS.items()))
    told = descriptor.ingest(files, cases, specs, "rcaeval", "shop", empty("entity_id string, kind string, name string, aliases array<string>"), empty("src string, dst string, relation string"))
    return told.report.join(told.cases.select("case_id", "root_entity_id", "window_start", "category"), "case_id")


@query("""WITH e AS (SELECT user_id % 25 AS c, event_id % 3 AS b, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 3600000000 AS start FROM events), h AS (SELECT c, b, max(us) AS top FROM e GROUP BY ALL),
p AS (SELECT e.*, coalesce(start + 3600000000 <= (SELECT max(top) FROM h WHERE h.c = e.c AND h.b < e.b) - 86400000000, false) AS late FROM e)
SELECT 'case-' || c AS case_id, make_timestamp(start) AS period_start, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late FROM p GROUP BY ALL""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that come to a stream in three parts, each over all their time: hours by case, and what came
    more than a day too late for them."""
    path = shared.fresh_path(spark, "late")
    rows = table(spark, d, "events").select(F.concat(F.lit("case-"), (F.col("user_id") % 25).cast("string")).alias("case_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("part"))
    for part in range(3):
        rows.where(F.col("part") == part).select("case_id", "ts").write.parquet(f"{path}/in/{part}")
        stream = spark.readStream.schema("case_id string, ts timestamp").parquet(f"{path}/in/*")
        with telemetry.lasting_state(spark):
            told = telemetry.windows_or_late(stream, "case_id", seconds=3600, lateness="1 day")
            told.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(told.schema).parquet(f"{path}/out")
    n = lambda kind, of: F.coalesce(of(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("long")
    return out.groupBy("case_id", F.col("start").cast("timestamp_ntz").alias("period_start")).agg(n("window", F.max).alias("n"), n("late", F.sum).alias("n_late"))


@query("""WITH s AS (SELECT event_type AS model, event_id % 3 = 0 AS positive, value + CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 1000 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 50 ELSE 0 END AS value FROM events),
v AS (SELECT model, value, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM s GROUP BY ALL), c AS (SELECT model, value, coalesce(sum(p) OVER (PARTITION BY model ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS refused, sum(q) OVER (PARTITION BY model ORDER BY value ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS credited FROM v),
b AS (SELECT model, value, refused, credited FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY refused + credited, value) = 1), g AS (SELECT model, round(min(value) FILTER (positive), 3) AS low, round(max(value) FILTER (NOT positive), 3) AS high FROM s GROUP BY model)
SELECT model, round(low - high, 3) AS gap, round(low - high, 3) >= 0.05 AS separates, CASE WHEN round(low - high, 3) >= 0.05 THEN round((low + high) / 2, 3) END AS threshold, round(value, 3) AS fitted_threshold, (refused + credited)::BIGINT AS errors, refused::BIGINT AS false_refusals, credited::BIGINT AS false_credits FROM b JOIN g USING (model)""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Values of the events of each type as scores: every third event is positive and 50 higher, signups by 1000 more."""
    positive = F.col("event_id") % 3 == 0
    value = F.col("value") + F.when((F.col("event_type") == "signup") & positive, 1000).otherwise(0) + F.when(positive, 50).otherwise(0)
    return thresholds.measure(table(spark, d, "events").select(F.col("event_type").alias("model"), positive.alias("positive"), value.alias("value")))
