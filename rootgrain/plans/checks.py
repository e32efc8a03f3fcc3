"""Registered queries of the checks on cases: validity of faults, leaks, presence of answers, spread of difficulty."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chains, gates, rules, validity
from .queries import query
from .views import INJECT_MS, SIGNALS, signals, table

_CATEGORIES = (*validity.EXPECTED, "unknown")
_CASES = f"""SELECT 'case-' || c_custkey AS case_id, CASE c_custkey % 8 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES))} END AS category,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'svc-' || (c_custkey % 5 + CASE WHEN c_custkey % 7 = 0 THEN 90 ELSE 0 END) END AS component, CAST({INJECT_MS} AS BIGINT) AS inject_ms FROM customer"""
_EXPECT = "CASE category " + " ".join(f"WHEN '{c}' THEN coalesce(semantic IN ({', '.join(repr(k) for k in kinds)}), false) OR regexp_matches(lower(name), '{names}')" for c, (kinds, names) in validity.EXPECTED.items()) + " ELSE false END"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    category = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), (k % 8 + 1).cast("int"))
    component = F.when(k % 11 != 0, F.concat(F.lit("svc-"), (k % 5 + F.when(k % 7 == 0, 90).otherwise(0)).cast("string")))
    return table(spark, d, "customer").select(F.concat(F.lit("case-"), k.cast("string")).alias("case_id"), category.alias("category"), component.alias("component"), F.lit(INJECT_MS).cast("long").alias("inject_ms"))


@query(f"""WITH c AS ({_CASES}), s AS (SELECT *, CASE name WHEN 'view' THEN 'latency' WHEN 'click' THEN 'saturation' END AS semantic FROM ({SIGNALS})),
o AS (SELECT s.case_id, name, s.ts_ms, signal_idx, value, category, inject_ms, {_EXPECT} AS matches, row_number() OVER (PARTITION BY s.case_id, name ORDER BY s.ts_ms, signal_idx) AS ord FROM s JOIN c ON s.case_id = c.case_id AND s.service = c.component),
m AS (SELECT case_id, name, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sigma, count(*) AS k FROM o WHERE ts_ms < inject_ms AND ord <= 3 GROUP BY ALL),
z AS (SELECT o.*, coalesce(k, 0) >= 3 AS est, abs(value - coalesce(mean, 0)) / greatest(coalesce(sigma, 0), 1e-6) AS z FROM o LEFT JOIN m USING (case_id, name)),
h AS (SELECT *, ts_ms >= inject_ms AND est AND z >= 2 AS hit FROM z),
i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, name ORDER BY ord) AS g FROM h),
r AS (SELECT case_id, name, g, count(*) FILTER (hit) AS run, min(ts_ms) FILTER (hit) AS start FROM i GROUP BY ALL),
n AS (SELECT case_id, name, min(start) FILTER (run >= 3) AS onset FROM r GROUP BY ALL),
e AS (SELECT case_id, name, bool_or(matches) AS matches, bool_or(est) AS est, count(*) FILTER (ts_ms < inject_ms AND ord > 3 AND z >= 4) AS old FROM h GROUP BY ALL),
v AS (SELECT e.*, CASE WHEN matches AND est THEN onset END AS moved FROM e JOIN n USING (case_id, name)),
t AS (SELECT case_id, count(*) AS n, count(*) FILTER (matches) AS n_matching, count(*) FILTER (matches AND est) AS n_readable, min(moved) AS first, count(*) FILTER (old > 0) AS n_old FROM v GROUP BY ALL),
p AS (SELECT h.case_id, h.name, h.ord, max(h.hit) OVER (PARTITION BY h.case_id, h.name, h.ts_ms) AS hit FROM h JOIN v ON v.case_id = h.case_id AND v.name = h.name AND moved IS NOT NULL JOIN t ON t.case_id = h.case_id WHERE h.ts_ms >= t.first),
q AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, name ORDER BY ord) AS misses FROM p),
u AS (SELECT case_id, max(run) AS sustained FROM (SELECT case_id, name, count(*) AS run FROM q WHERE misses = 0 GROUP BY ALL) GROUP BY ALL),
w AS (SELECT c.case_id, component IS NOT NULL AS target_resolves, coalesce(n, 0) > 0 AS target_observed, category = 'unknown' OR first IS NOT NULL AS mechanism_manifested, CAST(floor((first - inject_ms) / 1000 + 0.5) AS BIGINT) AS onset_offset_seconds,
 coalesce(sustained, 0) AS sustained, coalesce(n_old, 0) = 0 AS no_preexisting_anomaly, category <> 'unknown' AND (component IS NULL OR (coalesce(n, 0) > 0 AND (n_matching = 0 OR n_readable > 0))) AS speaks FROM c LEFT JOIN t USING (case_id) LEFT JOIN u USING (case_id)),
x AS (SELECT *, coalesce(abs(onset_offset_seconds) <= 120, false) AS onset_precision, sustained >= 3 AS sustained_duration FROM w)
SELECT case_id, target_resolves, target_observed, mechanism_manifested, onset_precision, sustained_duration, no_preexisting_anomaly, onset_offset_seconds, sustained,
 CASE WHEN target_resolves AND target_observed AND mechanism_manifested AND onset_precision AND sustained_duration AND no_preexisting_anomaly THEN 'valid' WHEN NOT speaks THEN 'unverifiable' ELSE 'invalid' END AS verdict FROM x""")
def fault_validity(spark: SparkSession, d: str) -> DataFrame:
    """Six checks of each customer's case against the events of its service."""
    semantic = F.when(F.col("name") == "view", "latency").when(F.col("name") == "click", "saturation")
    return validity.report(_cases(spark, d).withColumnRenamed("component", "service"), signals(spark, d).withColumn("semantic", semantic))


_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '[-_./]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id, {_PLAIN.format("CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand END")} AS name, {_PLAIN.format("p_name || '. ' || replace(upper(p_type), ' ', '_') || ' ' || CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '9' END")} AS q FROM part)
SELECT case_id, length(name) >= 6 AS judged, length(name) >= 6 AND regexp_matches(q, '(^|[^a-z0-9])' || regexp_escape(name) || '([^a-z0-9]|$)') AS leaks FROM p""")
def prompt_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose description names their type or brand."""
    k = F.col("p_partkey")
    text = F.concat("p_name", F.lit(". "), F.translate(F.upper("p_type"), " ", "_"), F.lit(" "), F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("9"))))
    return gates.prompt_leaks(table(spark, d, "part").select(k.cast("string").alias("case_id"), F.when(k % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("component"), text.alias("query")))


@query(f"""WITH c AS ({_CASES}), n AS (SELECT case_id, list_sort(list(DISTINCT service)) AS names FROM ({SIGNALS}) GROUP BY ALL)
SELECT case_id, component, array_to_string(names, ',') AS carried FROM c JOIN n USING (case_id) WHERE NOT list_contains(names, component)""")
def absent_answers(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose events carry services, but not the one that is the answer."""
    return gates.absent_answers(_cases(spark, d), signals(spark, d)).select("case_id", "component", F.array_join("carried", ",").alias("carried"))


_LEVELS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'L' || (o_orderkey % 4 + 1) END AS difficulty, o_orderkey FROM orders),
f AS (SELECT o.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey) AS depth FROM o)"""


def _levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as cases, with levels made of their keys, and their floors, lines being steps."""
    k = F.col("o_orderkey")
    cases = table(spark, d, "orders").select(k.cast("string").alias("case_id"), F.when(k % 7 != 0, F.concat(F.lit("L"), (k % 4 + 1).cast("string"))).alias("difficulty"), F.lit("service:/a").alias("root_entity_id"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_linenumber").alias("step"), F.lit("service:/a").alias("from_entity"), F.lit("service:/a").alias("to_entity"))
    entities = spark.createDataFrame([("service:/a", "service")], "entity_id string, kind string")
    return cases, chains.difficulty_floor(cases, steps, entities)


@query(f"""WITH {_LEVELS}, a AS (SELECT count(*) AS n, count(difficulty) AS graded, count(*) FILTER (difficulty = 'L1') / count(difficulty) AS l1_share, count(*) FILTER (depth >= 3) / count(*) AS l4_share FROM f)
SELECT n, graded, round(l1_share, 6) AS l1_share, round(l4_share, 6) AS l4_share, array_to_string(list_filter([CASE WHEN l1_share > 0.2 THEN 'DIFFICULTY_SKEWED_EASY' END, CASE WHEN l4_share < 0.1 THEN 'DIFFICULTY_SKEWED_HARD' END], lambda x: x IS NOT NULL), ',') AS codes FROM a""")
def difficulty_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Shares of easy claims and of earned hard levels over all orders."""
    told = gates.difficulty_distribution(*_levels(spark, d))
    return told.select("n", "graded", F.round("l1_share", 6).alias("l1_share"), F.round("l4_share", 6).alias("l4_share"), F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {_LEVELS}, x AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS method, CASE WHEN l_quantity <= 25 THEN l_linenumber END AS r FROM lineitem),
s AS (SELECT o.case_id FROM o LEFT JOIN x ON x.case_id = o.case_id AND r <= 3 GROUP BY o.case_id HAVING count(r) = 0)
SELECT case_id, 'UNSOLVABLE' AS code FROM s UNION ALL SELECT NULL, 'DIFFICULTY_SKEWED_EASY' FROM f HAVING count(*) FILTER (difficulty = 'L1') / count(difficulty) > 0.2 UNION ALL SELECT NULL, 'DIFFICULTY_SKEWED_HARD' FROM f HAVING count(*) FILTER (depth >= 3) / count(*) < 0.1
UNION ALL SELECT NULL, 'SATURATED' FROM x GROUP BY method HAVING count(DISTINCT CASE WHEN r <= 1 THEN case_id END) / count(DISTINCT case_id) >= 0.95 AND count(DISTINCT case_id) >= 10""")
def g4_violations(spark: SparkSession, d: str) -> DataFrame:
    """All of G4 over orders, returned flags being methods."""
    cases, floors = _levels(spark, d)
    outcomes = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("method"), F.when(F.col("l_quantity") <= 25, F.col("l_linenumber")).alias("rank_of_truth"), F.col("l_linenumber").alias("candidate_count"))
    return gates.g4(cases, outcomes, floors)


@query("""WITH x AS (SELECT CASE WHEN l_tax > l_discount THEN 'strict' WHEN l_tax = l_discount THEN 'tie' WHEN l_quantity > 25 THEN 'same-component' ELSE 'none' END AS kind FROM lineitem)
SELECT count(*) AS n, count(*) FILTER (kind = 'strict') AS strict, count(*) FILTER (kind = 'tie') AS tie, count(*) FILTER (kind = 'same-component') AS same_component, count(*) FILTER (kind = 'none') AS none, count(*) > 0 AND count(*) FILTER (kind = 'strict') = 0 AS violated FROM x""")
def discrimination(spark: SparkSession, d: str) -> DataFrame:
    """How lines would be displaced, their tax being the loudest reading and their discount the answer's."""
    kind = F.when(F.col("l_tax") > F.col("l_discount"), "strict").when(F.col("l_tax") == F.col("l_discount"), "tie").when(F.col("l_quantity") > 25, "same-component").otherwise("none")
    return gates.discrimination(table(spark, d, "lineitem").select("l_orderkey", kind.alias("kind")))


@query("""SELECT p_partkey, regexp_extract(p_brand, '^(Brand)#(1?)(\\d*)$', 2) AS one, regexp_extract(p_brand, '^(Brand)#(1?)(\\d*)$', 3) AS rest, CASE WHEN NOT regexp_matches(p_brand, '^(Brand)#(1?)(\\d*)$') THEN 'PATTERN_MISMATCH' WHEN p_partkey % 2 = 0 THEN 'PATTERN_MISMATCH' END AS code FROM part""")
def rule_regex_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups that match nothing are set; a group that takes no part in the match is not."""
    part = table(spark, d, "part").withColumn("s", F.concat(F.when(F.col("p_partkey") % 2 == 0, "").otherwise("+"), "p_brand"))
    rule = rules.Rule("g", "regex", "", source="s", pattern=r"^(?:(?<sign>[+(])|)(?<brand>Brand)#(?<one>1?)(?<rest>\d*)$")
    return rules.classify(part, [rule]).select("p_partkey", "one", "rest", F.col("failure.code").alias("code"))
