"""Registered queries of references: series of readings, published rows, evidence, layers, calls, records of runs."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, references
from .queries import query
from .views import graph, table


def _named(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """(k, n, r): customers with their nation and region."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))


_CUSTOMERS = "c AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)"
#: Pairs of entities of which one holds the other.
_NEAR = f"""{_CUSTOMERS}, h AS (SELECT 'cluster:/' || n_regionkey AS o, 'node:/' || n_nationkey AS i FROM nation UNION SELECT 'node:/' || n, 'external:/' || k FROM c UNION SELECT 'cluster:/' || r, 'external:/' || k FROM c
 UNION SELECT 'node:/' || s_nationkey, 'service:/' || s_suppkey FROM supplier UNION SELECT 'cluster:/' || n_regionkey, 'service:/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
near AS (SELECT o AS entity, i AS other FROM h UNION SELECT i, o FROM h)"""


@query(f"""WITH {_NEAR}, s AS (SELECT k, 'external:/' || k AS service FROM c WHERE k % 5 = 1 UNION ALL SELECT k, 'node:/' || n FROM c WHERE k % 5 IN (2, 3) UNION ALL SELECT k, 'cluster:/' || r FROM c WHERE k % 5 = 3 UNION ALL SELECT k, 'service:/1' FROM c WHERE k % 5 = 4),
q AS (SELECT k, 'own' AS id, 'external:/' || k AS entity FROM c UNION ALL SELECT k, 'node', 'node:/' || n FROM c UNION ALL SELECT k, 'lost', 'nobody' FROM c),
x AS (SELECT q.k, q.id, count(s.service) AS carried, count(*) FILTER (s.service = q.entity) AS n1, count(near.other) AS n2, min(s.service) FILTER (s.service = q.entity) AS w1, min(near.other) AS w2, string_agg(s.service, ',' ORDER BY s.service) AS everyone, string_agg(near.other, ',' ORDER BY near.other) AS several
 FROM q LEFT JOIN s ON s.k = q.k LEFT JOIN near ON near.entity = q.entity AND near.other = s.service GROUP BY ALL),
y AS (SELECT *, CASE WHEN carried = 0 THEN 'unknownMetric' WHEN id = 'lost' THEN 'unknownEntity' WHEN n1 = 1 OR n2 = 1 THEN 'resolved' WHEN n2 > 1 THEN 'ambiguous' ELSE 'otherComponent' END AS kind FROM x)
SELECT 'case-' || k AS case_id, id AS checkpoint_id, kind, CASE WHEN kind = 'resolved' THEN CASE WHEN n1 = 1 THEN 'entity' ELSE 'component' END END AS via, CASE WHEN kind = 'resolved' THEN coalesce(w1, w2) END AS service,
 CASE kind WHEN 'ambiguous' THEN several WHEN 'otherComponent' THEN everyone END AS carriers, CASE WHEN kind = 'unknownMetric' THEN 'other' END AS declares FROM y""")
def resolved_readings(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cases whose metric is told of themselves, their nation, their region, a supplier or nobody."""
    c, k = _customers(spark, d), F.col("k")
    own, node, region = _named("external:/", "k"), _named("node:/", "n"), _named("cluster:/", "r")
    where = F.when(k % 5 == 1, F.array(own)).when(k % 5 == 2, F.array(node)).when(k % 5 == 3, F.array(node, region)).when(k % 5 == 4, F.array(F.lit("service:/1"))).otherwise(F.array(own))
    series = c.select(_named("case-", "k").alias("case_id"), F.explode(where).alias("service"), F.when(k % 5 == 0, "other").otherwise("m").alias("metric"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), e.alias("e")) for i, e in (("own", own), ("node", node), ("lost", F.lit("nobody")))]))
    checkpoints = c.select(_named("case-", "k").alias("case_id"), asked.alias("a")).select("case_id", F.col("a.id").alias("checkpoint_id"), F.col("a.e").alias("entity_ref"), F.lit("m").alias("metric"))
    told = references.resolve_readings(checkpoints, series, *graph(spark, d))
    return told.withColumns({x: F.array_join(x, ",") for x in ("carriers", "declares")})


@query(f"""WITH {_CUSTOMERS}, o AS (SELECT o_orderkey, o_custkey AS k, n, o_orderkey % 2 = 0 AS own, o_orderkey % 4 AS m, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'metrics' WHEN left(o_orderpriority, 1) = '3' THEN 'logs' WHEN left(o_orderpriority, 1) = '4' THEN 'parameters' END AS carrier FROM orders JOIN c ON k = o_custkey),
x AS (SELECT *, CASE WHEN carrier = 'parameters' THEN CASE WHEN m = 0 THEN 'key' END WHEN carrier = 'logs' THEN CASE WHEN m = 0 THEN 'container' WHEN m = 1 THEN CASE WHEN own THEN 'entity' ELSE 'container' END END
 WHEN carrier = 'metrics' THEN CASE WHEN m = 0 THEN CASE WHEN own THEN 'entity' ELSE 'container' END WHEN m = 1 THEN CASE WHEN own THEN 'container' ELSE 'entity' END WHEN m = 2 AND NOT own AND n = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1) THEN 'container' END END AS match FROM o)
SELECT 'case-' || k AS case_id, 'o-' || o_orderkey AS checkpoint_id, CASE WHEN carrier IS NULL THEN 'none' WHEN match IS NOT NULL THEN 'joined' ELSE 'dangling' END AS kind, carrier, CASE WHEN carrier IS NOT NULL THEN 'm' || m END AS key, match,
 CASE WHEN carrier IS NOT NULL AND match IS NULL THEN CASE WHEN carrier = 'parameters' THEN 'noKey' WHEN carrier = 'metrics' AND m = 2 THEN 'otherEntity' ELSE 'noRow' END END AS reason FROM x""")
def joined_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders as checkpoints of their customers' cases, beside what each case publishes."""
    c = _customers(spark, d)
    case, own, node, region = _named("case-", "k"), _named("external:/", "k"), _named("node:/", "n"), _named("cluster:/", "r")
    rows = lambda name, *of: c.select(case.alias("case_id"), F.explode(F.array(*[F.struct(F.lit(m).alias("m"), e.alias("e")) for m, e in of])).alias("x")).select("case_id", F.col("x.m").alias(name), F.col("x.e").alias("entity_id"))
    metrics = rows("metric", ("m0", own), ("m1", node), ("m2", F.lit("service:/1")))
    logs = rows("id", ("m0", region), ("m1", own))
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "3", "log").when(first == "4", "configuration").when(first == "5", "derived").otherwise("series")
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("k"))
    checkpoints = orders.select(case.alias("case_id"), _named("o-", "o_orderkey").alias("checkpoint_id"), F.when(key % 2 == 0, own).otherwise(node).alias("entity_ref"), F.when(first != "5", _named("m", key % 4)).alias("signal_ref"), kind.alias("signal_kind"))
    return references.join_published(checkpoints, metrics, logs, c.select(case.alias("case_id"), F.lit("m0").alias("key")), graph(spark, d)[1])


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 7 THEN '' WHEN c_custkey % 4 < 2 THEN 'x' || (c_custkey // 2) ELSE 'y' || c_custkey END AS name FROM customer), w AS (SELECT name, string_agg('external:/' || k, ',' ORDER BY 'external:/' || k) AS owners FROM e WHERE name <> '' GROUP BY name HAVING count(*) > 1),
o AS (SELECT o_orderkey, o_custkey, name, owners, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'a|b' ELSE 'm' END AS ref, o_orderkey % 11 = 0 OR e.k IS NULL AS lost FROM orders LEFT JOIN e ON e.k = o_custkey LEFT JOIN w USING (name)),
f AS (SELECT *, CASE WHEN lost THEN 'unresolved' WHEN name = '' THEN 'unnamed' WHEN ref = '' THEN 'emptyRef' WHEN ref LIKE '%|%' THEN 'preQualified' WHEN ref IS NOT NULL AND owners IS NOT NULL THEN 'ambiguous' END AS fault FROM o)
SELECT 'case-' || o_custkey AS case_id, 'o-' || o_orderkey AS checkpoint_id, CASE WHEN fault IS NULL THEN name || '|' || ref END AS ref, fault, CASE WHEN fault = 'ambiguous' THEN owners END AS candidates FROM f""")
def signal_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders as checkpoints; some customers share a name, some have none."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    entities = table(spark, d, "customer").select(_named("external:/", "c_custkey").alias("entity_id"), F.when(k % 10 == 7, "").when(k % 4 < 2, _named("x", F.floor(k / 2))).otherwise(_named("y", k)).alias("name"))
    ref = F.when(o % 5 != 0, F.when(o % 7 == 0, "").when(o % 13 == 0, "a|b").otherwise("m"))
    checkpoints = table(spark, d, "orders").select(_named("case-", "o_custkey").alias("case_id"), _named("o-", "o_orderkey").alias("checkpoint_id"), F.when(o % 11 == 0, "nobody").otherwise(_named("external:/", "o_custkey")).alias("entity_ref"), ref.alias("signal_ref"))
    return references.signal_refs(checkpoints, entities).withColumn("candidates", F.array_join("candidates", ","))


@query("""WITH p AS (SELECT c_custkey AS k, unnest(range(c_custkey % 5)) AS i FROM customer), s AS (SELECT o_custkey AS k, o_orderkey % 50 = 0 AS lost, unnest([o_orderkey % 3, o_orderkey % 6]) AS i FROM orders),
n AS (SELECT o_custkey AS k, count(*) AS n_steps, count(*) FILTER (o_orderkey % 50 = 0) AS n_lost FROM orders GROUP BY ALL), e AS (SELECT k, count(*) AS n_checkpoints, string_agg('cp-' || i, ',' ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.k = p.k AND s.i = p.i)) AS uncited FROM p GROUP BY k),
g AS (SELECT s.k, count(*) AS n_dangling FROM s WHERE s.i >= s.k % 5 GROUP BY s.k),
f AS (SELECT c_custkey AS k, c_custkey % 7 <> 0 AS entity_filled, c_custkey % 9 <> 0 AS fault_filled, coalesce(n_steps, 0) AS n_steps, coalesce(n_lost, 0) AS n_lost, coalesce(n_checkpoints, 0) AS n_checkpoints, coalesce(n_dangling, 0) AS n_dangling, coalesce(uncited, '') AS uncited
 FROM customer LEFT JOIN n ON n.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN g ON g.k = c_custkey)
SELECT 'case-' || k AS case_id, entity_filled, fault_filled, n_steps > 0 AND n_lost = 0 AS process_filled, n_checkpoints > 0 AS evidence_filled, n_steps, n_checkpoints, n_dangling, (NOT entity_filled)::INT + n_lost AS n_unresolved, uncited,
 entity_filled AND fault_filled AND n_steps > 0 AND n_lost = 0 AND n_checkpoints > 0 AND n_dangling = 0 AND uncited = '' AS complete FROM f""")
def four_layers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as cases, orders as steps from a customer to a nation, which cite up to two of up to four checkpoints."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    customers = table(spark, d, "customer")
    cases = customers.select(_named("case-", "c_custkey").alias("case_id"), F.when(k % 7 == 0, "nobody").otherwise(_named("external:/", "c_custkey")).alias("root_entity_id"), F.col("c_mktsegment").alias("fault_type"), F.when(k % 9 == 0, "unknown").otherwise("code").alias("category"))
    steps = table(spark, d, "orders").select(_named("case-", "o_custkey").alias("case_id"), o.alias("step"), F.lit("node:/1").alias("from_entity"), F.when(o % 50 == 0, "nobody").otherwise("cluster:/1").alias("to_entity"), F.array(_named("cp-", o % 3), _named("cp-", o % 6)).alias("evidence_refs"))
    own = customers.where(k % 5 > 0).select(_named("case-", "c_custkey").alias("case_id"), _named("external:/", "c_custkey").alias("entity_ref"), F.explode(F.sequence(F.lit(0).cast("long"), k % 5 - 1)).alias("i"))
    told = references.four_layers(cases, steps, own.select("case_id", _named("cp-", "i").alias("checkpoint_id"), "entity_ref"), graph(spark, d)[0])
    return told.withColumn("n_unresolved", F.size("unresolved")).withColumn("uncited", F.array_join("uncited", ",")).drop("unresolved")


@query("""WITH own AS (SELECT 'service:/' || s_suppkey AS e, s_suppkey AS s FROM supplier UNION ALL SELECT 'pod:/' || p_partkey, s_suppkey FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)),
calls AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 3 <> 0), steps AS (SELECT l_orderkey, 'pod:/' || l_partkey AS f, 'service:/' || l_suppkey AS t FROM lineitem),
ends AS (SELECT DISTINCT l_orderkey, x.s AS a, y.s AS b FROM steps JOIN own x ON x.e = f JOIN own y ON y.e = t)
SELECT 'case-' || l_orderkey AS case_id, p.s_name AS "from", q.s_name AS "to" FROM ends JOIN supplier p ON p.s_suppkey = a JOIN supplier q ON q.s_suppkey = b WHERE EXISTS (SELECT 1 FROM calls c WHERE (c.a = ends.a AND c.b = ends.b) OR (c.a = ends.b AND c.b = ends.a))""")
def chain_calls(spark: SparkSession, d: str) -> DataFrame:
    """Lines as causal steps from a part, which a supplier holds, to the line's supplier; suppliers call their neighbours."""
    suppliers, parts = table(spark, d, "supplier"), table(spark, d, "part")
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    s = F.col("s_suppkey")
    held = parts.crossJoin(F.broadcast(n)).join(suppliers.select("s_suppkey"), F.col("p_partkey") % F.col("n") == s).select(_named("service:/", "s_suppkey").alias("src"), _named("pod:/", "p_partkey").alias("dst"), F.lit("contains").alias("relation"))
    following = suppliers.select(s.alias("b"))
    calls = suppliers.where(s % 3 != 0).join(following, F.col("b") == s + 1).select(_named("service:/", "s_suppkey").alias("src"), _named("service:/", "b").alias("dst"), F.lit("calls").alias("relation"))
    entities = suppliers.select(_named("service:/", "s_suppkey").alias("entity_id"), F.lit("service").alias("kind"), F.col("s_name").alias("name")).unionByName(parts.select(_named("pod:/", "p_partkey").alias("entity_id"), F.lit("pod").alias("kind"), F.col("p_name").alias("name")))
    steps = table(spark, d, "lineitem").select(_named("case-", "l_orderkey").alias("case_id"), _named("pod:/", "l_partkey").alias("from_entity"), _named("service:/", "l_suppkey").alias("to_entity"))
    return references.calls_across(steps, entities, held.unionByName(calls))


@query("""WITH k AS (SELECT p_partkey AS k, p_type AS type, p_brand AS category, p_name AS component FROM part), t AS (SELECT *, CASE WHEN k % 3 = 0 THEN type || 'x' ELSE type END AS told_type, CASE WHEN k % 4 = 0 THEN NULL ELSE category END AS told_category, component AS told_component FROM k),
n AS (SELECT count(*) AS size, sha256(string_agg(k || '|' || type || '|' || category || '|' || component, chr(10) ORDER BY k::VARCHAR || '|' || type || '|' || category || '|' || component) || chr(10)) AS digest, count(*) FILTER (k % 3 <> 0) AS type, count(*) FILTER (k % 4 <> 0) AS category, count(*) AS component, count(*) FILTER (k % 3 <> 0 AND k % 4 <> 0) AS strict FROM t)
SELECT 'size' AS what, NULL AS sample, size::VARCHAR AS recorded, digest AS artefact FROM n UNION ALL SELECT 'total', NULL, (strict + 1)::VARCHAR, strict::VARCHAR FROM n
UNION ALL SELECT 'field', k::VARCHAR, told_component, upper(component) FROM t WHERE k % 7 = 0 AND k % 5 <> 0 AND component <> upper(component) UNION ALL SELECT 'missing', k::VARCHAR, component, NULL FROM t WHERE k % 5 = 0 UNION ALL SELECT 'extra', (-k)::VARCHAR, NULL, told_type FROM t WHERE k % 10 = 0 AND k > 0""")
def recorded_readings(spark: SparkSession, d: str) -> DataFrame:
    """Parts as samples, a run's record of them, and another artefact that answers some otherwise or not at all."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part")
    key = parts.select(k.alias("sample_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("category"), F.col("p_name").alias("component"))
    answers = parts.select(k.alias("sample_id"), F.lit(True).alias("parsed"), F.when(k % 3 == 0, F.concat("p_type", F.lit("x"))).otherwise(F.col("p_type")).alias("type"), F.when(k % 4 != 0, F.col("p_brand")).alias("category"), F.col("p_name").alias("component"))
    read = records.reading(key, answers)
    later = answers.where(F.col("sample_id") % 5 != 0).withColumn("component", F.when(F.col("sample_id") % 7 == 0, F.upper("component")).otherwise(F.col("component")))
    others = answers.where("sample_id % 10 = 0 AND sample_id > 0").withColumn("sample_id", -F.col("sample_id"))
    totals = records.totals(read).first().asDict()
    told = records.differences(read, later.unionByName(others), totals | {"strict": totals["strict"] + 1})
    size = records.key_digest(key).select(F.lit("size").alias("what"), F.lit(None).cast("string").alias("sample"), F.col("size").cast("string").alias("recorded"), F.col("digest").alias("artefact"))
    return size.unionByName(told.select(F.col("kind").alias("what"), F.col("sample_id").cast("string").alias("sample"), "recorded", "artefact"))
