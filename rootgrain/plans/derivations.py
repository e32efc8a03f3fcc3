"""Registered queries of categories that follow from types and components."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import CATEGORY_KEYWORDS, FAULT_CATEGORIES
from ..operators import derivations
from .queries import query
from .views import table

_WORDS = ("redis", "Network latency", "cpu_stress", "pod-kill", "regex", "misconfiguration", "third-party-sdk", "planet", "feature flag misconfiguration", "queue-disk", "drops", "")


def _pick(values: tuple[str, ...], number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_SAMPLES = f"SELECT p_partkey, CASE WHEN p_partkey % 13 > 0 THEN trim({_pick(_WORDS, 'p_partkey')} || ' ' || p_type) END AS type, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE {_pick(FAULT_CATEGORIES, 'p_size')} END AS category FROM part"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").selectExpr("p_partkey", "p_type", f"{_pick(_WORDS, 'p_partkey')} AS word", f"{_pick(FAULT_CATEGORIES, 'p_size')} AS label")
    return rows.selectExpr("p_partkey AS sample_id", "CASE WHEN p_partkey % 13 > 0 THEN trim(word || ' ' || p_type) END AS type", "CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE label END AS category")


def _token(keyword: str) -> str:
    plural = "(s|es)?" if len(keyword) >= 4 else ""
    return f"{keyword}{plural}" + (f"|{keyword}.*" if len(keyword) >= 5 else "") + f"|(mis|non|un){keyword}.*"


_SLUG = r"regexp_replace(regexp_replace(lower(trim(type)), '[\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g')"


def _rule(name: str) -> str:
    """SQL of the rule: tokens that match a keyword, keywords of several tokens from any token on."""
    keywords = dict(CATEGORY_KEYWORDS)[name]
    single = "|".join(_token(k) for k in keywords if "-" not in k)
    several = "".join(f" OR regexp_matches('-' || slug, '-(mis|non|un)?{k}')" for k in keywords if "-" in k)
    return f"WHEN len(list_filter(string_split(slug, '-'), lambda t: regexp_full_match(t, '{single}'))) > 0{several} THEN '{name}'"


_RULE = "CASE " + " ".join(_rule(name) for name, _ in CATEGORY_KEYWORDS) + " ELSE 'unknown' END"
_LETTERS = "CASE " + " ".join(f"WHEN regexp_matches(slug, '{'|'.join(ks)}') THEN '{c}'" for c, ks in CATEGORY_KEYWORDS) + " ELSE 'unknown' END"
_ROWS = "coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN list_has_any(string_split(slug, '-'), {list(ks)}) THEN '{c}' END" for c, ks in CATEGORY_KEYWORDS) + "), ''), 'unknown')"
_READ = f"SELECT *, {_RULE} AS derived, {_LETTERS} AS by_letters, {_ROWS} AS by_all_rows, trim(category) <> '' AS labelled FROM (SELECT *, {_SLUG} AS slug FROM s) WHERE trim(type) <> ''"


@query(f"WITH s AS ({_SAMPLES}), r AS ({_READ}) SELECT p_partkey AS sample_id, derived, by_letters, by_all_rows, CASE WHEN labelled THEN derived = category END AS conforms FROM r")
def category_readings(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of each type, and whether its label follows from the rule."""
    return derivations.readings(_samples(spark, d)).select("sample_id", "derived", "by_letters", "by_all_rows", "conforms")


@query(f"""WITH s AS ({_SAMPLES}), r AS ({_READ}), c AS (SELECT count(*) FILTER (labelled) AS graded, count(*) FILTER (labelled AND derived = category) AS conforming, count(*) AS typed, count(*) FILTER (derived <> 'unknown') AS defined FROM r)
SELECT graded, conforming, conforming / graded AS share, graded = conforming AS conforms, typed, defined, typed = defined AS total FROM c""")
def category_conformance(spark: SparkSession, d: str) -> DataFrame:
    return derivations.conformance(_samples(spark, d))


@query(f"""WITH s AS ({_SAMPLES}), r AS ({_READ}), t AS (SELECT type, count(*) AS n, bool_or(by_letters <> category) AS letters, bool_or(by_all_rows <> category) AS rows_ FROM r GROUP BY type),
c AS (SELECT sum(n)::BIGINT AS graded, count(*) FILTER (letters) AS differ_letters, count(*) FILTER (rows_) AS differ_rows, count(*) FILTER (letters OR rows_) AS differ FROM t) SELECT *, differ / graded AS share, differ / graded > 0.2 AS separates FROM c""")
def category_power(spark: SparkSession, d: str) -> DataFrame:
    return derivations.power(_samples(spark, d))


_MISSES = "SELECT l_returnflag || l_linestatus AS run, l_partkey AS sample_id, CASE WHEN l_suppkey % 9 > 0 THEN word END AS type, CASE l_quantity % 3 WHEN 0 THEN 'middleware' WHEN 1 THEN 'network' ELSE 'unknown' END AS category"


@query(f"""WITH s AS ({_MISSES} FROM (SELECT *, {_pick(_WORDS, 'l_suppkey')} AS word FROM lineitem)), r AS ({_READ}), p AS (SELECT sample_id, run, bool_or(derived = category) AS c FROM r GROUP BY ALL)
SELECT sample_id, count(*) AS n_graded, count(*) FILTER (c) AS n_consistent, bool_or(c) AS ever, count(*) FILTER (c) = (SELECT count(DISTINCT run) FROM s) AS stable FROM p GROUP BY sample_id""")
def miss_stability(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was answered about a part hangs together in every run (the statuses of its lines)."""
    rows = table(spark, d, "lineitem").selectExpr("*", f"{_pick(_WORDS, 'l_suppkey')} AS word")
    return derivations.stability(rows.selectExpr(*_MISSES.removeprefix("SELECT ").split(", ")))


_TERMS = "list_filter(CASE category " + " ".join(f"WHEN '{c}' THEN {list(ks)}" for c, ks in CATEGORY_KEYWORDS) + " ELSE [] END, lambda t: contains(low, t))"
_ANSWERS = f"SELECT {{}} AS id, coalesce(text, '') AS component, lower(coalesce(text, '')) AS low, {_pick(FAULT_CATEGORIES, 'strlen(text)')} AS category FROM {{}}"
_AGREES = rf"SELECT *, {_TERMS} AS terms, regexp_matches(component, '\S') AS told FROM"


def _answers(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).selectExpr(f"{key} AS id", "text AS component", f"{_pick(FAULT_CATEGORIES, 'octet_length(text)')} AS category")


@query(f"WITH a AS ({_ANSWERS.format('doc_id', 'documents')}), r AS ({_AGREES} a) SELECT id AS doc_id, CASE WHEN NOT told THEN 'not-assessable' WHEN len(terms) > 0 THEN 'agrees' ELSE 'disagrees' END AS verdict, array_to_string(terms, ',') AS terms FROM r")
def component_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document, as a component, holds a term of a category."""
    a, both = _answers(spark, d, "documents", "doc_id"), (F.col("component"), F.col("category"))
    return a.select(F.col("id").alias("doc_id"), derivations.agreement(*both).alias("verdict"), F.array_join(derivations.supporting_terms(*both), ",").alias("terms"))


@query(f"""WITH a AS ({_ANSWERS.format('doc_id', 'documents')}), b AS ({_ANSWERS.format('item_id', 'benchmark')}), p AS (SELECT count(*) AS g, count(*) FILTER (len(terms) > 0) AS n FROM ({_AGREES} a) WHERE told), e AS (SELECT count(*) AS g, count(*) FILTER (len(terms) > 0) AS n FROM ({_AGREES} b) WHERE told)
SELECT e.g AS expected_graded, e.n AS expected_supporting, p.g AS predicted_graded, p.n AS predicted_supporting, e.n / e.g AS expected_share, p.n / p.g AS predicted_share, e.n / e.g - p.n / p.g AS share_delta, e.n / e.g > 0.2 AS separates FROM e, p""")
def agreement_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items against documents: both shares, and whether the first is high enough to tell anything."""
    return derivations.contrast(_answers(spark, d, "benchmark", "item_id"), _answers(spark, d, "documents", "doc_id"))
