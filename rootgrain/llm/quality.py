"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted;
lines of more documents than the limit are removed; and a document that loses too many of its words
is rejected. Rules on the single text come first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, scratch, stored

#: Rules of the single text.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line that more documents of one host than this hold is boilerplate there.
MAX_DOCUMENTS = 10
#: A document must keep this percentage of its words.
MIN_KEPT_PERCENT = 50
NOT_SYMBOLS = "[^#*$%&|<>]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _equal_neighbours(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words lie in 3-word windows that occur twice or more in the array `words`.

    Windows are compared by a 64-bit hash of their words. Sorted by hash and place, those with an
    equal neighbour are the repeated ones; sorted by place again, each covers its 3 words or those
    up to the next one. Each array is zipped with itself shifted, so that the work is n log n.
    """
    sorted_, at = fresh(df, "_sorted", "_at")
    n = F.size(words) - 2
    triples = F.arrays_zip(*[F.slice(words, k, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)])
    hashed = F.transform(triples, lambda x, i: F.struct(F.xxhash64(x["w1"], x["w2"], x["w3"]).alias("h"), i.alias("i")))
    df = df.withColumn(sorted_, F.sort_array(hashed))
    m = F.size(sorted_)
    nobody = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    near = F.arrays_zip(
        F.concat(nobody, F.slice(sorted_, 1, F.greatest(m - 1, F.lit(0)))).alias("before"), F.col(sorted_).alias("own"), F.slice(sorted_, 2, F.greatest(m - 1, F.lit(0))).alias("after")
    )
    same = lambda x, y: F.coalesce(x["own"]["h"] == x[y]["h"], F.lit(False))
    repeated = F.transform(F.filter(near, lambda x: x["own"].isNotNull() & (same(x, "before") | same(x, "after"))), lambda x: x["own"]["i"])
    df = df.withColumn(at, F.sort_array(repeated))
    steps = F.zip_with(F.col(at), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.withColumn(out, F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")).drop(sorted_, at)


def _lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and base_failed.

    Words are runs of characters other than space and the controls 9 to 13; null texts have none.
    """
    body, words = fresh(docs, "_body", "_words")
    df = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(words, _words(F.col(body)))
    lines = _lines(F.col(body))
    df = df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, NOT_SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    df = _equal_neighbours(df, words, "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop(body, words)


def line_rows(docs: DataFrame, key: Column, text: str, host: str) -> DataFrame:
    """A row for each line with a word: (_host, _h1, _h2, _key, _n), _n its words. _h1 and _h2 are a
    128-bit hash of the normalised line: lower case, digit runs to 0, white space and ASCII
    punctuation to one space. A null host is a host of its own."""
    split = docs.select(key.alias("_key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.explode(_lines(F.coalesce(F.col(text), F.lit("")))).alias("_line"))
    normal = F.trim(F.regexp_replace(F.regexp_replace(F.lower("_line"), "[0-9]+", "0"), r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", " "))
    hashed = split.select("_key", "_host", normal.alias("_normal"), F.size(_words(F.col("_line"))).alias("_n"))
    return hashed.where("_normal <> ''").select("_key", "_host", F.xxhash64("_normal").alias("_h1"), F.xxhash64(F.lit(7), "_normal").alias("_h2"), "_n")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """docs with the columns of base() and n_removed_words (long) and kept.

    n_removed_words counts the words of lines that more than max_documents distinct keys of the same
    host hold. kept is false where base_failed is true or less than MIN_KEPT_PERCENT of the words
    is left. Rows with a null key take part in no line count and lose no line. Documents are told by
    key, text and host: equal rows are one and get the same verdict, rows of one key and different
    texts are documents of their own. Columns of
    the names added are replaced, all others pass through; an empty table gives an empty one.

    All lines are counted, first as rows, which each task sums before the shuffle; only lines of
    more rows than the limit are joined back, and of those the distinct documents are counted.
    """
    line = ["_host", "_h1", "_h2"]
    d, gone, own = fresh(docs, "_d", "_gone", "_own")
    identity = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(host).cast("string").alias("host"))
    with scratch(docs.sparkSession):
        rows = stored(line_rows(docs.where(F.col(key).isNotNull()), identity, text, host), "lines")
        often = rows.groupBy(*line).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_documents).drop("_rows")
        held = stored(rows.join(often, line).groupBy(*line, "_key").agg(F.sum("_n").alias("_n")), "often")
        frequent = held.groupBy(*line).agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_documents).drop("_docs")
        lost = held.join(frequent, line).groupBy("_key").agg(F.sum("_n").alias("_lost"))
        lost = stored(lost.select(F.col("_key").alias(d), F.col("_lost").alias(gone)), "lost", keep=True)
    # equal rows bring each of their lines as often as they are
    copies = docs.select(identity.alias("_key")).join(lost.select(F.col(d).alias("_key")), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_copies"))
    lost = lost.join(copies, F.col(d) == F.col("_key")).select(d, (F.col(gone) / F.col("_copies")).cast("long").alias(gone))
    out = base(docs.withColumn(own, identity), text)
    joined = out.join(lost, F.col(own) == F.col(d), "left")
    removed = F.coalesce(gone, F.lit(0)).cast("long")
    kept = ~F.col("base_failed") & (100 * (F.col("n_words") - removed) >= MIN_KEPT_PERCENT * F.col("n_words"))
    return joined.withColumns({"n_removed_words": removed, "kept": kept}).drop(own, d, gone)


def oracle_sql() -> str:
    """DuckDB SQL for the rows of op4_quality_rules."""
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda w: w <> '') AS ws FROM documents),
l AS (SELECT doc_id, host, ws, t, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
gc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM gc WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, host, s, trim(regexp_replace(regexp_replace(lower(s), '[0-9]+', '0', 'g'), '[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', ' ', 'g')) AS k,
        len(list_filter(string_split_regex(s, '{space}'), lambda w: w <> '')) AS n FROM (SELECT doc_id, host, unnest(ls) AS s FROM l)),
f AS (SELECT host, k FROM x WHERE k <> '' GROUP BY host, k HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}),
r AS (SELECT doc_id, sum(n) AS n FROM x JOIN f USING (host, k) GROUP BY doc_id),
b AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '{NOT_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed_words
      FROM l LEFT JOIN rep USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * (n_words - n_removed_words) >= {MIN_KEPT_PERCENT} * n_words AS kept FROM v
"""
