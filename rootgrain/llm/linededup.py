"""Line de-duplication with a suffix array over line identifiers, in DataFrame functions only.

The lines of all documents are one collection of sequences of line identifiers. Their suffixes are
sorted by prefix doubling: ranks of the first h lines, taken in pairs h lines apart, give the ranks
of the first 2h. Suffixes whose first h lines occur once are settled and drop out, so that each
round works on the repeated runs only, and the doubling ends when no run of its length repeats.
Suffixes of equal rank at length h are an interval of the suffix array whose longest common prefix
has h lines or more.

The exact longest run that starts at a place and also starts at an earlier one is then found by
descending through the intervals: each interval is split by what follows, half as many lines at a
time; of each part the first member stands for all others in the interval it came from. A run is a
later copy, wherever it ends, and goes if it has enough words.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, fresh, scratch, stored

#: A repeated run is deleted from this many words on, whether they stand in one line or in many.
MIN_WORDS = 10
#: White space that does not count at a line's ends.
ENDS = " \t\n\x0b\x0c\r"


def _identity(key: Column, text: Column) -> Column:
    """What tells documents apart: their key and the hash of their text, as a struct, so that null keys join too."""
    return F.struct(key.alias("k"), F.xxhash64(text).alias("th"))


def _place() -> Column:
    return F.struct("d", "i")


def _trimmed(s: Column) -> Column:
    """s without white space at its ends. Few lines have any: btrim, which goes through a line's characters
    one by one, is only for those."""
    some = reduce(Column.__or__, [f(F.lit(c)) for c in ENDS for f in (s.startswith, s.endswith)])
    return F.when(some, F.btrim(s, F.lit(ENDS))).otherwise(s)


def line_sequence(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, i, line, h1, h2, w): the i-th line with a word of document d (key and text hash), its number
    among all lines, the two halves of its 128-bit identifier and its number of words, which is counted
    up to min_words: whether lines have that many together does not depend on more. White space at its
    ends doesn't count."""
    named = docs.where(F.col(text).isNotNull()).select(_identity(F.col(key), F.col(text)).alias("d"), F.col(text).alias("text"))
    numbered = F.transform(F.split("text", "\n"), lambda s, n: F.struct(n.alias("line"), _trimmed(s).alias("s")))
    # beside the generator d would be computed for each line anew
    rows = named.select("d", F.posexplode(F.filter(numbered, lambda x: x["s"] != "")).alias("i", "x")).select("d", "i", "x.line", "x.s")
    return rows.select("d", "i", "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), F.size(F.split("s", SPACES, max(1, min_words))).alias("w"))


def _ranked(classes: DataFrame, *order: str) -> DataFrame:
    """classes with a rank that ascends in the given order: a range-partitioned sort, numbered."""
    return stored(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def recurring(lines: DataFrame) -> DataFrame:
    """The rows of lines that occur more than once, rows of equal documents once."""
    lines = stored(lines, "lines")
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(lines.join(often, ["h1", "h2"]).dropDuplicates(["d", "i"]), "recurring")


def suffix_levels(rows: DataFrame) -> list[DataFrame]:
    """One table for each doubling, of run length 1, 2, 4 and so on: (d, i, rank, n, first), a row for
    each place where a run of that many lines begins that occurs more than once. rank orders the
    suffixes by that many lines, n is the size of the interval, first its first place."""
    classes = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    level = stored(rows.join(_ranked(classes, "h1", "h2"), ["h1", "h2"]).select("d", "i", "rank", "n", "first"), "level")
    levels, length = [], 1
    while not level.isEmpty():
        levels.append(level)
        ahead = Window.partitionBy("d").orderBy("i").rangeBetween(length, length)
        paired = stored(level.select("d", "i", F.col("rank").alias("before"), F.max("rank").over(ahead).alias("after")).where("after IS NOT NULL"), "pairs")
        classes = paired.groupBy("before", "after").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
        length *= 2
        level = stored(paired.join(_ranked(classes, "before", "after"), ["before", "after"]).select("d", "i", "rank", "n", "first"), "level")
    return levels


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(d, i, l, origin): l is the number of lines of the longest run from this place on that also
    starts at an earlier place, origin the first of those; places without one have no row.

    At level a a place is later if it isn't the first of its interval. Places that are later at level
    a but not at a + 1 have a length of 2**a and less than twice that; they are sought in the interval
    less the places that are later at a + 1, whose first members stand for them. An interval is named
    by its first place and its length. In each round it is split by the next half of lines: members of
    a part that aren't its first go on with the longer run, the first goes with them as the place that
    they copy, and stays to be tried with fewer lines in the interval of all firsts.
    """
    every = reduce(DataFrame.unionByName, [level.select("d", "i", F.lit(a).alias("a"), "rank", "first") for a, level in enumerate(levels)])
    last = F.max(F.when(F.col("first") != _place(), F.col("a"))).over(Window.partitionBy("d", "i"))
    top = F.max("a").over(Window.partitionBy("d"))
    every = stored(every.repartition("d").withColumns({"last": F.coalesce(last, F.lit(-1)), "top": top}), "intervals")
    # at level 0 nothing is left to be tried, so that no place is needed there for others
    state = every.where("last = a OR (last < a AND a > 0)")
    state = state.select("d", "i", "a", F.expr("shiftleft(1, a)").alias("l"), F.col("first").alias("origin"), (F.col("last") == F.col("a")).alias("asks"))
    ranks = every.select("d", F.col("i").alias("at"), F.expr("shiftleft(1, a)").alias("step"), F.col("rank").alias("next"), "a", "top")
    done = []
    for round_ in range(len(levels) - 1):
        done.append(state.where(F.col("a") <= round_))
        going = state.where(F.col("a") > round_).withColumns({"step": F.expr(f"shiftleft(1, a - 1 - {round_})"), "at": F.col("i") + F.col("l")})
        # asked for are only ranks that many levels below the document's highest
        asked = ranks.where(F.col("a") + round_ < F.col("top")).drop("a", "top")
        joined = stored(going.join(asked, ["d", "at", "step"], "left"), "ahead")
        found = joined.where("next IS NOT NULL")
        parts = found.groupBy("origin", "l", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("head")).where("n > 1").drop("n")
        moved = F.struct((F.col("l") + F.col("step")).alias("l"), F.col("head").alias("origin"), (F.col("asks") & (_place() != F.col("head"))).alias("asks"))
        stay = F.struct("l", "origin", "asks")
        on = F.when(F.col("head").isNull(), F.array(stay)).when(_place() == F.col("head"), F.array(moved, stay)).otherwise(F.array(moved))
        split = found.join(parts, ["origin", "l", "next"], "left").select("d", "i", "a", F.explode(on).alias("x")).select("d", "i", "a", "x.*")
        state = stored(split.unionByName(joined.where("next IS NULL").select("d", "i", "a", "l", "origin", "asks")), "descent")
    return reduce(DataFrame.unionByName, [*done, state]).where("asks").select("d", "i", "l", "origin")


def later_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, i, line, l, origin, gone, maximal): a row for each recurring line. gone says that it lies in a
    later copy of a run of min_words words or more; l and origin are the length, in lines, and the
    first place of the longest such run that begins there (null: none), maximal that no run which
    begins before reaches as far."""
    rows = recurring(line_sequence(docs, key, text, min_words))
    levels = suffix_levels(rows)
    sums = rows.select("d", "i", "line", "w", F.sum("w").over(Window.partitionBy("d").orderBy("i")).alias("c"))
    if not levels:
        nothing = F.lit(None).cast(f"struct<d:{rows.schema['d'].dataType.simpleString()},i:int>")
        return sums.select("d", "i", "line", F.lit(None).cast("int").alias("l"), nothing.alias("origin"), F.lit(False).alias("gone"), F.lit(False).alias("maximal")).limit(0)
    sums = stored(sums, "sums")
    ends = sums.select("d", F.col("i").alias("end"), F.col("c").alias("c_end"))
    runs = longest_earlier(levels).withColumn("end", F.col("i") + F.col("l") - 1).join(ends, ["d", "end"])
    each = sums.join(runs, ["d", "i"], "left").withColumn("enough", F.coalesce(F.col("c_end") - F.col("c") + F.col("w") >= min_words, F.lit(False)))
    before = Window.partitionBy("d").orderBy("i")
    reach = F.when(F.col("enough"), F.col("end"))
    each = each.select("d", "i", "line", F.when(F.col("enough"), F.col("l")).alias("l"), F.when(F.col("enough"), F.col("origin")).alias("origin"), (F.coalesce(F.max(reach).over(before), F.lit(-1)) >= F.col("i")).alias("gone"),
                       (F.col("enough") & (F.col("end") > F.coalesce(F.max(reach).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))).alias("maximal"))
    return each


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` less the lines of later copies, and with n_lines, n_removed, n_runs, longest_run (long).

    A run is one line or any number of lines on end, with min_words words or more together; lines
    without a word do not count, neither does white space at a line's ends. Of equal runs the first in
    order of (key, null first, hash of the text, line) stays, whatever else of it is removed; every
    line of the others goes, with its line end. n_lines counts the lines with a word, n_removed the
    removed ones, n_runs the stretches that they form, longest_run the lines of the longest later
    copy. A text without removed lines is unchanged, a null text stays null with zeros. Rows of equal
    key and text are one document and get the same result; rows of one key and different texts, and
    null keys, are documents of their own. Columns of these names are replaced, all others pass
    through; an empty table gives an empty one.
    """
    with scratch(docs.sparkSession):
        gone = stored(later_runs(docs, key, text, min_words).where("gone").select("d", "i", "line", "l"), "later", keep=True)
    before = F.lag("i").over(Window.partitionBy("d").orderBy("i"))
    starts = gone.withColumn("starts", (before.isNull() | (before != F.col("i") - 1)).cast("long"))
    split, d, lines, runs, longest = fresh(docs, "_split", "_d", "_lines", "_runs", "_longest")
    per = starts.groupBy(F.col("d").alias(d)).agg(F.collect_list("line").alias(lines), F.sum("starts").alias(runs), F.max("l").alias(longest))
    joined = docs.join(per, _identity(F.col(key), F.col(text)) == F.col(d), "left").withColumn(split, F.split(text, "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lines))
    whole = F.array_join(F.transform(kept, lambda j: F.col(split)[j]), "\n")
    n_lines = F.size(F.filter(split, lambda s: F.ltrim(s, F.lit(ENDS)) != ""))
    added = {
        text: F.when(F.col(lines).isNull(), F.col(text)).otherwise(whole),
        "n_lines": F.when(F.col(split).isNull(), 0).otherwise(n_lines).cast("long"),
        "n_removed": F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_runs": F.coalesce(runs, F.lit(0)).cast("long"),
        "longest_run": F.coalesce(longest, F.lit(0)).cast("long"),
    }
    return joined.withColumns(added).drop(split, d, lines, runs, longest)


def oracle_sql() -> str:
    """DuckDB SQL for the rows of op8_line_dedup: every pair of equal lines lies on a diagonal, on which
    neighbours join to maximal runs. Texts of one key are taken to be equal."""
    return f"""
WITH s AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, line, regexp_replace(s, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS s FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, len(string_split_regex(s, '[\\x20\\x09-\\x0D]+')) AS w FROM w WHERE s <> ''),
p AS (SELECT a.doc_id, a.i, a.w, b.doc_id AS o, a.i - b.i AS shift FROM l a JOIN l b ON a.s = b.s AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
q AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, o, shift ORDER BY i) AS island FROM p),
r AS (SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n FROM q GROUP BY doc_id, o, shift, island HAVING sum(w) >= {MIN_WORDS}),
m AS (SELECT doc_id, max(n) AS longest FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM r),
g AS (SELECT l.doc_id, l.line, l.i, x.i IS NOT NULL AS gone FROM l LEFT JOIN x USING (doc_id, i)),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM g),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs FROM h GROUP BY doc_id),
t AS (SELECT s.doc_id, string_agg(s.s, chr(10) ORDER BY s.line) AS text FROM s LEFT JOIN h ON h.doc_id = s.doc_id AND h.line = s.line WHERE NOT coalesce(h.gone, false) GROUP BY s.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest_run, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)
"""
