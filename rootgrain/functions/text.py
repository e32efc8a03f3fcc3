"""Text functions as columns, and what needs more than one row."""

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vocab import CATEGORY_KEYWORDS, LOG_SEVERITIES, SENSITIVE, STOP_WORDS


def severity(text: Column) -> Column:
    """A log severity of the vocabulary, or null."""
    upper = F.upper(text)
    return F.when(upper.isin(*LOG_SEVERITIES), upper).when(upper == "WARNING", "WARN")


def fault_type(text: Column) -> Column:
    """A slug: lower case, white space and _ to -, anything else but letters, digits and - dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-"), "[^a-z0-9-]", "")


def _some(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda t: t.rlike(pattern))


def category(slug: Column) -> Column:
    """The first category with a keyword that a token of the slug is, begins with or negates.

    A token matches a keyword when it equals it, is its plural (keywords of 4 letters or more),
    begins with it (5 or more) or does so after mis, non or un. Keywords of several tokens are
    looked for in the slug from each token on.
    """
    tokens = F.split(slug, "-")
    tails = F.transform(tokens, lambda t, i: F.array_join(F.slice(tokens, i + 1, F.size(tokens)), "-"))

    def pattern(keyword: str) -> str:
        alternatives = [keyword]
        if len(keyword) >= 4:
            alternatives += [keyword + "s", keyword + "es"]
        if len(keyword) >= 5:
            alternatives.append(keyword + ".*")
        return "|".join([*alternatives, f"(?:mis|non|un){keyword}.*"])

    out = F.when(F.lit(False), "")
    for name, keywords in CATEGORY_KEYWORDS:
        single = "^(?:" + "|".join(pattern(k) for k in keywords if "-" not in k) + ")$"
        joined = [k for k in keywords if "-" in k]
        hit = _some(tokens, single)
        for k in joined:
            hit = hit | _some(tails, f"^(?:{pattern(k)})$")
        out = out.when(hit, name)
    return out.otherwise("unknown")


def task_tokens(text: Column) -> Column:
    """ASCII words and single CJK characters in lower case, less the stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+|[一-鿿])"), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def grams(text: Column, n: int) -> Column:
    """All character n-grams in order."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def gram_cosines(rows: DataFrame, keys: list[str], a: str, b: str, n: int, name: str) -> DataFrame:
    """(keys, name): the cosine of the n-gram counts of two texts, without case, rounded to 6 places.

    Rows of one key count as one, nulls being equal; keys without any n-gram have no row, those without one on one
    side have 0. A key of one row is counted where the row is, so that n-grams are rows of a plan only for the others.
    """

    @F.pandas_udf("struct<xx:long,yy:long,xy:long>")
    def products(lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        cut = lambda t: Counter(t[i : i + n] for i in range(len(t or "") - n + 1))
        both = ((cut(x), cut(y)) for x, y in zip(lefts, rights, strict=True))
        squares = lambda c: sum(k * k for k in c.values())
        return pd.DataFrame([(squares(x), squares(y), sum(k * y[g] for g, k in x.items() if g in y)) for x, y in both], columns=["xx", "yy", "xy"], dtype="int64")

    # rows of one key stand together, where the order within the first key is by all of them
    by = Window.partitionBy(keys[0]).orderBy(*keys)
    same = lambda of: F.coalesce(of(F.struct(*keys)).over(by) == F.struct(*keys), F.lit(False))
    told = rows.select(*keys, F.lower(a).alias("_a"), F.lower(b).alias("_b"))
    told = told.withColumn("_several", same(F.lag) | same(F.lead))
    single = told.where("NOT _several").withColumn("p", products("_a", "_b")).select(*keys, "p.*")
    sides = F.explode(F.array(F.struct(F.lit(1).alias("x"), F.lit(0).alias("y"), F.col("_a").alias("s")), F.struct(F.lit(0).alias("x"), F.lit(1).alias("y"), F.col("_b").alias("s")))).alias("side")
    cut = told.where("_several").select(*keys, sides).select(*keys, "side.x", "side.y", F.explode(grams(F.col("side.s"), n)).alias("g"))
    counts = cut.groupBy(*keys, "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    several = counts.groupBy(*keys).agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in (("x", "x"), ("y", "y"), ("x", "y"))])
    cosine = F.when((F.col("xx") == 0) | (F.col("yy") == 0), 0.0).otherwise(F.round(F.col("xy") / (F.sqrt("xx") * F.sqrt("yy")), 6))
    return single.where("xx + yy > 0").unionByName(several).select(*keys, cosine.alias(name))


def sensitive(text: Column) -> Column:
    """Whether a pattern of personal data or secrets occurs."""
    out = F.lit(False)
    for p in SENSITIVE:
        out = out | text.rlike(p)
    return out


def looks_like_sentence(text: Column) -> Column:
    trimmed = F.trim(text)
    return (F.length(trimmed) >= 40) & trimmed.endswith(".")


def path_token(text: Column) -> Column:
    """Safe as a part of a path; never empty."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "unnamed").otherwise(out)


def number(value: Column) -> Column:
    """A double as shortest text: no fraction where it is whole, an exponent only below 1e-6 or from 1e21 on."""
    short = value.cast("string")
    size = F.abs(value)
    part = lambda i: F.regexp_extract(short, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
    after, exponent = F.when(part(3) == "0", "").otherwise(part(3)), part(4).cast("int")
    zeros = lambda n: F.repeat(F.lit("0"), n)
    large = F.when(F.length(after) <= exponent, F.concat(part(2), after, zeros(exponent - F.length(after)))).otherwise(F.concat(part(2), F.substr(after, F.lit(1), exponent), F.lit("."), F.substr(after, exponent + 1)))
    plain = F.concat(part(1), F.when(exponent >= 0, large).otherwise(F.concat(F.lit("0."), zeros(-exponent - 1), part(2), after)))
    scientific = F.lower(F.regexp_replace(F.regexp_replace(short, r"\.0E", "E"), "E([0-9])", "E+$1"))
    return F.when((value == F.floor(value)) & (size < 1e15), value.cast("bigint").cast("string")).when(short.contains("E") & (size >= 1e-6) & (size < 1e21), plain).when(short.contains("E"), scientific).otherwise(short)


def csv_cell(text: Column) -> Column:
    """Quoted only where it holds a quote, a comma or a line feed; null is empty."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the code units of a text in the basic plane, 8 hex digits."""
    folded = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("bigint"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("bigint")) * 0x01000193, F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))
