"""Whether a category follows from what stands beside it: from the type of a fault by the rule of the
vocabulary, or from the component that the same answer names.

samples: sample_id, type, category. Blank and null fields were not read and count in no denominator;
shares are 0 where nothing was read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vocab import CATEGORY_KEYWORDS

#: Fixed values of the data model: a share up to which a reading tells nothing, words beyond the vocabulary that may get a category.
FLOOR = 0.2
ALLOWANCE = 0


def _told(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def by_rule(fault_type: Column) -> Column:
    return text.category(text.fault_type(fault_type))


def by_letters(fault_type: Column) -> Column:
    """Another reading: the first category with a keyword anywhere within the slug, even inside a word."""
    slug, out = text.fault_type(fault_type), F.when(F.lit(False), "")
    for name, keywords in CATEGORY_KEYWORDS:
        out = out.when(slug.rlike("|".join(keywords)), name)
    return out.otherwise("unknown")


def by_all_rows(fault_type: Column) -> Column:
    """Another reading: all categories with a keyword that a token is, comma-joined, whatever their order means."""
    tokens = F.split(text.fault_type(fault_type), "-")
    hits = F.concat_ws(",", *[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, keywords))), name) for name, keywords in CATEGORY_KEYWORDS])
    return F.when(hits == "", "unknown").otherwise(hits)


def readings(samples: DataFrame) -> DataFrame:
    """samples that tell a type, with derived, by_letters and by_all_rows, and conforms (null without a category)."""
    t = F.col("type")
    told = samples.where(_told(t)).withColumns({"derived": by_rule(t), "by_letters": by_letters(t), "by_all_rows": by_all_rows(t)})
    return told.withColumn("conforms", F.when(_told(F.col("category")), F.col("derived") == F.col("category")))


def conformance(samples: DataFrame) -> DataFrame:
    """(graded, conforming, share, conforms, typed, defined, total): one row. Samples with type and category are
    graded and conform where the type gives the category; types that give one at all are defined, and the rule
    is total if all do. The rows of readings() name the others."""
    same = F.col("derived") == F.col("category")
    graded = _told(F.col("category"))
    told = samples.where(_told(F.col("type"))).withColumn("derived", by_rule(F.col("type")))
    row = told.agg(F.count_if(graded).alias("graded"), F.count_if(graded & same).alias("conforming"), F.count(F.lit(1)).alias("typed"), F.count_if(F.col("derived") != "unknown").alias("defined"))
    g, c = F.col("graded"), F.col("conforming")
    return row.select("graded", "conforming", _share(c, g).alias("share"), (g == c).alias("conforms"), "typed", "defined", (F.col("typed") == F.col("defined")).alias("total"))


def excess(words: DataFrame, word: str = "word", allowance: int = ALLOWANCE) -> DataFrame:
    """(tested, classified, by_letters, share, within): one row; how many words get a category as the beginning of
    a slug that has none itself. Null words are left out."""
    slug = F.concat(F.col(word), F.lit("-service"))
    row = words.where(F.col(word).isNotNull()).agg(F.count(F.lit(1)).alias("tested"), F.count_if(by_rule(slug) != "unknown").alias("classified"), F.count_if(by_letters(slug) != "unknown").alias("by_letters"))
    return row.select("*", _share(F.col("classified"), F.col("tested")).alias("share"), (F.col("classified") <= allowance).alias("within"))


def power(samples: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(graded, differ_letters, differ_rows, differ, share, separates): one row. The types that another reading puts
    elsewhere than the label, each once, against all samples that tell a type; up to the floor the rule's
    agreement with the labels tells nothing. Samples are counted by type and label before they are read."""
    label = F.coalesce("category", F.lit(""))
    pairs = samples.where(_told(F.col("type"))).groupBy("type", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    differs = lambda reading: F.max(reading(F.col("type")) != F.col("label"))
    types = pairs.groupBy("type").agg(F.sum("n").alias("n"), differs(by_letters).alias("letters"), differs(by_all_rows).alias("rows"))
    row = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("graded"), F.count_if("letters").alias("differ_letters"), F.count_if("rows").alias("differ_rows"), F.count_if(F.col("letters") | F.col("rows")).alias("differ"))
    share = _share(F.col("differ"), F.col("graded"))
    return row.select("*", share.alias("share"), (share > floor).alias("separates"))


def coherent(misses: DataFrame) -> DataFrame:
    """misses (run, sample_id, type, category: as answered) that tell a type, with derived, consistent (the answered
    type gives the answered category) and reachable (some type does)."""
    told = misses.where(_told(F.col("type"))).withColumn("derived", by_rule(F.col("type")))
    known = F.col("category").isin(*[name for name, _ in CATEGORY_KEYWORDS])
    return told.withColumns({"consistent": F.coalesce(F.col("derived") == F.col("category"), F.lit(False)), "reachable": F.coalesce(known, F.lit(False))})


def runs(misses: DataFrame) -> DataFrame:
    """(run, graded, consistent, reachable, none_consistent)."""
    row = coherent(misses).groupBy("run").agg(F.count(F.lit(1)).alias("graded"), F.count_if("consistent").alias("consistent"), F.count_if("reachable").alias("reachable"))
    return row.withColumn("none_consistent", F.col("consistent") == 0)


def stability(misses: DataFrame) -> DataFrame:
    """(sample_id, n_graded, n_consistent, ever, stable): in how many runs a sample tells a type and is consistent
    (in one run: any of its rows), and whether in any and in all runs of the table, also those without it."""
    n_runs = misses.agg(F.count_distinct("run").alias("n_runs"))
    per = coherent(misses).groupBy("sample_id", "run").agg(F.max("consistent").alias("c"))
    told = per.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_graded"), F.count_if("c").alias("n_consistent")).join(F.broadcast(n_runs))  # one row
    return told.select("sample_id", "n_graded", "n_consistent", (F.col("n_consistent") > 0).alias("ever"), (F.col("n_consistent") == F.col("n_runs")).alias("stable"))


def supporting_terms(component: Column, category: Column) -> Column:
    """The terms of a category that a component holds, in the vocabulary's order; none for a category without terms."""
    entries = [x for name, keywords in CATEGORY_KEYWORDS for x in (F.lit(name), F.array(*map(F.lit, keywords)))]
    terms = F.coalesce(F.try_element_at(F.create_map(*entries), F.coalesce(category, F.lit(""))), F.array().cast("array<string>"))
    # an array of one, so that a long text is lowered once and not for every term
    return F.transform(F.array(F.lower(F.coalesce(component, F.lit("")))), lambda low: F.filter(terms, lambda t: F.contains(low, t)))[0]


def agreement(component: Column, category: Column) -> Column:
    """agrees, disagrees, or not-assessable without a component."""
    return F.when(~_told(component), "not-assessable").when(F.size(supporting_terms(component, category)) > 0, "agrees").otherwise("disagrees")


def inventory(answers: DataFrame) -> DataFrame:
    """(graded, agrees, disagrees, not_assessable, disagree_share) of answers (component, category): one row."""
    told = answers.select(agreement(F.col("component"), F.col("category")).alias("v"))
    n = lambda v: F.count_if(F.col("v") == v)
    row = told.agg((n("agrees") + n("disagrees")).alias("graded"), n("agrees").alias("agrees"), n("disagrees").alias("disagrees"), n("not-assessable").alias("not_assessable"))
    return row.withColumn("disagree_share", _share(F.col("disagrees"), F.col("graded")))


def contrast(expected: DataFrame, predicted: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One row: graded, supporting and share of the expected and of the predicted answers, share_delta, and separates:
    whether the expected ones agree often enough, above the floor, that a lower share of the others tells anything."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), agreement(F.col("component"), F.col("category")).alias("v"))
    both = side(expected, "expected").unionByName(side(predicted, "predicted")).where("v <> 'not-assessable'")
    counts = [c for s in ("expected", "predicted") for c in (F.count_if(F.col("side") == s).alias(f"{s}_graded"), F.count_if((F.col("side") == s) & (F.col("v") == "agrees")).alias(f"{s}_supporting"))]
    row = both.agg(*counts).withColumns({f"{s}_share": _share(F.col(f"{s}_supporting"), F.col(f"{s}_graded")) for s in ("expected", "predicted")})
    return row.withColumns({"share_delta": F.col("expected_share") - F.col("predicted_share"), "separates": F.col("expected_share") > floor})
