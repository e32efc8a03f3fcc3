"""Reading free text against a vocabulary of faults: denials, counter-evidence, and near misses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import CATEGORY_KEYWORDS

#: What turns a clause into a denial.
DENIALS = ("no ", "not ", "never ", "unchanged", "normal", "healthy", "current", "well under", "absent", "zero ")
#: Words of a fault's name that tell nothing.
UNINFORMATIVE = "a an the of to in on at by and or error errors failure failures fault issue problem".split()


def clauses(text: Column) -> Column:
    """The clauses of a text: sentences, cut at commas."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+|,\s+"), lambda c: F.trim(c)), lambda c: c != "")


def _some(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def denial(text: Column, category: str) -> Column:
    """Whether a category's words occur only in denying clauses (denied-only), in another one too
    (also-asserted), nowhere (absent); not-assessable for a blank text."""
    terms = dict(CATEGORY_KEYWORDS).get(category, ())
    low = F.lower(text)
    of_term = F.filter(clauses(low), lambda c: _some(c, terms))
    asserted = F.exists(of_term, lambda c: ~_some(c, DENIALS))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "not-assessable").when(~_some(low, terms), "absent").when(asserted, "also-asserted").otherwise("denied-only")


def counter_evidence(text: Column, phrases: tuple[str, ...]) -> Column:
    """struct(verdict, phrase): the first phrase of the list that the text holds."""
    found = F.when(F.lit(False), "")
    for p in phrases:
        found = found.when(F.lower(text).contains(p), p)
    verdict = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "not-assessable").when(found.isNull(), "counter-evidence-absent").otherwise("counter-evidence-present")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "counter-evidence-present", found).alias("phrase"))


def slug_tokens(slug: Column) -> Column:
    return F.filter(F.split(F.lower(slug), "[^a-z0-9]+"), lambda t: (t != "") & ~t.isin(*UNINFORMATIVE))


def _common_start(a: Column, b: Column) -> Column:
    """How many first characters two words share."""
    ends = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.coalesce(F.array_max(F.filter(ends, lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))), F.lit(0))


def adjudicate(expected: Column, actual: Column) -> Column:
    """struct(verdict, basis) for an answer that is not the expected one.

    same-fault-different-altitude where both slugs share a telling word, or the first letters of two:
    a whole word of three letters or more, or five letters of both. different-fault where both tell
    something and share nothing; undecided otherwise, and without an answer.
    """
    a, b = slug_tokens(expected), slug_tokens(actual)
    word = F.try_element_at(F.filter(a, lambda t: F.array_contains(b, t)), F.lit(1))

    def stem(t: Column, u: Column) -> Column:
        n = _common_start(t, u)
        whole = (n == F.length(t)) | (n == F.length(u))
        return F.when(((n >= 3) & whole) | (n >= 5), F.substr(t, F.lit(1), n))

    stems = F.flatten(F.transform(a, lambda t: F.transform(b, lambda u: stem(t, u))))
    basis = F.coalesce(word, F.try_element_at(F.filter(stems, lambda s: s.isNotNull()), F.lit(1)))
    verdict = F.when(actual.isNull(), "undecided").when(basis.isNotNull(), "same-fault-different-altitude").when((F.size(a) == 0) | (F.size(b) == 0), "undecided").otherwise("different-fault")
    return F.struct(verdict.alias("verdict"), F.when(actual.isNotNull(), basis).alias("basis"))


def counter_evidence_rates(rows: DataFrame, verdict: str, missed: str) -> DataFrame:
    """(assessed, present, misses, precision, recall) of present counter-evidence as a sign of a miss;
    0 where there is nothing to divide by."""
    present, miss = F.col(verdict) == "counter-evidence-present", F.col(missed)
    both = F.count_if(present & miss)
    rate = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return rows.where(F.col(verdict) != "not-assessable").agg(F.count("*").alias("assessed"), F.count_if(present).alias("present"), F.count_if(miss).alias("misses"), rate(both, F.count_if(present)).alias("precision"), rate(both, F.count_if(miss)).alias("recall"))
