"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to the letters of a small alphabet: insult, threat, target, negation, reported
speech, other. Five transducers read those letters clause by clause: `insult` pays for insults, and
more for those that follow one another, `threat` pays only for threats with a target, `target`
strengthens insults near a person addressed, `negation` weakens insults and threats that stand
shortly after a negation, `reported` weakens what follows a verb of saying.
They are composed once into one deterministic table; the weight of a clause is what the composed
machine pays for it. What insults there are and what they weigh is learned from labelled documents,
and so is how the clause weights of a document make its score.
"""

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, stored

#: Labelled documents from which the lexicon and the score are fitted, at most (about: a share of the hashed keys).
MAX_LABELLED = 20_000
#: Insults that are learned, at most.
MAX_TERMS = 200
#: Toxic documents that a learned insult must newly explain, and the share of its documents that must be
#: toxic: a weak sign is weighed as one, and a general word beginning beats words that copies have in common.
MIN_SUPPORT = 5
MIN_PRECISION = 0.5
#: Lengths of the word beginnings that are tried beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: From this score on a document counts as toxic.
THRESHOLD = 0.7

INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER = "ITYNRO"
#: Function words of the grammar in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy punch stab shoot strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u he him she her they them this these du dich dir ihr euch er sie tu te toi vous il elle ils elles tú usted ustedes él ella ellos",
    NEGATION: "not no never isn aren wasn weren don doesn didn nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ni",
    REPORTED: "said says say wrote writes claimed claims called calls told reported quoted sagte sagt schrieb behauptet dit écrit affirme dijo dice escribió afirmó",
}
#: Insults that are known before anything is learned, and their weight.
SEEDS = "idiot idiots moron morons stupid scum loser losers worthless pathetic disgusting trash clown filth imbecile dumbass bastard"
SEED_WEIGHT = 3.0
THREAT_WEIGHT = 3.0
#: Words that a negation, and a target, reaches.
REACH = 4

LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass(frozen=True)
class Machine:
    """A deterministic weighted transducer: step(state, letter) -> (state, factor by which the letter counts)."""

    start: object
    step: Callable[[object, str], tuple[object, float]]

    def __matmul__(self, other: "Machine") -> "Machine":
        """Composition: both read the letter, the factors multiply."""

        def step(state, letter):
            a, x = self.step(state[0], letter)
            b, y = other.step(state[1], letter)
            return (a, b), x * y

        return Machine((self.start, other.start), step)

    def table(self) -> dict[int, dict[str, tuple[int, float]]]:
        """The states that can be reached, numbered, with their transitions: bounded by the grammar."""
        numbers, todo, out = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            row = out[numbers[state]] = {}
            for letter in (INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER):
                after, factor = self.step(state, letter)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                row[letter] = (numbers[after], factor)
        return out


def _within(trigger: str, read: str, factor: float, otherwise: float = 1.0, reach: int = REACH) -> Machine:
    """Letters in `read` count by `factor` up to `reach` words after a `trigger`, else by `otherwise`."""

    def step(left: int, letter: str):
        weight = (factor if left else otherwise) if letter in read else 1.0
        return (reach if letter == trigger else max(0, left - 1)), weight

    return Machine(0, step)


def grammar() -> dict[int, dict[str, tuple[int, float]]]:
    negation = _within(NEGATION, INSULT + THREAT, 0.3)
    reported = _within(REPORTED, INSULT + THREAT, 0.6, reach=12)
    target = _within(TARGET, INSULT, 1.3)
    threat = _within(TARGET, THREAT, 0.5, otherwise=0.0)
    insult = _within(INSULT, INSULT, 1.2)
    return (negation @ reported @ target @ threat @ insult).table()


class Lexicon(dict):
    """word -> (letter, weight). terms: "=word" or "stem*" -> weight."""

    def __init__(self, terms: dict[str, float]):
        fixed = {w: (letter, THREAT_WEIGHT if letter == THREAT else 0.0) for letter, words in WORDS.items() for w in words.split()}
        fixed |= {w: (INSULT, SEED_WEIGHT) for w in SEEDS.split()}
        fixed |= {t[1:]: (INSULT, w) for t, w in terms.items() if t[0] == "="}
        stems = {t[:-1]: w for t, w in terms.items() if t[-1] == "*"}

        def look(word: str):
            low = word.lower()
            if low in fixed:
                return fixed[low]
            return next(((INSULT, stems[low[:n]]) for n in reversed(STEMS) if low[:n] in stems and len(low) >= n), None)

        self.of = Memo(look, most=100_000).__getitem__


def features(text: str | None, lexicon: Lexicon, table: dict) -> tuple[float, float, float]:
    """The heaviest clause, the log of the summed weight, and the log of the number of words."""
    words = LETTERS.findall(text or "")
    found = list(map(lexicon.of, words))
    total = best = 0.0
    if any(x is not None and x[0] in (INSULT, THREAT) for x in found):
        for clause in CLAUSE.split(text):
            state, weight = 0, 0.0
            for word in LETTERS.findall(clause):
                letter, own = lexicon.of(word) or (OTHER, 0.0)
                state, factor = table[state][letter]
                weight += own * factor
            total, best = total + weight, max(best, weight)
    return best, math.log1p(total), math.log1p(len(words))


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    coefficients: tuple[float, ...]

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """docs with the score, 0 to 1, of each whole text; null and empty texts get that of a text without words.

        Only the text is read. All other columns pass through, one called like `score` is replaced.
        """
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon, table, coefficients = Lexicon(model.value.terms), grammar(), np.array(model.value.coefficients)
            for series in batches:
                x = np.array([features(t, lexicon, table) for t in series]).reshape(-1, 3)
                yield pd.Series(1 / (1 + np.exp(-(coefficients[0] + x @ coefficients[1:]))))

        return docs.withColumn(score, run(F.col(text).cast("string")))


def held_out(key: str):
    """Whether crc32 of the key as text leaves 1 when divided by 3: such rows teach nothing."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def _learn_terms(sample: DataFrame) -> dict[str, float]:
    """Words and word beginnings that occur in toxic documents more often than in others, chosen one after another, each time the one that explains most toxic documents not yet explained (of
    equals the longest). Copies of a document bring many terms but explain no more, so that few
    general ones are left. Insults known before that bear it out get their learned weight too."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [_beginnings(words, n) for n in STEMS]
    terms = F.explode(F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), *stems)))
    rows = stored(sample.select("k", "toxic", terms.alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"), F.collect_set(F.when(F.col("toxic") == 1, F.col("k"))).alias("ks")).where(f"a >= {MIN_SUPPORT} AND a >= {MIN_PRECISION} * n"), "terms")
    n_toxic, n_all = sample.agg(F.sum("toxic"), F.count("*")).first()
    candidates = {r.term: (r.a, r.n, set(r.ks)) for r in rows.collect()}
    weight = lambda a, n: math.log((a + 0.5) / (n_toxic + 1)) - math.log((n - a + 0.5) / (n_all - n_toxic + 1))
    chosen = {t: weight(*candidates[t][:2]) for w in SEEDS.split() if (t := f"={w}") in candidates}
    while candidates and len(chosen) < MAX_TERMS:
        # Counts only fall, so that a term is looked at again only while it can still be the best.
        best = max(candidates, key=lambda t: (len(candidates[t][2]), t[0] == "=", len(t), t))
        a, n, keys = candidates.pop(best)
        if len(keys) < MIN_SUPPORT:
            break
        chosen[best] = weight(a, n)
        covered = set(keys)
        candidates = {t: (x, y, left) for t, (x, y, ks) in candidates.items() if len(left := ks - covered) >= MIN_SUPPORT}
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic regression; the constant is not penalised."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [penalty] * (x.shape[1] - 1)) * max(1, len(x)) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled documents that are not held out.

    At most about max_labelled of them are used, chosen by a hash of the key; null keys, labels and
    texts teach nothing, of repeated keys the largest label and text count. With no labelled
    document of both kinds the known insults are used with a fixed score.
    """
    own = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).where("k IS NOT NULL AND toxic IN (0, 1)").where(~held_out("k"))
    n = own.count()
    share = min(1.0, max_labelled / max(n, 1))
    own = own.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000).groupBy("k").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).where("k IS NOT NULL AND text IS NOT NULL")
    # own has about max_labelled rows at most, which bounds what is broadcast
    sample = stored(texts.join(F.broadcast(own), "k"), "labelled")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model({}, (-3.0, 1.0, 1.0, 0.0))
    terms = _learn_terms(sample)
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, table = Lexicon(sent.value), grammar()
        for series in batches:
            yield pd.Series([list(features(t, lexicon, table)) for t in series])

    rows = sample.select("toxic", read("text").alias("x")).collect()
    b = _logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float))
    return Model(terms, tuple(map(float, b)))
