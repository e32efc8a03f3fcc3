"""Helpers that the operators share: shared-folder tables, word splitting, word hashes."""

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than space and the ASCII controls 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Spark's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where nobody set it (tests on one machine) a temporary folder is made.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path:
        held = context._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="rootgrain-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Jobs started within hand Python batches of about `most` bytes, so that a task's memory does not
    follow the length of the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: The paths that stored() wrote within each scratch() that is open, the innermost last.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there. Within a
    scratch() the table goes at its end, unless it is to be kept, then at the end of the one around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rootgrain/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes within are deleted at the end, and the shuffles behind them, which
    Spark drops once the driver has collected their plans."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            removed(spark, path)
        gc.collect()  # plans that only cycles of Python objects hold
        spark._jvm.System.gc()


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that df does not have."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


#: Bits of the fixed-size filter of maybe_in.
FILTER_BITS = 1 << 24


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> Column:
    """A condition on df that holds wherever `key` occurs in keys as `of`, and by chance elsewhere.

    The filter has one bit for each of FILTER_BITS hash values, whatever the size of keys: 2 MB go
    through the driver. It keeps rows that cannot match out of a shuffle; a join still decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    at = keys.select((bit(of) + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    some = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        some[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(some.ravel())

    @F.pandas_udf("boolean")
    def maybe(bits: pd.Series) -> pd.Series:
        b = bits.to_numpy()
        return pd.Series((sent.value[b >> 3] >> (b & 7) & 1).astype(bool))

    return maybe(bit(key))


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df less the rows whose key is in `gone` (one column); rows with a null key stay. Only rows that
    the filter cannot clear are shuffled."""
    name, hit = fresh(df, "_gone", "_hit")
    gone = gone.toDF(name).where(F.col(name).isNotNull()).distinct()
    marked = df.withColumn(hit, F.coalesce(maybe_in(df, F.col(key), gone, F.col(name)), F.lit(False)))
    rest = marked.where(F.col(hit)).join(gone, F.col(key) == F.col(name), "left_anti")
    return marked.where(~F.col(hit)).unionByName(rest).drop(hit)


class Memo(dict):
    """A dictionary that computes what it lacks and never holds more than `most` entries of up to `longest` characters."""

    def __init__(self, compute, most: int = 200_000, longest: int = 80, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.compute, self.most, self.longest, self.fixed = compute, most, longest, fixed or {}

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
                self.update(self.fixed)
            self[word] = value
        return value


#: Fixed odd multipliers, one for each place of a window of words.
PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(64)]
_NEAR, _FAR = np.random.default_rng(7).integers(1, 2**64, (2, 256), np.uint64) | np.uint64(1)
#: The first 256 bytes are weighed by _NEAR alone, so that a word's hash does not depend on the words beside it.
_FAR[0] = 1


def byte_values(words: str) -> np.ndarray:
    """A 64-bit value for each byte of UTF-8: 0 where it parts words, and for A to Z that of a to z.
    words: "spaced" for WORD, "letters" for runs of ASCII letters, digits, _ and other characters,
    "terms" for the same without _."""
    values = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64)
    parting = [32, *range(9, 14)] if words == "spaced" else [b for b in range(128) if not (chr(b).isalnum() or b == 95 and words == "letters")]
    values[parting] = 0
    values[65:91] = values[97:123]
    return values


def slices(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) with at most about `most` characters together; None becomes an empty text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 == len(texts):
            yield first, [x or "" for x in texts[first : i + 1]]
            first, size = i + 1, 0


def hashed_words(texts: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts, and where those of each text begin and end."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    value = values[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    at = np.flatnonzero(value)
    ends = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        weight = _NEAR[place & 255]
        if lengths.max() > 256:
            weight *= _FAR[place >> 8 & 255]
        out = np.add.reduceat(value[at] * weight, starts)
        out ^= out >> np.uint64(31)
        out *= PLACES[63]
        out ^= out >> np.uint64(29)
    return out, np.searchsorted(at[starts], ends)


def windows(hashes: np.ndarray, places: list[int], span: int) -> np.ndarray:
    """For each window of span words, a hash of the words at the given places."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in places:
            out ^= hashes[i : i + n]
            out *= PLACES[i]
            out ^= out >> np.uint64(29)
    return out
