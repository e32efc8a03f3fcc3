"""Benchmark decontamination with spaced seeds.

A mask is a window of words in which only some places count, so that a word changed at another
place does not change the window's hash. Every window of every benchmark item is hashed under each
mask, every window of every document too; equal hashes are hits. Around a hit the document is laid
beside the item, word by word, and all stretches that are long and equal enough are kept.
"""

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, hashed_words, slices, stored, windows, without

#: Places that count are 1. Each mask bears another spacing of substitutions.
MASKS = ("1110011", "11010011", "110010101", "1010110001", "11111")
#: Characters of benchmark text that one broadcast block may hold; more items make more blocks.
BLOCK_CHARS = 32_000_000

_VALUES = byte_values("letters")


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words([t.lower() for t in texts], _VALUES)


def _seeds(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for number, mask in enumerate(MASKS):
        places = [i for i, x in enumerate(mask) if x == "1"]
        yield number, windows(words ^ np.uint64(number * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF), places, len(mask))


class Items:
    """A block of benchmark items as sorted seed hashes with the item and place of each."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.words = [_words([text])[0] for _, text in items]
        parts = [(h, np.full(len(h), n), np.arange(len(h))) for n, w in enumerate(self.words) for _, h in _seeds(w)]
        empty = np.empty(0, np.int64)
        hashes = np.concatenate([p[0] for p in parts]) if parts else empty.astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = (np.concatenate([p[1] for p in parts]) if parts else empty)[order]
        self.place = (np.concatenate([p[2] for p in parts]) if parts else empty)[order]
        self.some = np.zeros(1 << 22, bool)
        self.some[self.hashes >> np.uint64(42)] = True

    def hits(self, words: np.ndarray) -> np.ndarray:
        """(item, place in words, place in the item's words) of each seed in common."""
        found = []
        for _, h in _seeds(words):
            at = np.flatnonzero(self.some[h >> np.uint64(42)])
            if len(at):
                low, high = np.searchsorted(self.hashes, h[at]), np.searchsorted(self.hashes, h[at], "right")
                many = high - low
                which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.stack([self.item[which], np.repeat(at, many), self.place[which]], 1))
        return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def _stretches(equal: np.ndarray, least: int, share: Fraction) -> list[tuple[int, int]]:
    """From and to of the stretches of `least` places or more of which a share is equal, in their order.

    Each is as long as the share allows, and none has only equal places that another one has too. Its
    ends are equal, unless it would then be shorter than `least`.
    """
    at = np.flatnonzero(equal)
    few = -(-share.numerator * least // share.denominator)
    if len(equal) < least or len(at) < max(few, 1):
        return []
    # from the n-th equal place to the m-th the share holds where gain[m] >= loss[n]; all in whole numbers
    n = np.arange(len(at))
    gain = share.denominator * (n + 1) - share.numerator * (at + 1)
    loss = share.denominator * n - share.numerator * at
    last = len(at) - 1 - np.searchsorted(np.maximum.accumulate(gain[::-1]), loss)
    longer = last > np.maximum.accumulate(np.concatenate([[-1], last[:-1]]))
    out = []
    for first in np.flatnonzero(longer & (last - n + 1 >= few)).tolist():
        start, end = int(at[first]), int(at[last[first]]) + 1
        if end - start < least:
            start = min(start, len(equal) - least)
            end = start + least
        out.append((start, end))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, min_equal: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Verified overlaps: (key, item_id, doc_start, item_start, n_words, n_equal), words from 0.

    A row says that n_words words of the document lie beside as many of the item, from the given
    starts on, and that n_equal of them, a share of min_equal at least, are the same; case and
    punctuation don't count. A stretch has min_words words or more, or the whole item where that is
    shorter; all stretches of a pair of texts have a row, save those whose equal words all lie in
    another one. With the defaults the masks miss none of 8 words or more; items of 5 to 7 words with
    a changed one may be missed, and fewer than 5 words match nothing; null and empty texts neither.
    Repeated document rows give repeated rows, equal items a row each. Other columns are not read.
    The items are broadcast in blocks of at most BLOCK_CHARS characters, each against all documents.
    """
    listed = benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    share = Fraction(min_equal).limit_denominator(1_000_000)
    chars = listed.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType)] + [T.StructField(c, T.LongType()) for c in ("doc_start", "item_start", "n_words", "n_equal")])

    def against(block: int) -> DataFrame:
        rows = listed.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value)
            for batch in batches:
                out = []
                keys = batch.column(0).to_pylist()
                for first, part in slices(batch.column(1).to_pylist()):
                    words, bounds = _words(part)
                    hits = items.hits(words)
                    # the document is that of the hit's own place, which may lie past the item's first word
                    for item, diagonal, doc in sorted({(i, at - p, int(np.searchsorted(bounds, at, "right")) - 1) for i, at, p in hits.tolist()}):
                        own = items.words[item]
                        a, b = max(bounds[doc], diagonal), min(bounds[doc + 1], diagonal + len(own))
                        equal = words[a:b] == own[a - diagonal : b - diagonal]
                        for start, end in _stretches(equal, min(min_words, len(own)), share):
                            out.append((keys[first + doc], items.ids[item], int(a - bounds[doc]) + start, int(a - diagonal) + start, end - start, int(equal[start:end].sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 6, schema(batch), strict=True)], schema=schema(batch))

        def schema(batch: pa.RecordBatch) -> pa.Schema:
            return pa.schema([(key, batch.schema.field(0).type), (item_key, item_type)] + [(c, pa.int64()) for c in ("doc_start", "item_start", "n_words", "n_equal")])

        return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, kind)

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    return reduce(DataFrame.unionAll, [against(b) for b in range(blocks)])


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the documents that hold a verified overlap; rows with a null key stay."""
    return without(docs, key, stored(overlaps(docs, benchmark, key=key, **how).select(key).distinct(), "leaks"))
