"""Exact self-join of documents by the Jaccard similarity of their word shingles, down to components.

Sets are joined through prefixes: under any order of all shingles, two sets that are similar enough
share one of the first few shingles of each. The order is by the power of four of the number of
documents that hold a shingle, then by hash: what only a group of copies shares comes before what
many documents share, so that common passages hardly ever get into a prefix, however large the
table is. Set relations save the rest of the work:

* index level: the sets in a shingle's list are ordered by size and by the shingle's position in
  them. Sets of one size are a block; whole blocks, and the rest of a block from a position on, are
  skipped before any pair is made, by sizes and by the positions in both sets;
* answer level: sets that are equal are one node. In a long list all sets are compared with one
  pivot first, and what is linked with it takes over its answer, the component, and is not compared
  with the list's other members. Only for sets outside the list's main component are answers looked
  up further, block by block, and only among sets of other components.

Candidates pass a parity bitmap (the symmetric difference of two sets has at least as many members
as their bitmaps differ in bits), and what is left is counted exactly.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, hashed_words, maybe_in, scratch, slices, stored, windows, without
from .components import components, merged

#: A list of more sets than this is compared with its pivot first.
LONG = 8
#: How common a shingle is is told by the first 24 bits of its hash.
HOT_BITS = 24
#: Bytes of counted shingles, and of prefix entries, for each group of a shuffle.
GROUP_BYTES = 8_000_000
#: Shingles that a task packs together to have them counted.
COUNTED = 2_000_000
#: Prefix entries that a task packs together.
ENTRIES = 300_000
#: Bits of a set's hash, and of a shingle's, in the lists.
NAME_BITS = TOKEN_BITS = 40
#: Rows whose shingles a task holds at once.
ROWS = 1000
#: Pairs of list entries that a task looks at together.
PAIRS = 250_000
#: Sets in a block of a family.
BLOCK = 128
#: Places from here on are not told: they count as the first, which skips nothing.
FAR = 65535
#: The rounds of comparison after the pivot's: whether with one block of the family only, and how many
#: candidates a set takes from a block; the last round takes all.
ROUNDS = ((True, 2), (False, 2), (False, None))

_VALUES = byte_values("spaced")


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(16)) | low


def _packed(tokens: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as their first 32 and their last 16 bits."""
    return (tokens >> np.uint64(16)).astype("<u4").tobytes() + tokens.astype("<u2").tobytes()


def _high(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4", len(blob) // 6)


def _tokens(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return _order(_high(blob), np.frombuffer(blob, "<u2", n, 4 * n))


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parity bitmap of two to four bits for each token, a power of two of them, 64 at least."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _difference(a: bytes, b: bytes) -> int:
    """In how many bits two bitmaps differ, the longer one folded to the length of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _shingles(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, or the hash of all its words where they are fewer."""
    hashes, bounds = hashed_words(texts, _VALUES)
    whole = windows(hashes, list(range(words)), words)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield whole[a : b - words + 1]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), int(b - a))], np.uint64)
        else:
            yield whole[:0]


def shingle_sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n, set, tokens, bitmap): set is a 128-bit name of the set of shingles, null where it is
    empty; tokens and bitmap are given with the first of equal sets of a task only."""
    kind = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("bitmap", T.BinaryType())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            sets = (own for _, part in slices(batch.column(1).to_pylist()) for own in _shingles(part, words))
            for own in sets:
                if not len(own):
                    out.append((0, None, None, None))
                    continue
                tokens = np.unique(own >> np.uint64(16))
                blob = _packed(tokens)
                name = xxhash.xxh3_128_digest(blob)
                new = name not in seen
                if new:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[name] = None
                out.append((len(tokens), name, blob if new else None, _bitmap(tokens) if new else None))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True))], names=["key", "n", "set", "tokens", "bitmap"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, kind)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers by byte, all first ones, then all second ones, compressed: high bytes are mostly alike."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), "zstd", asbytes=True)


def _unplaned(blob: bytes, n: int, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The n numbers of each column, whose (type, bytes) are given."""
    flat, out, at = np.frombuffer(pa.decompress(blob, n * sum(k for _, k in kinds), "zstd", asbytes=True), np.uint8), [], 0
    for kind, k in kinds:
        wide = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        wide[:, :k] = flat[at : at + n * k].reshape(k, n).T
        out.append(wide.view(kind).ravel())
        at += n * k
    return out


def _levels(sets: DataFrame, total: int) -> bytes:
    """The power of four of the number of sets that hold a shingle, by the first bits of its hash (the
    most common shingle there decides), counted over all sets in ranges of the hash; a byte for each
    of 2 ** HOT_BITS beginnings comes back, compressed."""
    ranges = 1 << min(HOT_BITS, max(3, math.ceil(math.log2(max(1, total * 8 / GROUP_BYTES)))))
    shift = 32 - ranges.bit_length() + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []

        def packed() -> pa.RecordBatch:
            own = np.sort(np.concatenate(parts))
            parts.clear()
            at = np.flatnonzero(np.diff(own >> shift, prepend=-1))
            held = np.split(own, at[1:])
            return pa.RecordBatch.from_pydict({"range": pa.array((own[at] >> shift).astype(np.int32)), "n": pa.array([len(x) for x in held], pa.int32()), "part": pa.array([_planes(np.diff(x, prepend=np.uint32(0))) for x in held], pa.binary())})

        waiting = 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                parts.append(_high(blob))
                waiting += len(parts[-1])
                if waiting >= COUNTED:
                    waiting = 0
                    yield packed()
        if waiting:
            yield packed()

    def count(table: pa.Table) -> pa.Table:
        own = np.sort(np.concatenate([np.cumsum(_unplaned(b, n, [("<u4", 4)])[0], dtype=np.uint32) for b, n in zip(table.column("part").to_pylist(), table.column("n").to_pylist(), strict=True)]))
        starts = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
        power = ((np.frexp(np.diff(np.append(starts, len(own))))[1] - 1) >> 1).astype(np.uint8)
        slot = (own[starts] >> (32 - HOT_BITS)) & ((1 << HOT_BITS) // ranges - 1)
        first = np.flatnonzero(np.diff(slot.astype(np.int64), prepend=-1))
        levels = np.zeros((1 << HOT_BITS) // ranges, np.uint8)
        levels[slot[first]] = np.maximum.reduceat(power, first)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "levels": pa.array([_planes(levels)], pa.binary())})

    rows = sets.select("tokens").mapInArrow(deal, "range int, n int, part binary").groupBy("range").applyInArrow(count, "range int, levels binary").collect()
    out = np.zeros((ranges, (1 << HOT_BITS) // ranges), np.uint8)
    for r in rows:
        out[r.range] = _unplaned(r.levels, out.shape[1], [("u1", 1)])[0]
    return _planes(out.ravel())


def _packed_entries(tokens: np.ndarray, names: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of a group in order of their shingles, these as differences: about 11 bytes an entry, over
    however many groups a set's entries are dealt."""
    cut = lambda x, bits: np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : bits // 8]
    return _planes(cut(np.diff(tokens, prepend=tokens.dtype.type(0)), TOKEN_BITS), cut(names, NAME_BITS), place.astype("<u2"), sizes.astype("<u4"))


def _entries(blob: bytes, n: int) -> list[np.ndarray]:
    """(tokens, names, place, sizes) of _packed_entries()."""
    steps, names, place, sizes = _unplaned(blob, n, [("<i8", TOKEN_BITS // 8), ("<i8", NAME_BITS // 8), ("<u2", 2), ("<u4", 4)])
    return [np.cumsum(steps), names, place, sizes]


def _name() -> Column:
    """What a set is called in the lists."""
    return F.xxhash64("set").bitwiseAND(F.lit((1 << NAME_BITS) - 1))


def _possible(i: np.ndarray, j: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of entries of one list that sizes and places do not rule out."""
    most = np.minimum(size[i] - place[i], size[j] - place[j])
    ok = (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & ((100 + percent) * most >= percent * (size[i] + size[j]))
    return i[ok], j[ok]


def _partnered(size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of one list, in order of their sizes, are in a pair that sizes and places do not rule out."""
    most = (100 + percent) * (size - place) // percent - size  # the largest size that the entry may be linked with
    below = np.searchsorted(size, most, "right")
    largest = np.maximum.accumulate(most)
    second = np.maximum.accumulate(np.minimum(most, np.append(-1, largest[:-1])))
    # an entry that may be linked with its own size is among those below, and needs another one there
    return (below > 0) & (np.where(most >= size, second[below - 1], largest[below - 1]) >= size)


def _block_pairs(at: np.ndarray, token: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list, for all lists among the entries `at`, which are in order of token,
    size and place.

    The entries of a list with one size are a block, in order of their places. An entry looks at its
    own block and at those of larger sizes: a block is skipped if its size is too large for the
    entry's, or if what follows the entry's place is too little for both sizes, and a block's rest
    from the first place on after which its own sets have too little left. So no pair is made that
    sizes or places rule out.
    """
    token, size, place = token[at], size[at], place[at]
    new = np.ones(len(at), bool)
    new[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1])
    heads = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    ends = np.append(heads[1:], len(at))
    lasts = np.searchsorted(token[heads], token[heads], "right")  # the block after the last one of the block's list
    sizes, order = size[heads], block * (FAR + 1) + place
    for part in np.array_split(np.arange(len(at)), max(1, len(at) * LONG // PAIRS)):
        many = lasts[block[part]] - block[part]
        i = np.repeat(part, many)
        b = block[i] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        need = -(-percent * (size[i] + sizes[b]) // (100 + percent))  # members in common, at least
        ok = (100 * size[i] >= percent * sizes[b]) & (size[i] - place[i] >= need) & (sizes[b] >= need)
        i, b, need = i[ok], b[ok], need[ok]
        first = np.maximum(heads[b], np.where(b == block[i], i + 1, 0))
        last = np.minimum(np.searchsorted(order, b * (FAR + 1) + np.minimum(sizes[b] - need, FAR), "right"), ends[b])
        some = last > first
        i, first, many = i[some], first[some], (last - first)[some]
        j = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield at[np.repeat(i, many)], at[j]


def _lists(sets: DataFrame, levels: bytes, total: int, percent: int) -> DataFrame:
    """Candidates from the shingles' lists: (kind 0, a, b) are pairs of sets to compare, (kind 1, a, b)
    says that set b stands in a long list whose pivot is set a. Entries that sizes and places rule out
    with all others of their list are not in it. Sets are given by a 40-bit hash of their name, shingles
    by 40 bits; where two have one hash, both are compared."""
    groups = max(1, math.ceil(total * (100 - percent) / 100 * 18 / GROUP_BYTES))
    sent = sets.sparkSession.sparkContext.broadcast(levels)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = _unplaned(sent.value, 1 << HOT_BITS, [("u1", 1)])[0]
        names, sizes, tokens, place = [], [], [], []

        def packed() -> pa.RecordBatch:
            many = [len(x) for x in tokens]
            own, at, name, size = np.concatenate(tokens), np.concatenate(place), np.repeat(np.array(names, np.int64), many), np.repeat(np.array(sizes, np.uint32), many)
            group = (own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(groups)
            order = np.lexsort((own, group))
            cut = np.searchsorted(group[order], np.arange(groups + 1))
            held = np.flatnonzero(np.diff(cut))
            parts = [order[cut[g] : cut[g + 1]] for g in held]
            for x in (names, sizes, tokens, place):
                x.clear()
            return pa.RecordBatch.from_pydict({"group": pa.array(held, pa.int32()), "n": pa.array([len(x) for x in parts], pa.int32()), "entries": pa.array([_packed_entries(own[x], name[x], at[x], size[x]) for x in parts], pa.binary())})

        waiting = 0
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                high = _high(blob)
                n = len(high)
                first = n - (n * percent + 99) // 100 + 1
                order = np.argsort(level[high >> (32 - HOT_BITS)], kind="stable")[:first]
                own = _tokens(blob)[order] >> np.uint64(48 - TOKEN_BITS)
                tokens.append(own)
                place.append(np.minimum(np.arange(len(own)), FAR).astype(np.uint16))
                names.append(name)
                sizes.append(n)
                waiting += len(own)
                if waiting >= ENTRIES:
                    waiting = 0
                    yield packed()
        if names:
            yield packed()

    def pairs(table: pa.Table) -> pa.Table:
        parts = [_entries(b, n) for b, n in zip(table.column("entries").to_pylist(), table.column("n").to_pylist(), strict=True)]
        token, name, place, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        place = np.where(place == FAR, 0, place)
        names, who = np.unique(name, return_inverse=True)
        order = np.lexsort((who, place, size, token))
        token, who, place, size = token[order], who[order], place[order].astype(np.int64), size[order].astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (who[1:] != who[:-1])  # equal sets of several tasks
        token, who, place, size = token[new], who[new], place[new], size[new]
        starts = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
        long = np.diff(np.append(starts, len(token)))
        found, members = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            a, b = who[i], who[j]
            found.append(np.unique(np.minimum(a, b) << 32 | np.maximum(a, b)))

        short = np.repeat((long > 1) & (long <= LONG), long)
        for start, m in zip(starts[long > LONG], long[long > LONG], strict=True):
            at = start + np.flatnonzero(_partnered(size[start : start + m], place[start : start + m], percent))
            if len(at) <= LONG:
                short[at] = True
                continue
            pivot = at[np.argmin(who[at])]
            rest = at[at != pivot]
            keep(*_possible(np.full(len(rest), pivot), rest, size, place, percent))
            members.append(np.unique(who[pivot] << 32 | who[at]))
        for i, j in _block_pairs(np.flatnonzero(short), token, size, place, percent):
            keep(i, j)
        out = [np.unique(np.concatenate(x)) for x in (found, members)]
        kinds = np.repeat(np.arange(2, dtype=np.int32), [len(x) for x in out])
        both = np.concatenate(out)
        return pa.table({"kind": pa.array(kinds), "a": pa.array(names[both >> 32]), "b": pa.array(names[both & 0xFFFFFFFF])})

    dealt = sets.select(_name(), "tokens").mapInArrow(deal, "group int, n int, entries binary")
    return dealt.groupBy("group").applyInArrow(pairs, "kind int, a long, b long")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not rule a link out."""

    @F.pandas_udf("boolean")
    def possible(a: pd.Series, b: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        # a link's sets differ in at most (1 - t) / (1 + t) of their sizes' sum
        return pd.Series([_difference(x, y) * (100 + percent) <= (100 - percent) * (p + q) for x, y, p, q in zip(a, b, m, n, strict=True)], dtype=bool)

    involved = pairs.select(F.explode(F.array("a", "b")).alias("s"))
    own = sets.where(maybe_in(sets, _name(), involved, F.col("s"))).select(_name(), "set", "n", "bitmap")
    joined = pairs.join(own.toDF("a", "sa", "na", "ba"), "a").join(own.toDF("b", "sb", "nb", "bb"), "b")
    return joined.where(possible("ba", "bb", "na", "nb")).select(F.col("sa").alias("a"), F.col("sb").alias("b"))


def _linked(pairs: DataFrame, given: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links, by exact intersection. given may hold the tokens of a set more than once."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("s"))
    own = given.where(maybe_in(given, F.col("set"), involved, F.col("s"))).select("set", "tokens").dropDuplicates(["set"])

    @F.pandas_udf("boolean")
    def link(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(_tokens(x), _tokens(y), assume_unique=True))
            out.append(100 * both >= percent * ((len(x) + len(y)) // 6 - both))
        return pd.Series(out, dtype=bool)

    joined = pairs.join(own.toDF("a", "ta"), "a").join(own.toDF("b", "tb"), "b")
    return joined.where(link("ta", "tb")).select("a", "b")


class _Block:
    """Sets of one block, their bitmaps side by side by length."""

    def __init__(self, members: list[dict]):
        self.names, self.labels = [m["b"] for m in members], [m["label"] for m in members]
        self.sizes = np.array([m["n"] for m in members])
        self.number = {x: i for i, x in enumerate(dict.fromkeys(self.labels))}
        self.of = np.array([self.number[x] for x in self.labels])
        lengths = np.array([len(m["bitmap"]) for m in members])
        self.rows = {int(k): np.flatnonzero(lengths == k) for k in np.unique(lengths)}
        self.bits = {k: np.frombuffer(b"".join(members[i]["bitmap"] for i in at), np.uint8).reshape(len(at), k) for k, at in self.rows.items()}

    def near(self, u: dict, percent: int, most: int | None) -> list[bytes]:
        """Members of other components that u may be linked with, at most `most`, the nearest ones."""
        own, apart = np.frombuffer(u["bitmap"], np.uint8), np.empty(len(self.sizes), np.int64)
        for k, at in self.rows.items():
            width = min(k, len(own))  # the longer ones are folded to the length of the others
            bits = np.bitwise_xor.reduce(self.bits[k].reshape(len(at), k // width, width), axis=1)
            apart[at] = np.bitwise_count(bits ^ np.bitwise_xor.reduce(own.reshape(-1, width), axis=0)).sum(axis=1)
        small, large = np.minimum(self.sizes, u["n"]), np.maximum(self.sizes, u["n"])
        ok = np.flatnonzero((100 * small >= percent * large) & (self.of != self.number.get(u["label"], -1)) & (apart * (100 + percent) <= (100 - percent) * (small + large)))
        if most is not None:
            ok = ok[np.argsort(apart[ok], kind="stable")[:most]]
        return [self.names[i] for i in ok]


def _across(families: DataFrame, labels: DataFrame, sets: DataFrame, done: DataFrame, percent: int, one_block: bool, most: int | None) -> DataFrame:
    """Pairs (a, b) of sets of one long list's family that lie in different components, one of them
    outside the family's main one, and whose sizes and bitmaps do not rule a link out; for each set
    and block at most `most`, those whose bitmaps differ least. Compared block by block, or with the
    first block only: what is linked at all is mostly linked with one of that many."""
    known = families.join(labels.toDF("b", "label"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    known = stored(known.select("a", "b", "label"), "family")
    main = known.groupBy("a", "label").agg(F.count("*").alias("m")).groupBy("a").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("all")).where("parts > 1").drop("parts")
    split = stored(known.join(main, "a"), "split")
    own = sets.where(maybe_in(sets, F.col("set"), split, F.col("b"))).select(F.col("set").alias("b"), "n", "bitmap")
    held = stored(split.join(own, "b").withColumn("block", F.pmod(F.xxhash64("b"), F.ceil(F.col("all") / BLOCK))), "held")
    row = F.struct("b", "n", "bitmap", "label")
    blocks = held.groupBy("a", "block").agg(F.collect_list(row).alias("members"))
    odd = held.where("label != main").groupBy("a", "block").agg(F.collect_list(row).alias("odd")).select("a", "odd")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for odds, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = _Block(members)
                for u in odds:
                    rows |= {(min(u["b"], b), max(u["b"], b)) for b in block.near(u, percent, most)}
            columns = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    blocks = blocks.where("block = 0") if one_block else blocks
    dealt = odd.join(blocks.select("a", "members"), "a").select("odd", "members")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct().join(done, ["a", "b"], "left_anti")


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """(set, label) of all sets that have a link, from the rows of shingle_sets()."""
    spark = rows.sparkSession
    given = rows.where("tokens IS NOT NULL")
    total = int(given.agg(F.sum("n")).first()[0] or 0)
    with scratch(spark):
        levels = _levels(given, total)
        sets = stored(given.groupBy("set").agg(F.any_value("n").alias("n"), F.any_value("bitmap").alias("bitmap")), "sets", keep=True)
    with scratch(spark):
        found = stored(_lists(given, levels, total, percent), "candidates", keep=True)
    pairs = found.where("kind = 0").select("a", "b").distinct()
    with scratch(spark):
        near = stored(_near(pairs, sets, percent), "near")
        labels = components(stored(_linked(near, given, percent), "links"), keep=True)
    families = found.where("kind = 1").select("a", "b").distinct()
    if families.isEmpty():
        return labels
    families = stored(families.join(sets.select(_name().alias("b"), "set"), "b").select("a", F.col("set").alias("b")), "families")
    done = stored(spark.createDataFrame([], "a binary, b binary"), "done")
    for one_block, most in ROUNDS:
        with scratch(spark):
            more = stored(_across(families, labels, sets, done, percent, one_block, most), "across", keep=True)
            if not more.isEmpty():
                done = done.unionByName(more)
                labels = merged(labels, stored(_linked(more, given, percent), "links"), keep=True)
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key that can be reached by links.

    Two documents link when 100 * |A and B| >= percent * |A or B| of their sets of distinct
    `words`-word shingles, A to Z lower-cased; fewer words are one shingle; a null text or one
    without words has an empty set, links with nothing and is its own component. All links between
    different sets are found or implied by others; shingles are 48-bit hashes. Rows with one key
    give a row each; a null key never is the smallest unless all of its component are null.
    Columns other than key and text are not read; an empty table gives an empty one.
    """
    rows = stored(shingle_sets(docs, key, text, words), "shingles")
    with scratch(docs.sparkSession):
        labels = stored(_components(rows, percent), "labels", keep=True)
    smallest = rows.where("set IS NOT NULL").groupBy("set").agg(F.min("key").alias("least"))
    named = smallest.join(labels.toDF("set", "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    reached = named.groupBy("label").agg(F.min("least").alias("component_id"))
    final = named.join(reached, "label").select("set", "component_id")
    out = rows.select("key", "n", "set").join(final, "set", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs with one document of each component, that with the smallest key; rows with a null key,
    and all rows with that key, stay."""
    found = near_duplicates(docs, key, **how)
    return without(docs, key, stored(found.where(F.col(key) != F.col("component_id")).select(key), "copies"))
