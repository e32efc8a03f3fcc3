"""Removal of strings of a given length that start anywhere else, over all documents.

A text is a sequence of symbols, its bytes or its words. Two strings can only be equal if they stand
in one column of an alignment: every start of a `span`-symbol string is laid on the leftmost of the
smallest hashes among the short strings within it. Equal strings have it at the same place, wherever
they stand. A document becomes a sequence of pieces, each with the starts of one such place, and the
pieces of one hash, over all documents, are a collection whose columns are aligned there.

Over each collection its Burrows-Wheeler transform is built column-wise, all documents at once: from
the last column to the first, each round inserts one symbol of every piece, and updates the order of
the pieces' suffixes and the common prefixes of neighbours. After the round of a column, a string of
`span` symbols starts again elsewhere exactly if a neighbour's common prefix has that length. Equal
pieces are one with a count before that. Pieces lie in tables of the shared folder, dealt by hash,
which tasks read one after another; no step depends on the longest text.

A collection of any number of pieces is built in bounded memory: as long as it has more than TOGETHER
different ones, its starts are divided into narrower bands of columns, and the pieces of a band are
dealt by all that the strings of that band have in common, cut to what they can reach, and equal ones
joined again. That repeats until collections are small; a band of one column holds equal strings only.
"""

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, hashed_words, maybe_in, scratch, slices, stored

SPAN = 400
#: Starts of a text that are looked at together; longer texts are read in overlapping parts.
PART = 1 << 20
#: Different pieces of a collection that are inserted in one task.
TOGETHER = 4096
#: Columns of the bands into which larger collections are divided, one after another.
BANDS = (64, 8, 1)
#: Bytes of pieces, about, whose columns are inserted together.
GROUP_BYTES = 4_000_000

#: Documents whose spans a task holds at once.
ROWS = 200

_BYTE = np.random.default_rng(20240101).integers(1, 2**64, 256, np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORDS = byte_values("spaced")
#: Symbols are bytes, or 64-bit hashes of words with A to Z in lower case.
KINDS = {"bytes": np.dtype(np.uint8), "words": np.dtype(np.uint64)}


def _sequences(texts: list[str | None], unit: str) -> Iterator[np.ndarray]:
    """The symbols of each text; a null text has none."""
    if unit == "bytes":
        yield from (np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts)
        return
    for _, part in slices(texts):
        words, bounds = hashed_words(part, _WORDS)
        yield from (words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * _A
    out ^= out >> np.uint64(32)
    out += right
    out *= _B
    out ^= out >> np.uint64(29)
    return out


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The hashes of all strings of `length` symbols, a power of two."""
    out, size = _BYTE[data] if data.dtype == np.uint8 else data, 1
    with np.errstate(over="ignore"):
        while size < length:
            out = _joined(out[:-size], out[size:])
            size *= 2
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of `width` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1])


def short_length(span: int) -> int:
    """Symbols of the short strings: the largest power of two of at most a third of the span."""
    return 1 << (max(1, span // 3).bit_length() - 1)


def _name(piece: bytes, *more: int) -> bytes:
    """A 128-bit cryptographic digest by which equal pieces are told."""
    return blake2b(piece, digest_size=16, salt=b"".join(x.to_bytes(8, "little", signed=True) for x in more)).digest()


def stretches(data: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(first start, starts, lead, hash) of each stretch of starts that are laid on one place, which is
    `lead` symbols after the first start."""
    n, short = len(data) - span + 1, short_length(span)
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    h = _hashes(data, short)
    high, at = h & ~np.uint64(0xFFFFFF), np.arange(len(h), dtype=np.uint64)
    place = (_smallest(high | at, span - short + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return first, np.diff(np.append(first, n)), place[first] - first, h[place[first]].view(np.int64)


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of consecutive ascending numbers."""
    at = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    return starts[at], np.diff(np.append(at, len(starts)))


def _columns(pieces: list[np.ndarray], lead: np.ndarray) -> tuple[np.ndarray, int]:
    """A row of symbols for each column, 0 where a piece has none and numbers from 1 on elsewhere, and
    the number of columns before the one on which the pieces are laid."""
    lengths = np.array([len(p) for p in pieces])
    before, after = int(lead.max()), int((lengths - lead).max())
    symbols = np.concatenate(pieces)
    values = symbols.astype(np.uint16) + 1 if symbols.dtype == np.uint8 else np.unique(symbols, return_inverse=True)[1].astype(np.uint32) + 1
    grid = np.zeros((before + after, len(pieces)), values.dtype)
    who = np.repeat(np.arange(len(pieces)), lengths)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid[inside + np.repeat(before - lead, lengths), who] = values
    return grid, before


def repeated_starts(pieces: list[np.ndarray], lead: np.ndarray, collection: np.ndarray, times: np.ndarray, span: int) -> np.ndarray:
    """(piece, start within it), in that order, of each span-symbol string that another piece of the
    same collection holds in the same column, or this one if it stands for more than one. collection
    ascends.

    order lists the pieces, those of one collection together, by their suffixes from the column on;
    common[i] is the common prefix of the i-th and the one before it, 0 at the head of a collection;
    transform holds the symbols before the suffixes, in their order, which is the part of the
    Burrows-Wheeler transform that the last round added. Inserting a column sorts by those symbols and
    keeps the order among equal ones; where two have one symbol and are now neighbours, their common
    prefix is one more than the least between them before.
    """
    grid, before = _columns(pieces, lead)
    order, common = np.arange(len(pieces)), np.zeros(len(pieces) + 1, np.int32)
    bound = np.concatenate([[0], np.cumsum(np.diff(collection) != 0)]).astype(np.int64) << 32
    found = np.zeros((before + 1, len(pieces)), bool)
    for column in range(len(grid) - 1, -1, -1):
        transform = grid[column][order]
        key = bound | transform
        if (np.diff(key) < 0).any():
            moved = np.argsort(key, kind="stable")
            low, high = np.minimum(moved[:-1], moved[1:]) + 1, np.maximum(moved[:-1], moved[1:])
            least = common[high]
            apart = np.flatnonzero((low < high) & (key[moved[1:]] == key[moved[:-1]]))
            if len(apart):
                least[apart] = np.minimum.reduceat(common, np.stack([low[apart], high[apart] + 1], 1).ravel())[::2]
            common[1:-1] = least
            order, key, transform = order[moved], key[moved], transform[moved]
        same = (np.diff(key) == 0) & (transform[1:] != 0)
        common[1:-1] = np.where(same, common[1:-1] + 1, 0)
        if column <= before:
            long = common >= span
            found[column, order[long[:-1] | long[1:]]] = True
    # what an equal piece elsewhere holds, the count says
    for i in np.flatnonzero(times > 1).tolist():
        found[before - lead[i] : before - lead[i] + len(pieces[i]) - span + 1, i] = True
    column, piece = np.nonzero(found)
    start = column - (before - lead[piece])
    sort = np.lexsort((start, piece))
    return np.stack([piece[sort], start[sort]], 1)


def _bands(pieces: DataFrame, span: int, width: int, kind: np.dtype) -> DataFrame:
    """(hash0, name0, at, hash, name, lead, n, all, piece): the starts of each piece, divided into bands
    of `width` columns; at is the band's first start in the piece that hash0 and name0 tell."""
    size = kind.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for hashed, name, lead, n, times, piece in zip(*(rows[c] for c in ("hash", "name", "lead", "n", "all", "piece")), strict=True):
                for band in range((lead - n + 1) // width, lead // width + 1):
                    first, last = max(0, lead - (band + 1) * width + 1), min(n - 1, lead - band * width)
                    laid = lead - band * width  # the band's column on which its pieces are laid
                    core = piece[laid * size : (laid + span - width + 1) * size]
                    own = piece[first * size : (last + span) * size]
                    own_hash = int.from_bytes(_name(core, hashed, band)[:8], "little", signed=True)
                    out.append((hashed, name, first, own_hash, _name(own, laid - first), laid - first, last - first + 1, times, own))
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 9, types, strict=True)], names=["hash0", "name0", "at", "hash", "name", "lead", "n", "all", "piece"])

    return pieces.select("hash", "name", "lead", "n", "all", "piece").mapInArrow(cut, "hash0 long, name0 binary, at long, hash long, name binary, lead long, n long, all long, piece binary")


def _hits(pieces: DataFrame, span: int, kind: np.dtype, bands: tuple[int, ...]) -> DataFrame:
    """(hash, name, at, n) of distinct pieces (hash, name, lead, n, all, size, piece): from the at-th start
    of the piece on, n strings occur more than once. size is the number of pieces of the collection."""
    total, most = pieces.agg(F.sum(F.octet_length("piece")), F.max("size")).first()
    more = bool(bands) and (most or 0) > TOGETHER
    few = pieces.where(F.col("size") <= TOGETHER) if more else pieces
    buckets = (total or 0) // GROUP_BYTES + 1

    def insert(table: pa.Table) -> pa.Table:
        table = table.sort_by("hash")
        lead, collection, times = (table.column(c).to_numpy() for c in ("lead", "hash", "all"))
        hits = repeated_starts([np.frombuffer(p, kind) for p in table.column("piece").to_pylist()], lead, collection, times, span)
        # strings of neighbouring pieces must not run together
        place, n = _runs(hits[:, 1] + (hits[:, 0] << 32))
        rows = table.select(["hash", "name"]).take(pa.array(place >> 32, pa.int64()))
        return rows.append_column("at", pa.array(place & 0xFFFFFFFF, pa.int64())).append_column("n", pa.array(n, pa.int64()))

    dealt = few.select("hash", "name", "lead", "all", "piece", F.pmod("hash", F.lit(buckets)).alias("bucket"))
    found = dealt.groupBy("bucket").applyInArrow(insert, "hash long, name binary, at long, n long")
    if not more:
        return found
    banded = stored(_bands(pieces.where(F.col("size") > TOGETHER), span, bands[0], kind), "bands")
    one = banded.groupBy("hash", "name").agg(F.any_value("lead").alias("lead"), F.any_value("n").alias("n"), F.sum("all").alias("all"), F.any_value("piece").alias("piece"))
    sizes = banded.groupBy("hash").agg(F.sum("all").alias("sum"), F.count_distinct("name").alias("size")).where("sum > 1").drop("sum")
    below = _hits(stored(one.join(sizes, "hash"), "pieces"), span, kind, bands[1:])
    within = below.withColumnsRenamed({"at": "_at", "n": "_n"})
    return found.unionByName(banded.join(within, ["hash", "name"]).select(F.col("hash0").alias("hash"), F.col("name0").alias("name"), (F.col("at") + F.col("_at")).alias("at"), F.col("_n").alias("n")))


def repeated(docs: DataFrame, key: str, text: str, span: int, unit: str = "bytes") -> DataFrame:
    """(d, start, n): from symbol `start` of document d (its key and text hash) on, n strings of span symbols
    begin that start elsewhere too."""
    kind, identity = KINDS[unit], F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("th"))
    rows = docs.select(identity.alias("d"), F.col(text).cast("string").alias("t"))
    d_type = rows.schema["d"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, numbers, names = [], [[] for _ in range(5)], []
            for i, data in enumerate(_sequences(batch.column(1).to_pylist(), unit)):
                for at in range(0, max(1, len(data) - span + 1), PART):
                    part = data[at : at + PART + span - 1]
                    first, count, lead, hashed = stretches(part, span)
                    raw, size = memoryview(np.ascontiguousarray(part)).cast("B"), kind.itemsize
                    times: dict[bytes, list[int]] = {}
                    for j, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
                        times.setdefault(_name(raw[a * size : (a + n + span - 1) * size]), []).append(j)
                    again = [j for js in times.values() if len(js) > 1 for j in js]
                    if again:  # told at once, with times 0
                        starts, many = _runs(np.sort(np.concatenate([np.arange(first[j], first[j] + count[j]) for j in again])))
                        nothing = np.zeros(len(starts), np.int64)
                        who.append(np.full(len(starts), i))
                        names += [b""] * len(starts)
                        for c, v in zip(numbers, (starts + at, many, nothing, nothing, nothing), strict=True):
                            c.append(v)
                    one = np.array([js[0] for js in times.values()], np.int64)
                    who.append(np.full(len(one), i))
                    names += times
                    for c, v in zip(numbers, (first[one] + at, count[one], lead[one], np.array([len(js) for js in times.values()], np.int64), hashed[one]), strict=True):
                        c.append(v)
            at = pa.array(np.concatenate(who) if who else np.empty(0, np.int64))
            values = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in numbers]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *values, pa.array(names, pa.binary())], names=["d", "start", "n", "lead", "times", "hash", "name"])

    found = stored(rows.mapInArrow(read, f"d {d_type}, start long, n long, lead long, times long, hash long, name binary"), "stretches")
    told = found.where("times = 0").select("d", "start", "n")
    laid = found.where("times > 0")
    keys = laid.groupBy("hash").agg(F.sum("times").alias("all")).where("all > 1").select("hash")
    shared = stored(laid.join(keys, "hash"), "shared")
    names = shared.groupBy("hash", "name").agg(F.sum("times").alias("all"), F.min(F.struct("d", "start", "n", "lead")).alias("at"))
    asked = names.join(names.groupBy("hash").agg(F.count("*").alias("size")), "hash").select("hash", "name", "all", "size", "at.*")
    lists = stored(asked.groupBy("d").agg(F.collect_list(F.struct("hash", "name", "start", "n", "lead", "all", "size")).alias("asked")), "asked")
    held = rows.where(maybe_in(rows, F.col("d"), lists, F.col("d")))
    joined = held.withColumnRenamed("d", "_d").join(lists, F.col("_d") == F.col("d")).select("d", "t", "asked").dropDuplicates(["d"]).select("t", "asked")
    fields = {"hash": pa.int64(), "name": pa.binary(), "lead": pa.int64(), "n": pa.int64(), "all": pa.int64(), "size": pa.int64()}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, pieces = {c: [] for c in fields}, []
            for data, wanted in zip(_sequences(batch.column(0).to_pylist(), unit), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    pieces.append(data[w["start"] : w["start"] + w["n"] + span - 1].tobytes())
                    for c in fields:
                        columns[c].append(w[c])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, fields[c]) for c, v in columns.items()), pa.array(pieces, pa.binary())], names=[*fields, "piece"])

    pieces = stored(joined.mapInArrow(fetch, "hash long, name binary, lead long, n long, all long, size long, piece binary"), "pieces")
    hits = _hits(pieces, span, kind, tuple(b for b in BANDS if 4 * b <= span)).withColumnRenamed("n", "many")
    return told.unionByName(shared.join(hits, ["hash", "name"]).select("d", (F.col("start") + F.col("at")).alias("start"), F.col("many").alias("n")))


def _merged(starts: list[dict] | None, span: int) -> list[list[int]]:
    """From and to of the runs that strings from these starts on cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["start"] + s["n"] + span - 1) for s in starts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, passage_words: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept, passages): every byte is removed that is covered by
    a span-byte string of the UTF-8 text which also starts anywhere else, in the same document or in
    another; all copies go, and what is left is not looked at again.

    spans are the maximal removed runs as (start, length), kept the remaining bytes, which need not
    be valid UTF-8. With passage_words the same construction is run over words too, case aside:
    passages are the runs of words, as (start, length), that strings of so many words cover which also
    start elsewhere; they may be shorter than span bytes, and nothing is removed for them. Without
    it passages is empty. A null text is empty. Matches never cross documents. Each row is a document:
    of repeated rows of span bytes or more all bytes go. Rows of equal key and text get equal results;
    null keys are documents like others. Columns other than key and text are not read; if the key is
    called like a column added, that one gets an underscore before it.
    """
    names = [c if c.lower() != key.lower() else f"_{c}" for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "passages")]
    units = {"bytes": span} | ({"words": passage_words} if passage_words else {})
    found = []
    for unit, length in units.items():
        with scratch(docs.sparkSession):
            found.append(stored(repeated(docs, key, text, length, unit), "repeated", keep=True).withColumn("unit", F.lit(unit)))
    every = reduce(DataFrame.unionByName, found)
    own = lambda unit: F.collect_set(F.when(F.col("unit") == unit, F.struct("start", "n")))
    lists = every.groupBy("d").agg(own("bytes").alias("starts"), own("words").alias("words"))
    rows = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("th")).alias("_d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    marked = rows.withColumn("hit", maybe_in(rows, F.col("_d"), lists, F.col("d")))
    left = marked.where("hit").join(lists, F.col("_d") == F.col("d"), "left").select("_d.k", "t", "starts", "words")
    none = marked.where("NOT hit").select("_d.k", "t", *[F.lit(None).cast(lists.schema["starts"].dataType).alias(c) for c in ("starts", "words")])
    place = "array<struct<start:bigint,length:bigint>>"
    kind = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, ("long", "long", "long", place, "binary", place), strict=True)]])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: [{"start": a, "length": b - a} for a, b in spans]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out = []
            for value, starts, words in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                data, spans = value.encode("utf-8", "surrogatepass"), _merged(starts, span)
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), listed(spans), kept, listed(_merged(words, passage_words or 0))))
            types = (pa.int64(), pa.int64(), pa.int64(), spans_type, pa.binary(), spans_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 6, types, strict=True))], names=kind.names)

    return left.unionByName(none).mapInArrow(cut, kind)
