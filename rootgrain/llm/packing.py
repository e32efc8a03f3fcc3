"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenized, full windows are cut off, and the remainders of a bounded number of
documents at a time are spread over as many windows as their tokens fill. Differencing starts with
one partial partition for each remainder and always merges the two with the largest imbalance,
the heavy windows of one onto the light windows of the other, until one partition is left.
Windows above the capacity then give their overflow up, and the overflow goes where the opposite
imbalance is largest; where capacity is still exceeded, the window count rises by one.
"""

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import SAFE, Merger
from .common import Memo

#: ASCII white space, at which every pre-token of the vocabulary ends.
SPACE = re.compile(r"[ \t\n\r]+")
#: Pre-tokens of lower-case texts of SAFE characters.
SAFE_PRE_TOKEN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+""")
#: Remainders that are spread at once; with it the memory of a task is bounded.
GROUP = 1024


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size, by multiway differencing."""
    n = len(sizes)
    windows = np.zeros(n, np.int64)
    if k == 1 or not n:
        return windows
    sums: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes):
        part = np.zeros(k, np.int64)
        part[0] = size
        sums[i] = part
        heap.append((-size, i))
    heapq.heapify(heap)
    merges = []
    for made in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[made] = both
        merges.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(both[0]), made))
    place = {2 * n - 2: np.arange(k)}
    for made in range(2 * n - 2, n - 1, -1):
        a, b, order = merges[made - n]
        of = np.empty(k, np.int64)
        of[order] = place.pop(made)
        for child, slots in ((a, of), (b, of[::-1])):
            if child < n:
                windows[child] = slots[0]
            else:
                place[child] = slots
    return windows


def fill(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, from, to), none above capacity, all but one of them full.

    Every token of every item lies in exactly one window. Items are cut only where a window
    overflows.
    """
    k = max(1, sum(sizes) // capacity)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for item, window in enumerate(difference(sizes, k)):
        held[window].append((item, 0, sizes[item]))
    room = [capacity - sum(b - a for _, a, b in w) for w in held]
    while min(room) < 0:
        over = []
        for w in range(len(held)):
            while room[w] < 0:  # the last piece gives up what does not fit
                item, a, b = held[w].pop()
                cut = max(a, b + room[w])
                if cut > a:
                    held[w].append((item, a, cut))
                over.append((item, cut, b))
                room[w] += b - cut
        over.sort(key=lambda p: (p[1] - p[2], p))
        light = sorted((w for w in range(len(held)) if room[w] > 0), key=lambda w: (-room[w], w))
        while len(light) < len(over) and sum(room[w] for w in light) < sum(b - a for _, a, b in over):
            held.append([])  # capacity is exceeded: one window more
            room.append(capacity)
            light.append(len(held) - 1)
        for at, piece in enumerate(over):
            w = light[at % len(light)]
            held[w].append(piece)
            room[w] -= piece[2] - piece[1]
    return [w for w in held if w]


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 2048, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """Packed pieces: (key, start, ids, doc_tokens, sequence_id, offset, padding).

    Each document is the tokenizer's ids of its whole text (null: none) and then `end_id`. ids are
    little-endian unsigned 32-bit numbers. A sequence is the pieces of one sequence_id in order of
    offset, gapless from 0; padding is what is missing to the capacity (nothing where the length is
    a power of two) and the same in all pieces of a sequence. A task packs the rows of its own input
    partition, so that nothing is shuffled and one sequence at most for each partition stays
    unfilled. Null or repeated keys are packed as they come; other columns are not read. An empty
    table gives an empty table.
    """
    kind = docs.schema[key].dataType
    out = T.StructType([
        T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("padding", T.LongType()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        # White space only parts words in this vocabulary, so that runs of other characters are encoded each for itself.
        merger = Merger(path)

        def encoded(word: str) -> bytes:
            if SAFE.fullmatch(word) and "<|" not in word:
                ids = [i for piece in SAFE_PRE_TOKEN.findall(word.lower()) for i in merger.ids(piece)]
            else:
                ids = tokenizer.encode(word, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()

        memo = Memo(encoded, most=200_000)
        number = TaskContext.get().partitionId() << 32
        rest: list[tuple] = []  # key, start, ids, doc_tokens of remainders
        rows: list[tuple] = []

        def emit(pieces: list[tuple]) -> None:
            nonlocal number
            length = sum(len(p[2]) // 4 for p in pieces)
            padding = 0 if length & (length - 1) == 0 else capacity - length
            offset = 0
            for who, start, ids, total in pieces:
                rows.append((who, start, ids, total, number, offset, padding))
                offset += len(ids) // 4
            number += 1

        def spread(last: bool) -> None:
            nonlocal rest
            left = []
            for window in fill([len(r[2]) // 4 for r in rest], capacity):
                pieces = [(rest[i][0], rest[i][1] + a, rest[i][2][4 * a : 4 * b], rest[i][3]) for i, a, b in window]
                if last or sum(len(p[2]) for p in pieces) == 4 * capacity:
                    emit(pieces)
                else:
                    left += pieces
            rest = left

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("key", batch.schema.field(0).type), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padding", pa.int64())])
            for who, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(map(memo.__getitem__, SPACE.split(value or ""))) + end
                total = len(ids) // 4
                full = total // capacity * capacity
                for start in range(0, full, capacity):
                    emit([(who, start, ids[4 * start : 4 * (start + capacity)], total)])
                if full < total:
                    rest.append((who, full, ids[4 * full :], total))
                if len(rest) >= group:
                    spread(last=False)
                if len(rows) >= 2 * group:
                    yield flushed()
        if rest:
            spread(last=True)
        if rows:
            yield flushed()

    packed = docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, out)
    return packed.withColumnRenamed("key", key)
