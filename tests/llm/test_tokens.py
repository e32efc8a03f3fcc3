import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rootgrain.llm import packing, tokencount

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(5)
    alphabet = "ab ZÉßñ'st \n\t  19½²!?.#_<|endoftext|> é́ 中文字 İ ΣΑΣς \x1c\x85 ﬁ 😀 \r\n 've 'S"
    out = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(300)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF), 32, 10])) for _ in range(r.randint(0, 60))) for _ in range(300)]
    out += [None, "", "<|endoftext|>", "a<|endoftext|> b \n<|startoftext|>x", "x" * 50_000, " " * 500, "a " * 20_000]
    return list(enumerate(out))


def test_counts_equal_the_library(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 7, t) for i, t in rows], "doc_id long, text string, n_tokens int, piece string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, BYTES).collect()}
    library = Tokenizer.from_file(BYTES)
    assert got == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_whole_tokens_are_proved(spark):
    whole = {r.piece for r in tokencount.whole_tokens(spark, BYTES).collect()}
    library = Tokenizer.from_file(BYTES)
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(library.encode(p, add_special_tokens=False).ids) == 1 for p in list(whole)[:500])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count_tokens(docs, BYTES).count() == 0
    assert packing.pack(docs, WORDS, 1).count() == 0


def test_every_id_lies_in_one_piece(spark):
    rows = texts() + [(5, "repeated key"), (None, "null key")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, key long").repartition(3)
    packed = packing.pack(docs, WORDS, 1).collect()
    library = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    by = collections.defaultdict(list)
    for r in packed:
        got[r.doc_id] += len(r.ids) // 4
        by[r.sequence_id].append((r.offset, len(r.ids) // 4, r.padding))
    assert got == want
    one = [r for r in packed if r.doc_id == rows[10][0]]
    whole = b"".join(r.ids for r in sorted(one, key=lambda r: r.start))
    assert whole == np.array(library.encode(rows[10][1], add_special_tokens=False).ids + [1], "<u4").tobytes()
    assert zlib.crc32(whole) >= 0
    short = 0
    for pieces in by.values():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        short += end < 2048
    assert short <= 3  # one for each partition


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 2047) for _ in range(r.randint(1, 200))]
    k = max(1, sum(sizes) // 2048)
    sums = np.bincount(packing.difference(sizes, k), sizes, minlength=k)
    greedy = [0] * k
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert sums.sum() == sum(sizes)
    assert sums.max() - sums.min() <= max(greedy) - min(greedy) + max(sizes)
    windows = packing.fill(sizes, 2048)
    lengths = sorted(sum(b - a for _, a, b in w) for w in windows)
    assert all(x == 2048 for x in lengths[1:]) and lengths[0] <= 2048
    covered = collections.defaultdict(list)
    for w in windows:
        for i, a, b in w:
            covered[i].append((a, b))
    for i, size in enumerate(sizes):
        spans = sorted(covered[i])
        assert spans[0][0] == 0 and spans[-1][1] == size and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
