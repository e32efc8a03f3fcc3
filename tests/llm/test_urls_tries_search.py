"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rootgrain.llm import lexical, prefixtrie, urlfilter

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})

# --- 11


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.net", "/en/", "block"), ("a.example.net", None, "block"), ("org", "/é", "block"), ("org", "", "allow"), ("", "/", "block"), (None, "/", "block"), ("com", "x", "block"), ("com", "/", "maybe"), ("dup.de", "/", "allow"), ("dup.de", "/", "allow")]


def urls():
    r = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "EXAMPLE.NET", "org", "o.org", "borg", "com", "dup.de", "", ".net", "net.", "example.net:80", "u@example.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/é/1", "/x?y=/en/", "?net/", "#/en/", "/en/#a", "//"]
    out = [f"{r.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    return [*out, None, "", "net/en/", "mailto:a@net", "a://b://c.net/", "http://" + "a." * 5000 + "net/" + "p" * 200_000, "http://e\nx.net/\n/"]


def judged(url, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m[1].translate(LOWER), m[2]
    fits = [(h.translate(LOWER) + (p or ""), v) for h, p, v in RULES if h and v in ("allow", "block") and (host == h.translate(LOWER) or host.endswith("." + h.translate(LOWER))) and path.startswith(p or "") and (p or "/")[0] == "/"]
    if not fits:
        return host, path, None, default
    rule = max((f[0] for f in fits), key=len)
    return host, path, rule, "block" if (rule, "block") in fits else "allow"


@pytest.mark.parametrize("mapped", [1 << 20, -1])
def test_urls_are_judged_by_their_longest_rule(spark, mapped):
    rows = [(i, u, "old") for i, u in enumerate(urls())] * 2
    df = spark.createDataFrame(rows, "page_id long, link string, host string").repartition(3)
    got = urlfilter.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string"), url="link", default="allow", mapped_bytes=mapped)
    assert sorted(got.columns) == ["host", "link", "page_id", "path", "rule", "verdict"]
    assert sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in got.collect()) == sorted((i, *(str(x) if k == 2 else x for k, x in enumerate(judged(u, "allow")))) for i, u, _ in rows)


@pytest.mark.parametrize("mapped", [1 << 20, -1])
def test_no_rules_and_no_urls(spark, mapped):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlfilter.judge(df, rules, default="block", mapped_bytes=mapped).collect()] == [(None, "block")]
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(RULES, rules.schema), mapped_bytes=mapped).count() == 0


def test_strings_of_one_key_are_told_apart():
    same = lambda s: len(s)  # noqa: E731  every string of a length collides
    strings = sorted([b"abc", b"bca", b"cab", b"a", b"longer"], key=lambda s: (len(s), s))
    held = urlfilter.Digests(np.frombuffer(urlfilter.Digests.pack([len(s) for s in strings], strings, [[i] for i in range(5)]), np.uint8), same)
    found = held.find([b"cab", b"xyz", b"abc", b"", b"longer", b"shorty", b"bca", b"a"]).tolist()
    assert [held.string(i) if i >= 0 else None for i in found] == [b"cab", None, b"abc", None, b"longer", None, b"bca", b"a"]
    assert held.numbers_of(found[0]) == [3]


def test_keys_of_tasks_are_those_of_spark(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "net/", "é" * 40, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [g & (1 << 64) - 1 for g in got] == [urlfilter.digest(t.encode()) for t in texts]


# --- 12


def plain_trie(convs):
    """convs: {id: [(role, text)]}"""
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for seq, members in nodes.items():
        under = [s for s in nodes if s[: len(seq)] == seq]
        leaves = [s for s in under if not any(len(o) == len(s) + 1 and o[: len(s)] == s for o in nodes)]
        saved = sum((len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in under if s)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(seq)))
        children = sum(len(o) == len(seq) + 1 and o[: len(seq)] == seq for o in nodes)
        out.append((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            by[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), (r, t)))
    return {c: [x[2] for x in sorted(v)] for c, v in by.items()}


def conversations():
    r = random.Random(8)
    rows = []
    for c in range(-3, 70):
        n = r.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, k if r.random() < 0.9 else None, r.choice(["user", None]), r.choice(["hi there", "a b\tc", "", None])) for k in range(n)]
    rows += [(100 + c, k, "user", f"same {k} words") for c in range(12) for k in range(34)]  # longer than a chunk
    rows += [(200, k, "user", f"same {k} words") for k in range(20)] + [(300, 1, "u", "again")] * 36 + [(None, 0, "u", "x")]
    return rows


def nodes(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def test_tries(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 8)
    rows = conversations()
    df = spark.createDataFrame([(*x, 5) for x in rows], SCHEMA + ", n long").repartition(5)
    assert nodes(prefixtrie.prefix_trie(df)) == plain_trie(ordered(rows))


def test_tries_of_rejoined_conversations(spark):
    rows = conversations()[:200]
    own = ordered(rows)
    starts = [(c, c - math.fmod(c, 20), zlib.crc32(str(c).encode()) % 4) for c in own]
    want = {c: own.get(int(b), [])[:h] + own[c][h:] for c, b, h in starts}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    given = spark.createDataFrame([(c, int(b), h) for c, b, h in starts], "c long, base long, h long")
    assert nodes(prefixtrie.prefix_trie(df, given)) == plain_trie(want)


def test_small_tries(spark):
    one = spark.createDataFrame([(7, 0, "u", "x y")], SCHEMA)
    assert nodes(prefixtrie.prefix_trie(one)) == plain_trie({7: [("u", "x y")]})
    assert prefixtrie.prefix_trie(one.limit(0)).count() == 0
    turnless = spark.createDataFrame([(7, 1, 3), (8, 1, 3)], "c long, base long, h long")
    assert nodes(prefixtrie.prefix_trie(one, turnless)) == plain_trie({7: [], 8: []})


# --- 13


def ranking(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    held = [(i, collections.Counter(split(t)), len(split(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("leaf", "bucket", "shard"), [(256, 32, 8192), (2, 1, 50), (1, 2, 7)])
def test_ranking(spark, monkeypatch, leaf, bucket, shard):
    r = random.Random(leaf)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "A_b", "éa", "x9", "中文"]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choices(words, k=r.choice([0, 1, 3, 20, 60])))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(40)] + [(5, "w1 w7"), (5, "w1 w7"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, "__ ..")]
    items = [(i, " ".join(r.choices(words, k=8))) for i in range(20)] + [(3, "w1 W1 w2"), (3, "w1 W1 w2"), (50, None), (51, ""), (52, "unheard of"), (None, "w5")]
    for name, value in (("LEAF", leaf), ("BUCKET", bucket), ("SHARD_DOCS", shard)):
        monkeypatch.setattr(lexical, name, value)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score long").repartition(3)
    got = lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), k=6)
    assert sorted((tuple(x) for x in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranking(docs, items, 6)


def test_very_long_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "big " * 500_000 + "needle"), (2, "needle")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "needle big")], "item_id long, text string")
    assert [(r.doc_id, r["rank"]) for r in lexical.search(docs, items).orderBy("rank").collect()] == [(x[2], x[1]) for x in ranking([(1, "big " * 500_000 + "needle"), (2, "needle")], [(1, "needle big")], 20)]
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    r = np.random.default_rng(1)
    doc = np.flatnonzero(r.random(4000) < 0.5)
    t = lexical.Treaps(4000, np.zeros(len(doc), np.int64), doc, r.integers(1, 50, len(doc)), 1)
    todo, seen = [(int(t.root[0]), -1, 4000, 1 << 60)], 0
    while todo:
        node, low, high, top = todo.pop()
        assert t.top[node] <= top
        if t.key[node] >= 0:
            seen += 1
            assert low < t.key[node] < high
            todo += [(int(x), a, b, t.top[node]) for x, a, b in ((t.left[node], low, t.key[node]), (t.right[node], t.key[node], high)) if x]
    assert seen > 30


def test_pruning_leaves_intervals_out():
    """A few good documents bound the rest away: most leaves are never scored."""
    n = 20_000
    doc, impact = np.arange(n), np.ones(n, np.int64)
    impact[::2000] = 1000
    t = lexical.Treaps(n, np.zeros(n, np.int64), doc, impact, 1)
    scored = 0
    plain = t._scores

    def counted(own, weights, low, high):
        nonlocal scored
        scored += high - low
        return plain(own, weights, low, high)

    t._scores = counted
    assert sorted(d for _, d in t.best(np.array([0]), np.array([1]), 5, []))[:1] and scored < n / 4
