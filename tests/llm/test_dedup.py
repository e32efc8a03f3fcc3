import hashlib
import random

import numpy as np

from rootgrain.llm import components, linededup, ngramjoin, suffixdedup

from . import brute


def edited(text, share, r):
    return " ".join(w if r.random() > share else f"e{r.randint(0, 10**6)}" for w in text.split())


def near_rows():
    r = random.Random(3)
    base = [" ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(20, 80))) for _ in range(3)]
    rows = [(i, edited(base[i % 3], r.choice([0.0, 0.01, 0.02, 0.03, 0.05]), r)) for i in range(240)]
    rows += [(i, " ".join(f"w{r.randint(0, 3000)}" for _ in range(r.randint(0, 9)))) for i in range(240, 280)]
    return rows + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A B"), (1004, "a  b\n"), (1005, "x " * 3000), (1006, "X " * 2000), (1007, "é B c d e"), (1008, "É b c d e")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, `set` string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_beside_a_long_word(spark):
    r = random.Random(12)
    texts = [" ".join(f"w{r.randint(0, 999)}" for _ in range(60)) for _ in range(3)]
    near = texts[1].split() + ["more"]
    rows = [(0, texts[0]), (1, texts[1]), (2, texts[2]), (3, "u" * 300 + " " + " ".join(f"x{i}" for i in range(20))), (4, "新" * 100), (5, texts[2] + " " + "v" * 700), (6, texts[0]), (7, " ".join(near)), (8, texts[2]), (9, None), (10, ""), (11, "a")]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = {x[0]: (x[1], x[2]) for x in ngramjoin.near_duplicates(d).collect()}
    assert got == brute.near_duplicates(rows) and [got[i][1] for i in (5, 6, 7, 8)] == [2, 0, 1, 2]


def test_one_of_each_keeps_columns_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "p"), (2, "a b c d e f", "q"), (2, "a b c d e f", "q"), (None, "a b c d e f", "r"), (3, None, "s")], "doc_id long, text string, _gone string")
    left = ngramjoin.one_of_each(docs).collect()
    assert sorted(map(tuple, left), key=repr) == sorted([(1, "a b c d e f", "p"), (None, "a b c d e f", "r"), (3, None, "s")], key=repr)
    assert left[0].__fields__ == ["doc_id", "text", "_gone"]


def test_near_duplicates_of_nothing(spark):
    assert ngramjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ngramjoin.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]


def test_only_sets_of_families_that_are_split_are_dealt_out(spark, monkeypatch):
    name = lambda i: b"%016d" % i
    bitmap = bytes(8)
    sets = spark.createDataFrame([(name(i), 10, bitmap) for i in range(600)], "set binary, n long, bitmap binary")
    families = spark.createDataFrame([(1, name(i)) for i in range(12)] + [(2, name(i)) for i in range(20, 40)], "a long, b binary")
    labels = spark.createDataFrame([(name(i), name(0 if i < 10 else 10)) for i in range(12)] + [(name(i), name(20)) for i in range(20, 40)], "node binary, label binary")
    tables, stored = {}, ngramjoin.stored
    monkeypatch.setattr(ngramjoin, "stored", lambda df, name, keep=False: tables.setdefault(name, df) and stored(df, name, keep))
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = spark.createDataFrame([], "a binary, b binary")
        pairs = {(r.a, r.b) for r in ngramjoin._across(families, labels, sets, done, 75, False, None).collect()}
        held = tables.get("held", tables["split"])
        assert held.count() == len(held.collect()) == 12
        todo, dealt = [held._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            else:
                todo += [node.children().apply(i) for i in range(node.children().size())]
            if kind == "ShuffleExchangeExec":
                dealt.append(node.metrics().apply("shuffleRecordsWritten").value())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    assert pairs == {(name(i), name(j)) for i in range(10) for j in (10, 11)}
    assert dealt and max(dealt) <= 40


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def repeat_rows():
    r = random.Random(4)

    def w(n):
        return " ".join(r.choice(["éa", "to", "là", "xyz", "über", "q"]) + str(r.randint(0, 9999)) for _ in range(n))

    passages = [w(30) for _ in range(4)]
    rows = [(i, w(r.randint(0, 20)) + r.choice(passages)[r.randint(0, 60) :] + w(r.randint(0, 20))) for i in range(40)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "a" * 99), (103, None), (104, ""), (105, passages[0] * 3), (106, w(300)), (108, "same row " * 30), (108, "same row " * 30), (None, "c" * 100), (110, "d" * 101)]
    x = w(80)
    return rows + [(200, x), (201, x[:250] + "#" + x[251:]), (202, x), (202, x), (None, x[7:])]


def test_repeated_bytes_equal_brute_force(spark):
    rows = repeat_rows()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hash int").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeats(docs, span=150).collect()), key=repr)
    assert got == brute.repeated_bytes(rows, 150)


def test_large_collections_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    core = "".join(r.choice("abcdefgh") for _ in range(160))
    rows = [(i, "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + core[r.choice((0, 0, 3)) :] + "".join(r.choice("uv") for _ in range(r.randint(0, 40)))) for i in range(90)] + repeat_rows()
    monkeypatch.setattr(suffixdedup, "TOGETHER", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixdedup.remove_repeats(docs, span=150).collect()), key=repr)
    assert got == brute.repeated_bytes(rows, 150)


def test_passages_under_and_over_the_span(spark):
    r = random.Random(9)

    def w(n, longest):
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, longest))) for _ in range(n))

    short, long = w(60, 5), w(60, 12)
    assert len(short) < 400 < len(long)
    rows = [(i, " ".join([w(r.randint(5, 40), 9), *([short] if i % 4 == 1 else [long.upper()] if i % 4 == 2 else [long] if i % 4 == 3 else []), w(r.randint(5, 40), 9)])) for i in range(40)]
    rows += [(40, short.replace(" ", "  ")), (41, " ".join(short.split()[:50])), (42, None), (43, "")]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "N_bytes long, text string, passages int")
    got = {x[0]: (x._n_bytes, x.n_removed, sum(p.length for p in x.passages)) for x in suffixdedup.remove_repeats(docs, "N_bytes", span=400, passage_words=51).collect()}
    assert {k: v[2] for k, v in got.items()} == {i: 60 * (i % 4 > 0) for i in range(40)} | {40: 60, 41: 0, 42: 0, 43: 0}
    assert all((got[i][1] > 0) == (i % 4 > 1) for i in range(40)) and got[42] == got[43] == (0, 0, 0)


def test_stretches_cover_all_starts_and_lie_on_one_place():
    data = np.frombuffer(("ab" * 400 + "".join(map(str, range(3000)))).encode(), np.uint8)
    first, count, lead, hashed = suffixdedup.stretches(data, 400)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - 399
    assert (lead >= count - 1).all() and (lead <= 272).all()
    short = suffixdedup._hashes(data, 128).view(np.int64)
    assert (short[first + lead] == hashed).all()


def test_columns_inserted_give_the_repeated_strings():
    r = random.Random(8)
    pieces, lead, collection, times = [], [], [], []
    for c in range(12):
        core = bytes(r.choice(b"abc") for _ in range(40))
        for _ in range(r.randint(1, 9)):
            own = bytearray(core)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(40)] = r.choice(b"abc")
            a, b = r.randint(0, 12), r.randint(28, 40)
            pieces.append(bytes(own[a:b]))
            lead.append(20 - a)
            collection.append(c)
            times.append(r.choice((1, 1, 1, 2)))
    want = set()
    for i, p in enumerate(pieces):
        for s in range(len(p) - 9):
            if s <= lead[i] and (times[i] > 1 or any(j != i and collection[j] == collection[i] and (t := s - lead[i] + lead[j]) >= 0 and len(q[t : t + 10]) == 10 and q[t : t + 10] == p[s : s + 10] for j, q in enumerate(pieces))):
                want.add((i, s))
    for kind in (np.uint8, np.uint64):
        symbols = [np.frombuffer(p, np.uint8).astype(kind) for p in pieces]
        got = {tuple(x) for x in suffixdedup.repeated_starts(symbols, np.array(lead), np.array(collection), np.array(times), 10).tolist()}
        assert got == want and want


def test_remove_repeats_of_nothing(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def line_rows():
    r = random.Random(6)
    pool = [" ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(1, 5))) for _ in range(30)]
    rows = []
    for i in range(60):
        own = [f"own {i} {j}" for j in range(r.randint(0, 4))]
        at = r.randint(0, 25)
        rows.append((i, "\n".join(own[:2] + pool[at : at + r.randint(0, 9)] + ["", "  "] + own[2:])))
    rows += [(i, "\n".join(r.choice("ab") for _ in range(r.randint(5, 60)))) for i in range(60, 75)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[5][1]), (104, "  " + pool[3] + " "), (105, "\n".join(pool)), (106, "\n".join(pool[3:])), (107, "\n".join(pool) + "\nx"), (108, "word " * 20000 + "\n" + pool[0]), (109, "word " * 20000), (None, "\n".join(pool[2:20]))]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "k", 5, 1, 2) for i, t in rows], "doc_id long, text string, k string, n_runs int, _d int, _t_ int").repartition(3)
    deduped = linededup.line_dedup(docs)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.longest_run) for r in deduped.collect()}
    assert got == brute.line_dedup(rows, linededup.MIN_WORDS)
    assert set(docs.columns) < set(deduped.columns) and got[107][3] == 30


def test_suffix_levels_and_the_longest_run(spark):
    run = "\n".join(f"line number {i}" for i in range(9))
    docs = spark.createDataFrame([(1, "x\n" + run), (2, run + "\ny"), (3, "z")], "doc_id long, text string")
    levels = linededup.suffix_levels(linededup.recurring(linededup.line_sequence(docs, "doc_id", "text")))
    assert [level.count() for level in levels] == [18, 16, 12, 4]
    ranks = levels[1].select("rank", "n").distinct().collect()
    assert len(ranks) == 8 and all(r.n == 2 for r in ranks)
    got = {(r.d.k, r.i): (r.l, r.origin.d.k, r.origin.i) for r in linededup.longest_earlier(levels).collect()}
    assert got == {(2, i): (9 - i, 1, i + 1) for i in range(9)}
    runs = linededup.later_runs(docs).where("maximal").collect()
    assert [(r.d.k, r.i, r.l, r.origin.i) for r in runs] == [(2, 0, 9, 1)]


def test_line_dedup_deals_out_texts_once_and_counts_words_as_far_as_needed(spark):
    docs = spark.createDataFrame([(1, "\t" + "word " * 5000), (2, "a b\n\nc d e "), (3, None)], "doc_id long, text string")
    lines = linededup.line_sequence(docs, "doc_id", "text")
    assert sorted((r.d.k, r.line, r.w) for r in lines.collect()) == [(1, 0, linededup.MIN_WORDS), (2, 0, 2), (2, 2, 3)]
    assert sorted((r.d.k, r.line, r.w) for r in linededup.line_sequence(docs, "doc_id", "text", 1).collect()) == [(1, 0, 1), (2, 0, 1), (2, 2, 1)]
    kept = linededup.line_dedup(docs)
    todo, dealt = [kept._jdf.queryExecution().sparkPlan()], []
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("JoinExec"):
            dealt += [node.children().apply(i).schema().simpleString() for i in range(2)]
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert dealt and not any("array<string>" in x for x in dealt)


def test_ranks_of_documents_with_short_runs_are_not_asked_for(spark, monkeypatch):
    run = [f"line number {i}" for i in range(16)]
    rows = [(1, "\n".join(run)), (2, "\n".join(run))] + [(i, f"once {i}\nthe same line") for i in range(10, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = linededup.suffix_levels(linededup.recurring(linededup.line_sequence(docs, "doc_id", "text")))
    tables, stored = [], linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name, keep=False: tables.append((name, df)) or stored(df, name, keep))
    got = {(r.d.k, r.i): (r.l, r.origin.d.k, r.origin.i) for r in linededup.longest_earlier(levels).collect()}
    assert got == {(2, i): (16 - i, 1, i) for i in range(16)} | {(i, 1): (1, 10, 1) for i in range(11, 90)}
    ahead = [df for name, df in tables if name == "ahead"]
    asked = [df._jdf.queryExecution().optimizedPlan().toString() for df in ahead]
    assert len(ahead) == len(levels) - 1 and all("top" in x for x in asked)


def test_a_run_of_short_lines_counts_by_its_words(spark):
    short = ["one two", "three", "four five", "six seven eight", "nine", "ten"]
    docs = spark.createDataFrame([(1, "\n".join(short)), (2, "\n".join(short[:4])), (3, "p\n" + "\n".join(short) + "\nq")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_runs, r.longest_run, r.text) for r in linededup.line_dedup(docs).collect()}
    assert got == {1: (0, 0, 0, "\n".join(short)), 2: (0, 0, 0, "\n".join(short[:4])), 3: (6, 1, 6, "p\nq")}


def test_line_dedup_of_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a long line that is said more than once in here"), (1, "a long line that is said more than once in here"), (None, "a long line that is said more than once in here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_removed) for r in linededup.line_dedup(docs).collect())
    assert [x[2] for x in got] == [0, 1, 1]
    assert linededup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_block_pairs_are_the_possible_pairs_of_each_list():
    r = np.random.default_rng(2)
    n = 900
    token, size, place = r.integers(0, 60, n), r.integers(5, 40, n), r.integers(0, 8, n)
    place = np.minimum(place, size - 1)
    order = np.lexsort((place, size, token))
    token, size, place = token[order], size[order], place[order]
    got = [(a, b) for i, j in ngramjoin._block_pairs(np.arange(n), token, size, place, 75) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    i, j = np.triu_indices(n, 1)
    want = ngramjoin._possible(*(x[token[i] == token[j]] for x in (i, j)), size, place, 75)
    assert sorted(got) == sorted(zip(*(x.tolist() for x in want), strict=True)) and len(got) > 100


def test_list_entries_cost_the_same_over_few_and_many_groups():
    """Each set with one entry in a group, as where there are many groups, costs no more than with many."""
    rng = np.random.default_rng(4)
    size = {}
    for sets, each in ((60, 100), (6000, 1)):
        names, sizes = (np.repeat(x, each) for x in (rng.integers(0, 2**40, sets), rng.integers(300, 900, sets).astype(np.uint32)))
        tokens, place = np.sort(rng.integers(0, 2**30, 6000).astype(np.uint32)), rng.integers(0, 200, 6000).astype(np.uint16)
        order = rng.permutation(6000)
        given = tokens, names[order], place, sizes[order]
        blob = ngramjoin._packed_entries(*given)
        assert all((a == b).all() for a, b in zip(given, ngramjoin._entries(blob, 6000), strict=True))
        size[sets] = len(blob) / 6000
    assert size[6000] < 11 and size[6000] < 1.5 * size[60]


def test_common_passages_of_copies_make_no_families(spark, monkeypatch):
    """All shingles of a text with several near copies are in several documents; what very many share comes last all the same."""
    r = random.Random(21)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage, rows = " ".join(words(40)), []
    for group in range(30):
        first, last = words(r.randint(60, 140)), words(r.randint(60, 140))
        rows += [(100 * group + k, " ".join([*first, passage, *last, f"e{k}"])) for k in range(6)]
    kinds, stored = [], ngramjoin.stored

    def kept(df, name, keep=False):
        out = stored(df, name, keep)
        if name == "candidates":
            kinds.extend(x.kind for x in out.collect())
        return out

    monkeypatch.setattr(ngramjoin, "stored", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in ngramjoin.near_duplicates(docs).collect()} == {i: i - i % 100 for i, _ in rows}
    assert kinds.count(0) >= 30 and kinds.count(1) == 0
    assert sorted(x.doc_id for x in ngramjoin.one_of_each(docs).collect()) == [100 * group for group in range(30)]


def test_entries_without_a_possible_partner_are_not_in_a_long_list():
    r = np.random.default_rng(8)
    for n in (1, 2, 9, 60):
        size = np.sort(r.integers(5, 60, n))
        place = np.minimum(r.integers(0, 15, n), size - 1)
        i, j = ngramjoin._possible(*np.triu_indices(n, 1), size, place, 75)
        assert np.flatnonzero(ngramjoin._partnered(size, place, 75)).tolist() == sorted({*i.tolist(), *j.tolist()})
        assert n < 60 or 0 < len({*i.tolist(), *j.tolist()}) < n


def test_shingles_in_lists_are_told_by_more_than_32_bits():
    tokens = np.array([5, 5 + 2**32, 5 + 2**33, 2**40 - 1], np.uint64)
    blob = ngramjoin._packed_entries(tokens, np.arange(4), np.arange(4, dtype=np.uint16), np.full(4, 9, np.uint32))
    assert ngramjoin._entries(blob, 4)[0].tolist() == tokens.tolist()
