import collections
import random
import re
import textwrap
from fractions import Fraction

import numpy as np
import pytest

from rootgrain.llm import decontam, licenses, quality, toxicity

from .brute import WORD, stretches


def words(r, n):
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_overlaps_tolerate_substitutions(spark):
    r = random.Random(1)
    items = [words(r, 40), words(r, 25), words(r, 8)]
    changed = list(items[0])
    for i in (7, 15, 24, 33):
        changed[i] = "other"
    half = items[1][:6] + words(r, 30)
    docs = [(1, " ".join(words(r, 50) + items[0] + words(r, 50))), (2, " ".join(words(r, 9) + changed)), (3, " ".join(half)), (4, " ".join(w.upper() + "," for w in items[1])), (5, " ".join(words(r, 300))), (6, None), (7, ""), (8, " ".join(items[2])), (1, " ".join(items[0]))]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n_words int").repartition(3)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "short")], "item_id long, text string")
    got = sorted(tuple(x) for x in decontam.overlaps(d, b).collect())
    assert got == [(1, 0, 0, 0, 40, 40), (1, 0, 50, 0, 40, 40), (2, 0, 9, 0, 40, 36), (4, 1, 0, 0, 25, 25), (8, 2, 0, 0, 8, 8)]
    left = decontam.clean(d, b)
    assert sorted(x.doc_id for x in left.collect()) == [3, 5, 6, 7] and left.columns == d.columns


def test_overlaps_in_blocks_and_of_nothing(spark, monkeypatch):
    r = random.Random(2)
    items = [words(r, 20) for _ in range(6)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.overlaps(d, b).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert sorted(map(tuple, decontam.overlaps(d, b).collect())) == whole and len(whole) == 6
    assert decontam.overlaps(d.limit(0), b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def test_overlaps_beside_a_long_word(spark):
    r = random.Random(6)
    item, rest = words(r, 20), words(r, 40)
    texts = [" ".join(rest + item), " ".join([*item, "u" * 300]), "v" * 300 + " " + " ".join(rest)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[:15]) + " " + "v" * 300)], "item_id long, text string")
    got = sorted(tuple(x) for x in decontam.overlaps(d, b).collect())
    assert got == [(0, 0, 40, 0, 20, 20), (0, 1, 40, 0, 15, 15), (1, 0, 0, 0, 20, 20), (1, 1, 0, 0, 15, 15)]


def test_stretches_equal_brute_force():
    r = random.Random(7)
    for _ in range(600):
        n, likely = r.randint(0, 45), r.choice([0.5, 0.75, 0.85, 0.95])
        equal = [r.random() < likely for _ in range(n)]
        least, percent = r.choice([(13, 80), (min(8, n) or 1, 80), (5, 66), (13, 100)])
        got = decontam._stretches(np.array(equal, bool), least, Fraction(percent, 100))
        held = [[x for x in range(i, j) if equal[x]] for i, j in got]
        assert all(j - i >= least and 0 <= i and j <= n and 100 * len(h) >= percent * (j - i) for (i, j), h in zip(got, held, strict=True))
        assert sorted((h[0], h[-1]) for h in held) == sorted(stretches(equal, least, percent))


def test_overlaps_with_changes_near_the_ends(spark):
    r = random.Random(8)
    items = [words(r, 13), words(r, 10), words(r, 13), words(r, 28), words(r, 80)]
    change = lambda item, *at: ["other" if i in at else w for i, w in enumerate(item)]
    docs = [words(r, 5) + change(items[0], 1) + words(r, 5), change(items[1], 0), change(items[2], 6, 7), change(items[3], 12, 13, 14, 15), change(items[4], *range(20, 60)), change(items[2], 4, 7, 9)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string").coalesce(2)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = sorted(tuple(x) for x in decontam.overlaps(d, b).collect())
    assert got == [(0, 0, 5, 0, 13, 12), (1, 1, 0, 0, 10, 9), (2, 2, 0, 0, 13, 11), (3, 3, 0, 0, 28, 24), (4, 4, 0, 0, 20, 20), (4, 4, 60, 60, 20, 20)]


def brute_base(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_rules(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab c# d$|é 😀".split()) for _ in range(n)) for n in (0, 1, 2, 3, 5, 40, 60)]
    texts += ["\n".join(r.choice(["same", "x y z", "", " \t", "é"]) for _ in range(30)) for _ in range(5)] + [None, "", "a b c " * 2000, "\x0b\x0c\r", "a\x1cb\x85c\xa0d"]
    rows = quality.base(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in rows}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) for x in rows)


def test_lines_of_many_documents_count_by_host(spark):
    r = random.Random(4)
    body = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    banner = "Accept all 3 cookies, please: " + "now " * 70
    rows = [(i, "h", banner + "\n" + body()) for i in range(4)] + [(10, "other", banner + "\n" + body()), (11, None, body()), (None, "h", banner), (12, "h", None)]
    d = spark.createDataFrame([(*x, 5, 1, 2) for x in rows], "doc_id long, source string, text string, kept int, _key int, _lost int")
    got = {x.doc_id: (x.n_removed_words, x.kept) for x in quality.quality(d, max_documents=3).collect()}
    assert got[0] == (75, False) and got[10] == (0, got[10][1]) and got[11] == (0, True) and got[None][0] == 0 and got[12] == (0, False)
    assert quality.quality(d.limit(0)).count() == 0
    twice = spark.createDataFrame([*rows[:4], rows[0], (0, "h", "another text " * 30)], "doc_id long, source string, text string")
    assert sorted((x.doc_id, x.n_removed_words) for x in quality.quality(twice, max_documents=3).collect()) == [(0, 0), (0, 75), (0, 75), (1, 75), (2, 75), (3, 75)]


def test_licence_sentences_and_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, it is distributed as is."
    texts = [apache, "Nothing to see here.", None, "", "This is released under the MIT License.", "# " + apache.replace(". ", ".\n# ") + "\n" + "x " * 5000]
    got = licenses.scan(spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")).collect()
    by = {x.doc_id: (list(x.licenses), list(x.licence_sentences)) for x in got}
    assert by[0][1][:2] == ["apache-2-grant", "apache-2-compliance"] and len(by[0][0]) == 1 and by[5][0] == by[0][0]
    assert by[1] == by[2] == by[3] == ([], []) and len(by[4][0]) == 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""


def test_wrapped_licences(spark):
    want = {"MIT": MIT, "BSD-3-Clause": BSD, "ISC": ISC, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL}
    rows = []
    for name, text in want.items():
        for width in (24, 60, 72, 80):
            for mark, end in (("", "\n"), ("# ", "\n"), (" * ", "\n"), ("// ", "\r\n")):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
                rows.append((name, end.join(mark + x for x in lines)))
    got = licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [(x.name, x.text[:9], list(x.licenses)) for x in got if list(x.licenses) != [x.name]] == []
    apart = "Released under the MIT License\nLicensed under the Apache License, Version 2.0\nsome words"
    assert list(licenses.scan(spark.createDataFrame([(apart,)], "text string")).first().licenses) == ["MIT", "Apache-2.0"]


def test_toxicity_is_learned_and_clauses_count(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(r, 60)
        if toxic:
            for _ in range(4):
                text[r.randrange(60)] = "blarg" + r.choice(["er", "ing", "ous", "o"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None, None), (5001, "", None), (None, "you idiot", None)], "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in model.score(docs).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == bool(t) for i, t in labels)
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] < 0.5
    assert any(t.startswith("blarg") for t in model.terms)


@pytest.mark.parametrize(("milder", "text"), [("he is not an idiot", "he is an idiot"), ("she said: said he an idiot", "so he an idiot"), ("the idiot", "you idiot"), ("i will kill time", "i will kill you")])
def test_grammar_weighs_clauses(milder, text):
    lexicon, table = toxicity.Lexicon({}), toxicity.grammar()
    assert toxicity.features(milder, lexicon, table)[0] < toxicity.features(text, lexicon, table)[0] or "kill" in text


def test_fit_without_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "you idiot")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(docs.limit(0)).count() == 0 and 0 < model.score(docs).first().score <= 1
