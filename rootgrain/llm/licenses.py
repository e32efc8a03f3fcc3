"""Licence scans by sentence rules.

A text is cut into sentences; those that speak of licences are normalised and mapped to the
identifiers of known licence sentences. The identifiers of a text, in their order, are then matched
against ordered licence rules: at each place the first rule whose identifiers follow there wins and
takes them. All of it is row-local DataFrame work, without a shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The known sentences, as (identifier, pattern over the normalised sentence), first match wins.
SENTENCES = (
    ("apache-2-grant", r"licensed under the apache license,? version 2(\.0)?"),
    ("apache-2-compliance", r"you may not use this (file|work|software) except in compliance with the license"),
    ("apache-2-disclaimer", r"unless required by applicable law or agreed to in writing"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included"),
    ("mit-disclaimer", r"the software is provided .?as is.?, without warranty of any kind"),
    ("mit-name", r"(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("isc-grant", r"permission to use, copy, modify,? and(/or)? distribute this software for any purpose"),
    ("isc-disclaimer", r"the software is provided .?as is.? and the author disclaims all warranties"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-source", r"redistributions? of source code must retain"),
    ("bsd-binary", r"redistributions? in binary form must reproduce"),
    ("bsd-name", r"neither the name of .* may be used to endorse"),
    ("bsd-3-name", r"under the (3.clause|new|modified) bsd license"),
    ("bsd-2-name", r"under the (2.clause|simplified) bsd license"),
    ("agpl-3-name", r"gnu affero general public license,? version 3"),
    ("lgpl-3-name", r"gnu lesser general public license,? version 3"),
    ("lgpl-2-name", r"gnu lesser general public license,? version 2(\.1)?"),
    ("gpl-3-later", r"gnu general public license.*version 3.*or .*any later version"),
    ("gpl-2-later", r"gnu general public license.*version 2.*or .*any later version"),
    ("gpl-3-name", r"gnu general public license,? version 3"),
    ("gpl-2-name", r"gnu general public license,? version 2"),
    ("gpl-warranty", r"this program is distributed in the hope that it will be useful"),
    ("mpl-2-name", r"mozilla public license,? (version|v\.?) ?2(\.0)?"),
    ("cc-by-nc-sa-4", r"cc by-nc-sa 4(\.0)?"),
    ("cc-by-nc-nd-4", r"cc by-nc-nd 4(\.0)?"),
    ("cc-by-nc-4", r"cc by-nc 4(\.0)?"),
    ("cc-by-sa-4", r"cc by-sa 4(\.0)?"),
    ("cc-by-nd-4", r"cc by-nd 4(\.0)?"),
    ("cc-by-4", r"cc by 4(\.0)?"),
    ("cc0", r"cc0 1(\.0)?"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("all-rights", r"all rights reserved"),
)
#: Ordered rules, as (licence, identifiers that follow one another).
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-disclaimer")),
    ("MIT", ("mit-grant", "mit-disclaimer")),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("Apache-2.0", ("apache-2-grant", "apache-2-compliance", "apache-2-disclaimer")),
    ("Apache-2.0", ("apache-2-grant", "apache-2-compliance")),
    ("Apache-2.0", ("apache-2-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-later", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-later", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-later",)),
    ("GPL-2.0-or-later", ("gpl-2-later",)),
    ("AGPL-3.0-only", ("agpl-3-name",)),
    ("LGPL-3.0-only", ("lgpl-3-name",)),
    ("LGPL-2.1-only", ("lgpl-2-name",)),
    ("GPL-3.0-only", ("gpl-3-name",)),
    ("GPL-2.0-only", ("gpl-2-name",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("MIT", ("mit-name",)),
    ("MIT-fragment", ("mit-grant",)),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("BSD-fragment", ("bsd-grant",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("All-Rights-Reserved", ("all-rights",)),
)
#: A sentence without any of these is not looked at; each known sentence has one.
SPEAKS = r"licen[cs]e|licensed|cc by|cc0|copyright|permission|redistribut|provided .?as is|neither the name|required by applicable law|distributed in the hope|public domain|rights reserved"
#: One letter for each identifier, so that the identifiers of a text are a string and the rules a pattern over it.
LETTER = {name: chr(65 + i) if i < 26 else chr(97 + i - 26) for i, (name, _) in enumerate(SENTENCES)}
#: The letter of a sentence that speaks of licences and is not known.
UNKNOWN = "-"
#: What stands before the text of a line in comments of programs, and SPEAKS where line ends and such marks may part words.
MARKS = r"(?m)^[ \t]*(?:(?:[#*;%>!]+|/[/*]+|--+|<!--|dnl\b|rem\b)[ \t]*)+/?"
SPEAKS_WRAPPED = SPEAKS.replace(" ", r"[\s#*;%>!/<-]+")
ANY_SENTENCE = "|".join(f"(?:{p})" for _, p in SENTENCES)
RULE_PATTERN = "|".join("".join(LETTER[i] for i in ids) for _, ids in RULES)


def _letter(sentence: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in SENTENCES:
        out = out.when(sentence.rlike(pattern), LETTER[name])
    return out.otherwise(UNKNOWN)


def _letters(sentence: Column) -> Column:
    """The letter of a sentence of one line; those of all known sentences in one of several lines, which may be run-on."""
    found = F.array_join(F.transform(F.regexp_extract_all(F.translate(sentence, "\n", " "), F.lit(f"({ANY_SENTENCE})"), F.lit(0)), _letter), "")
    return F.when(sentence.contains("\n"), F.when(found == "", UNKNOWN).otherwise(found)).otherwise(_letter(sentence))


def scan(docs: DataFrame, text: str = "text", licenses: str = "licenses", sentences: str = "licence_sentences", unknown: str = "n_unknown_sentences") -> DataFrame:
    """docs with three more columns: the licences found, in the order of the text and with repeats;
    the identifiers of the known licence sentences, in that order; and how many sentences speak of
    licences without being known.

    Null and empty texts have empty lists and 0. A sentence ends at white space after . ! or ?, at
    a line end after a colon, at an empty line and before a list item, so it may be wrapped over
    lines; comment marks before its lines don't count. Sentences that don't speak of licences are passed over, so they may stand
    between the sentences of a rule; an unknown licence sentence may not. Columns of these names
    are replaced, all others pass through; repeated rows are scanned each.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.regexp_replace(F.lower(body), MARKS, "")
    ended = F.regexp_replace(F.regexp_replace(lines, r"([.!?])[ \t\r]+|([.!?:])(?=\n)|:[ \t\r]+(?=\n)", "$1$2\n\n"), r"\n(?=[ \t]*[-•][ \t])", "\n\n")
    tidy = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"[ \t\r]*\n[ \t\r]*", "\n"), r"[ \t\r]+", " ")
    normal = F.filter(F.transform(F.split(ended, r"\n[ \t\r]*\n"), tidy), lambda s: F.translate(s, "\n", " ").rlike(SPEAKS))
    letters = F.when(F.lower(body).rlike(SPEAKS_WRAPPED), F.array_join(F.transform(normal, _letters), "")).otherwise("")
    name = F.create_map(*[F.lit(x) for pair in ((LETTER[n], n) for n, _ in SENTENCES) for x in pair])
    first = {}
    for licence, ids in RULES:
        first.setdefault("".join(LETTER[i] for i in ids), licence)
    licence = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    seq = fresh(docs, "_seq")[0]
    found = F.transform(F.regexp_extract_all(F.col(seq), F.lit(f"({RULE_PATTERN})"), F.lit(1)), lambda m: licence[m])
    known = F.transform(F.filter(F.split(F.col(seq), ""), lambda c: (c != UNKNOWN) & (c != "")), lambda c: name[c])
    counted = F.length(seq) - F.length(F.regexp_replace(seq, UNKNOWN, ""))
    return docs.withColumn(seq, letters).withColumns({licenses: found, sentences: known, unknown: counted.cast("long")}).drop(seq)


def _sql_regex(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL for the rows of op1_license_scan."""
    letter = "CASE " + " ".join(f"WHEN regexp_matches(s, {_sql_regex(p)}) THEN '{LETTER[n]}'" for n, p in SENTENCES) + f" ELSE '{UNKNOWN}' END"
    first = {}
    for licence, ids in RULES:
        first.setdefault("".join(LETTER[i] for i in ids), licence)
    licence = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in first.items()) + " END"
    name = "CASE c " + " ".join(f"WHEN '{LETTER[n]}' THEN '{n}'" for n, _ in SENTENCES) + " END"
    re = _sql_regex
    return f"""
WITH lines AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), {re(MARKS)}, '', 'g') AS t, regexp_matches(lower(coalesce(text, '')), {re(SPEAKS_WRAPPED)}) AS speaks FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ':[ \\t\\r]+\\n', chr(10) || chr(10) || chr(10), 'g'), '([.!?])[ \\t\\r]+', '\\1' || chr(10) || chr(10), 'g'), '([.!?:])\\n', '\\1' || chr(10) || chr(10) || chr(10), 'g') AS t FROM lines WHERE speaks),
b AS (SELECT doc_id, regexp_replace(t, '\\n([ \\t]*[-•][ \\t])', chr(10) || chr(10) || '\\1', 'g') AS t FROM a),
normal AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\n[ \\t\\r]*\\n'), lambda s: regexp_replace(regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '[ \\t\\r]*\\n[ \\t\\r]*', chr(10), 'g'), '[ \\t\\r]+', ' ', 'g')), lambda s: regexp_matches(replace(s, chr(10), ' '), {re(SPEAKS)})) AS ss FROM b),
seq AS (SELECT doc_id, array_to_string(list_transform(ss, lambda x: CASE WHEN contains(x, chr(10)) THEN coalesce(nullif(array_to_string(list_transform(regexp_extract_all(replace(x, chr(10), ' '), {re("(" + ANY_SENTENCE + ")")}, 0), lambda s: {letter}), ''), ''), '{UNKNOWN}')
  ELSE {letter.replace("(s, ", "(x, ")} END), '') AS q FROM normal)
SELECT doc_id,
  array_to_string(list_transform(regexp_extract_all(q, '({RULE_PATTERN})', 1), lambda m: {licence}), ',') AS licenses,
  array_to_string(list_transform(list_filter(string_split(q, ''), lambda c: c <> '{UNKNOWN}' AND c <> ''), lambda c: {name}), ',') AS licence_sentences,
  CAST(length(q) - length(replace(q, '{UNKNOWN}', '')) AS BIGINT) AS n_unknown_sentences
FROM seq WHERE q <> ''
"""
