"""Merging of single pre-tokens for byte-level BPE vocabularies in the JSON format.

The general entry of a tokenizer library costs many times the merging of one short word. The ranks
of the same vocabulary file, given to a rank-based merger, make the same tokens of a pre-token; the
tests hold both against one another. Texts whose characters the two could treat differently don't
come here.
"""

import json
import re

import tiktoken

#: ASCII and the Latin letters of U+00C0 to U+017F whose lower case is one character: for these, all
#: Unicode tables agree on letters, digits, white space, normal forms and lower case.
SAFE = re.compile("[\\x00-\\x1b\\x20-\\x7fÀ-ÖØ-öø-įı-ňŊ-ž]*")
#: Stands for the end-of-word suffix of a vocabulary; no UTF-8 text has this byte.
END = b"\xff"


def byte_of_symbol() -> dict[str, int]:
    """The byte for which each symbol of a byte-level vocabulary stands: printable Latin-1
    characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """ids(word): the token ids of one pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, symbols, ranks = model.get("end_of_word_suffix") or "", byte_of_symbol(), {}
        for token, number in model["vocab"].items():
            ends = bool(suffix) and token.endswith(suffix)
            ranks[bytes(symbols[c] for c in token[: len(token) - len(suffix) * ends]) + END * ends] = number
        self._end = END if suffix else b""
        self._merge = tiktoken.Encoding(path, pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def ids(self, word: str) -> list[int]:
        return self._merge(word.encode() + self._end)
