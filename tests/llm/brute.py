"""Plain single-process versions of what the operators compute."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def near_duplicates(rows, percent=75):
    """{key: (set size, smallest key of the component)}"""
    sets = {}
    for key, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def repeated_bytes(rows, span):
    """[(key, bytes, removed, spans, sha256 of the rest)]"""
    seen = collections.Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    out = []
    for key, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((key, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def line_dedup(rows, min_words):
    """{key: (text, lines, removed, longest later copy in lines)} for rows with distinct keys"""
    lines = {k: [(n, s.strip(" \t\n\r\x0b\x0c")) for n, s in enumerate(t.split("\n")) if s.strip(" \t\n\r\x0b\x0c")] for k, t in rows if t is not None}
    gone, longest = collections.defaultdict(set), collections.Counter()
    for length in range(1, max(map(len, lines.values())) + 1):
        seen = set()
        for k in sorted(lines, key=lambda k: (k is not None, k)):
            own = lines[k]
            for i in range(len(own) - length + 1):
                run = tuple(s for _, s in own[i : i + length])
                if run in seen and sum(len(WORD.findall(s)) for s in run) >= min_words:
                    gone[k].update(n for n, _ in own[i : i + length])
                    longest[k] = length
                seen.add(run)
    return {k: (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[k]), len(lines.get(k, ())), len(gone[k]), longest[k]) for k, t in rows}


def stretches(equal, least, percent):
    """{(first, last equal place)} of all stretches of `least` places or more that are equal enough, less those that lie in another"""
    found = set()
    for i in range(len(equal)):
        for j in range(i + least, len(equal) + 1):
            at = [n for n in range(i, j) if equal[n]]
            if at and 100 * len(at) >= percent * (j - i):
                found.add((at[0], at[-1]))
    return {(a, b) for a, b in found if not any((x, y) != (a, b) and x <= a and b <= y for x, y in found)}
