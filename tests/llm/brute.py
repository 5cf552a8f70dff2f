"""Plain versions of what the operators compute."""

import base64
import hashlib
import re
import string
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k, lower=True):
    w = words((text or "").translate(LOWER) if lower else text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts: dict, k: int, percent: int) -> dict:
    """doc_id to (n_shingles, smallest doc_id reachable)."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for e, both in Counter(e for g in s for e in where[g] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_words(texts: dict, least: int = 50) -> dict:
    """doc_id to the set of word positions in passages that stand in another document too."""
    where, all_words = {}, {d: words(t) for d, t in texts.items()}
    for d, w in all_words.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in all_words.items():
        found = {j for i in range(len(w) - least + 1) if len(where[tuple(w[i : i + least])]) > 1 for j in range(i, i + least)}
        if found:
            out[d] = found
    return out


def warc(rows, min_bytes=0):
    """Sorted page_id, bytes, digest, type, refers_to for rows of page_id, url, html."""
    ids = {}
    for p, _, html in rows:
        ids.setdefault((html or "").encode(), []).append(p)
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        last = max(x for x in ids[data] if x is not None) if any(x is not None for x in ids[data]) else None
        own = len(data) < min_bytes or last is None or p == last
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else last))
    return sorted(out, key=str)
