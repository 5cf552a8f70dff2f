"""Hashes of words and of their shingles, in Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .memo import Memo

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words whose hashes a worker remembers.
TABLE = 200_000
FACTOR, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


_hashes = Memo("shingles", TABLE, xxhash.xxh64_intdigest, lambda word: len(word) <= 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> S33)) * MIX1
    x = (x ^ (x >> S33)) * MIX2
    return x ^ (x >> S33)


def word_hashes(text: str, lower: bool = False) -> np.ndarray:
    """A hash for each word. lower: A to Z count as a to z."""
    data = text.encode("utf-8", "surrogatepass")
    words = WORDS.findall(data.lower() if lower else data)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words, by position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * FACTOR + words[j : j + n]
    return mixed(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of its whole sequence, if it has fewer words."""
    words = word_hashes(text or "", lower=True)
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(words.tobytes(), seed=k)], np.uint64)
    return np.unique(rolled(words, k))
