"""Words to token ids by a minimal acyclic transducer, in a file that tasks map into memory.

States are shared by all words with the same endings: sorted words are added one by one, and what the next word can't change any more
is replaced by an equal state, if there is one. Each edge has the number of words that come before those through it, so the sum along
a path is the place of the word, which addresses its ids. Sums do not keep states apart, so the automaton stays as small as without.

The file: a header, and arrays of 32-bit numbers: edges in order of (state, byte), as key, target and weight; final states; where each
word's ids start; ids. Looking up walks all words of a batch at once, a byte a step, by binary search among the edges.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

HEADER = ("edges", "states", "words", "ids", "start", "longest")


def minimal(words: Iterable[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """The states (final, edges) of the smallest automaton for sorted, distinct words, targets before sources; and the first state."""
    states: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]

    def settle(depth: int) -> None:
        """The states below this depth of the last word's path stay as they are."""
        while len(path) > depth + 1:
            final, edges = path.pop()
            at = states.setdefault((final[0], tuple(edges)), len(states))
            above = path[-1][1]
            above[-1] = (above[-1][0], at)

    last = b""
    for word in words:
        if last and word <= last:
            raise ValueError("words must be sorted and distinct")
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append(([False], []))
        path[-1][0][0] = True
        last = word
    settle(0)
    final, edges = path[0]
    first = states.setdefault((final[0], tuple(edges)), len(states))
    return list(states), first


def compiled(lexicon: dict[bytes, list[int]]) -> bytes:
    """The file for words and their ids."""
    words = sorted(lexicon)
    states, first = minimal(words)
    below = [0] * len(states)
    keys, targets, weights = [], [], []
    for at, (final, edges) in enumerate(states):
        n = int(final)
        for byte, target in edges:
            keys.append(at << 8 | byte)
            targets.append(target)
            weights.append(n)
            n += below[target]
        below[at] = n
    finals = [int(final) for final, _ in states]
    starts, ids = [0], []
    for word in words:
        ids += lexicon[word]
        starts.append(len(ids))
    header = [len(keys), len(states), len(words), len(ids), first, max(map(len, words), default=0)]
    return b"".join(np.asarray(x, "<i4").tobytes() for x in (header, keys, targets, weights, finals, starts, ids))


class Transducer:
    """A compiled lexicon, as it lies in the file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, "<i4", "r")
        for name, value in zip(HEADER, data[: len(HEADER)].tolist(), strict=True):
            setattr(self, f"n_{name}" if name in HEADER[:4] else name, value)
        sizes = [self.n_edges, self.n_edges, self.n_edges, self.n_states, self.n_words + 1, self.n_ids]
        cuts = len(HEADER) + np.cumsum([0, *sizes])
        self.keys, self.targets, self.weights, self.final, self.starts, self.ids = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the lexicon's; -1 for one that it does not have."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state, place = np.full(len(words), self.start, np.int32), np.zeros(len(words), np.int64)
        walking = np.flatnonzero(lengths <= self.longest)
        lost = lengths > self.longest
        for i in range(self.longest):
            walking = walking[lengths[walking] > i]
            if not len(walking):
                break
            keys = state[walking] << 8 | data[starts[walking] + i]
            at = np.searchsorted(self.keys, keys)
            found = at < self.n_edges
            found[found] = self.keys[at[found]] == keys[found]
            lost[walking[~found]] = True
            walking, at = walking[found], at[found]
            state[walking] = self.targets[at]
            place[walking] += self.weights[at]
        lost |= self.final[state] == 0
        place[lost] = -1
        return place
