"""Packing documents into windows of a fixed number of tokens by the online sum-of-squares rule.

A document's whole windows are cut off first. What is left is placed at the fill level that makes the sum of the squared
counts of partly filled windows smallest: ``counts[h]`` is the number of open windows with h tokens, and an item of s tokens
that goes into a window at level h changes the sum by what counts[h] loses and counts[h + s] gains. Equal changes go to the
fullest window.

Each task packs the rows of its partition as they come, so nothing is shuffled. A task holds the ids of its open windows only,
and of MOST_OPEN windows at most. At its end, or at that bound, the open windows are topped up: with q times the window's size and r
tokens in them, the q fullest keep what the rule has put into them and are filled with the contents of the others, cut as it fits.
The r tokens that are left stay open, or at the end are cut into sequences whose lengths are powers of two, which need no
padding. ``by_rule`` says of each piece whether it lies where the rule (or the cut into whole windows) has put it.

Tokens of a text are those of its parts: the pieces that the tokenizer's splitter makes of Latin text, else what stands between
ASCII white space, which neither its normaliser nor its splitter looks across. Parts are looked up in a bounded table of
earlier ones. New ones that are words of Latin lower-case letters go to the tokenizer's model as its splitter would hand them
over, other ones to the tokenizer.

Edge cases: a null or empty text is its end token alone; a null doc_id stays null; repeated rows are packed each; a document
longer than a window spans several; an empty table or partition gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import bound_batches, ship_code
from .memo import Memo, own

#: Documents that are encoded together.
TOGETHER = 128
#: Parts of texts whose ids a worker remembers (some 200 bytes each), and the length up to which a part is remembered.
TABLE, LONGEST = 1_000_000, 64
#: Open windows that a task holds (16 KB each, if full).
MOST_OPEN = 2048
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, by_rule boolean"
SCHEMA = pa.schema([(c.split()[0], pa.bool_() if c.endswith("boolean") else pa.int64()) for c in PIECES.split(", ")])
PARTS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
# The tokenizer's splitter, for lower-case texts of the first 256 code points, which its normaliser leaves alone.
LETTERS, DIGITS, BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\x0b\x0c\x85\xa0"
WORD = re.compile(f"[{LETTERS}]+")
LATIN = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^{BLANKS}{LETTERS}{DIGITS}]+")

Piece = tuple[int | None, int, bytes, int, bool]  # doc_id, start, ids as bytes, doc_tokens, by_rule


class Encoder:
    """Texts to token ids, as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, split = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = {i: "".join(piece for piece, _ in split(chr(i))) for i in range(128, 256) if WORD.fullmatch(chr(i))}
        self.table = Memo("packing", TABLE, self.part, lambda part: len(part) <= LONGEST)

    @staticmethod
    def parts(text: str) -> list[str]:
        if "<|" not in text:  # no special token
            try:
                text.encode("latin-1")
                return LATIN.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return PARTS.findall(text)

    def part(self, part: str) -> bytes:
        if WORD.fullmatch(part):
            ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.spelled))]
        else:
            ids = self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.table.__getitem__, self.parts(t))) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Windows of size tokens. add() returns the windows that are complete, close() all that are left."""

    def __init__(self, size: int, most_open: int = MOST_OPEN) -> None:
        self.size, self.most_open = size, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.windows = 0

    def level(self, s: int) -> int:
        """The fill level for an item of s < size tokens; 0 for a new window."""
        counts = self.counts
        levels = np.flatnonzero(counts[: self.size - s + 1])
        to = levels + s
        change = -2 * counts[levels] + np.where(to < self.size, 2 * counts[to] + 1, 0) + 1
        fresh = 2 * counts[s] + 1
        if not len(levels) or change.min() > fresh:
            return 0
        return int(levels[np.flatnonzero(change == change.min())[-1]])

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n, wide = len(ids) // 4, self.size * 4
        whole = n // self.size
        for k in range(whole):
            yield [(doc_id, k * self.size, ids[k * wide : (k + 1) * wide], n, True)]
        s = n - whole * self.size
        if not s:
            return
        h = self.level(s)
        window: list[Piece] = []
        if h:
            window = self.open[h].pop()
            self.counts[h] -= 1
            self.windows -= 1
        window.append((doc_id, whole * self.size, ids[whole * wide :], n, True))
        if h + s == self.size:
            yield window
            return
        self._hold(h + s, window)
        if self.windows > self.most_open:
            full, rest = self._topped()
            yield from full
            if rest:
                self._hold(sum(len(p[2]) // 4 for p in rest), rest)

    def _hold(self, level: int, window: list[Piece]) -> None:
        self.open.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.windows += 1

    def _topped(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Closes all windows: as many full ones as there are tokens for, the fullest of the open ones; and the pieces that are left."""
        held = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        full = sum(h for h, _ in held) // self.size
        self.open, self.windows = {}, 0
        self.counts[:] = 0
        cut = [(*p[:4], False) for _, w in reversed(held[full:]) for p in w][::-1]
        out = []
        for h, window in held[:full]:
            room = self.size - h
            while room:
                doc_id, start, ids, n, _ = cut.pop()
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: take * 4], n, False))
                if take * 4 < len(ids):
                    cut.append((doc_id, start + take, ids[take * 4 :], n, False))
                room -= take
            out.append(window)
        return out, cut

    def close(self) -> Iterator[list[Piece]]:
        full, rest = self._topped()
        yield from full
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc_id, start, ids, n, _ = rest.pop()
                take = min(room, len(ids) // 4)
                window.append((doc_id, start, ids[: take * 4], n, False))
                if take * 4 < len(ids):
                    rest.append((doc_id, start + take, ids[take * 4 :], n, False))
                room -= take
            yield window


def _rows(windows: Iterable[list[Piece]], first: int) -> Iterator[tuple]:
    for k, window in enumerate(windows):
        at = 0
        for doc_id, start, ids, n, by_rule in window:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, first + k, at, by_rule
            at += len(ids) // 4


def _task(path: str, end_id: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("packing")
        encode, packer, end = encoder(path), Packer(size), np.asarray([end_id], "<u4").tobytes()

        def windows() -> Iterator[list[Piece]]:
            for batch in batches:
                for at in range(0, len(batch), TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                        yield from packer.add(doc_id, ids + end)
            yield from packer.close()

        out: list[tuple] = []
        for row in _rows(windows(), TaskContext.get().partitionId() << 32):
            out.append(row)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 4096) -> DataFrame:
    """A row for each piece of the documents (doc_id, text); a sequence is what has one sequence_id."""
    ship_code(docs.sparkSession)
    bound_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(_task(tokenizer_path, end_id, size), PIECES)
