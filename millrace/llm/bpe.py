"""Byte pair encoding with a lexicon of frequent words, and decoding.

Words are what ``packing.Encoder.parts`` cuts texts into: the tokenizer's own pieces of Latin text, else what stands between ASCII white
space. Their counts over all texts are summed in each task first. The most frequent ones, LEXICON at most, are encoded and compiled to
a transducer (``lexicon``); the file goes to every executor, whose workers map it into memory and share its pages. Words that it does
not have are merged: lowest rank first, the first of equal ones first, as the tokenizer's file says.

A word's ids depend on the word alone, so texts of any length are cut at white space and encoded in portions; a task holds a portion
and the ids of a batch. Texts are not shuffled, only words with their counts.

Normalisation and splitting of words beyond the first 256 code points are the library's; merging and decoding are done here. Files
whose settings this does not know are refused.

Edge cases: a null text is an empty one and has no ids, which decode to an empty text; special tokens in a text become their ids, as in
the library; a null doc_id stays null; repeated rows are encoded each; an empty table gives no rows and an empty lexicon; extra columns
are not read. Decoding null ids gives an empty text, an unknown id raises KeyError.
"""

from __future__ import annotations

import heapq
import json
import math
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, remove_folder, ship_code
from .common import new_folder
from .lexicon import Transducer, compiled
from .memo import own
from .packing import BLANKS, DIGITS, LETTERS, Encoder

#: Words that a lexicon has at most, and the bytes of its longest ones.
LEXICON, LONGEST = 65_536, 64
#: Characters of a portion; words that a task counts before it hands them on.
PORTION, COUNTED = 1 << 20, 200_000
#: Bytes of the pieces that are merged together; longer ones are merged one by one.
WIDTHS = (6, 9, 12, 16, 24, 48)
#: Words are taken by steps of their counts: an eighth of a power of two.
STEPS = 8
#: One piece that the tokenizer's normaliser leaves as it is: of the first 256 code points, in lower case.
OTHERS = "".join(re.escape(c) for c in map(chr, range(256)) if c == c.lower() and not re.match(f"[{LETTERS}{DIGITS}{BLANKS}]", c))
PIECE = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[{OTHERS}]+")
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    """What a tokenizer's file says: ids, merges and special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, added = data["model"], data["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and model["type"] == "BPE"
        simple = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        vocab, suffix, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        whole = all(x in vocab for c in letters.values() for x in (c, c + suffix))
        if not plain or not simple or not whole or data["decoder"] or data["post_processor"]:
            raise ValueError(f"{path} has settings that are not known here")
        self.vocab: dict[str, int] = vocab
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.first, self.last = (np.array([vocab[letters[i] + end] for i in range(256)], np.int32) for end in ("", suffix))
        self.bytes = {c: i for i, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(map(re.escape, by_length))})") if by_length else None
        library = Tokenizer.from_file(path)
        self.normalized, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def tokens(self) -> list[str | None]:
        """Each id's token."""
        known = {i: t for t, i in (self.vocab | self.special).items()}
        return [known.get(i) for i in range(max(known) + 1)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; the number of merges for one that is not merged. Ids under 0 are none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.order[at], len(self.made)).astype(np.int32)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and where each piece's begin and how many they are.

        Pieces of about one length are rows of a matrix. In a round each row merges its pair of the lowest rank, the first of several,
        until there is none; rows that are through go out.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        from_ = np.cumsum(sizes) - sizes
        start, length, pool, end = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)], 0
        shortest = 0
        for most in WIDTHS:
            rows = np.flatnonzero((sizes > shortest) & (sizes <= most))
            shortest = most
            if not len(rows):
                continue
            n = sizes[rows]
            columns = np.arange(most)[None, :]
            inside = columns < n[:, None]
            ids = np.where(inside, self.first[data[np.minimum(from_[rows][:, None] + columns, len(data) - 1)]], -1)
            ids[np.arange(len(rows)), n - 1] = self.last[data[from_[rows] + n - 1]]
            for found, part in self._rounds(ids, rows):
                counts = (part >= 0).sum(axis=1)
                start[found], length[found] = end + np.cumsum(counts) - counts, counts
                pool.append(part[part >= 0])
                end += len(pool[-1])
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            ids = self.first[np.frombuffer(pieces[i], np.uint8)]
            ids[-1] = self.last[pieces[i][-1]]
            pool.append(np.array(self._merged_long(ids.tolist()), np.int32))
            start[i], length[i] = end, len(pool[-1])
            end += length[i]
        return np.concatenate(pool), start, length

    def _rounds(self, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that have no pair left to merge, with their numbers, as they come to be so."""
        none, columns = len(self.made), np.arange(ids.shape[1])[None, :]
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), none)
            through = least == none
            if through.any():
                yield rows[through], ids[through]
                going = ~through
                ids, ranks, rows, at, least = ids[going], ranks[going], rows[going], at[going], least[going]
            if not len(rows):
                return
            every = np.arange(len(rows))
            # the pair's second place goes, and the pair's rank
            move = np.minimum(columns + (columns > at[:, None]), ids.shape[1] - 1)
            full = ids[:, -1].copy()
            ids = np.take_along_axis(ids, move, axis=1)
            ids[:, -1] = np.where(at == ids.shape[1] - 1, full, -1)
            ids[every, at] = self.made[least]
            move = np.minimum(columns[:, :-1] + (columns[:, :-1] >= at[:, None]), ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, move, axis=1)
            ranks[:, -1] = none
            # pairs with the new id
            ranks[every, at] = self.ranks(ids[every, at], ids[every, np.minimum(at + 1, ids.shape[1] - 1)])
            ranks[every[at == ids.shape[1] - 1], -1] = none
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks(ids[before, at[before] - 1], ids[before, at[before]])

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same for one piece, in time that grows little faster than it: pairs wait in a heap by rank and place; what has changed is passed over."""
        n, gone, none = len(ids), -1, len(self.made)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = lambda at: int(self.ranks(np.array([ids[at]]), np.array([ids[after[at]]]))[0])
        known = np.array(ids)
        heap = [(r, at) for at, r in enumerate(self.ranks(known[:-1], known[1:]).tolist()) if r < none]
        heapq.heapify(heap)
        while heap:
            least, at = heapq.heappop(heap)
            if ids[at] == gone or after[at] >= n or rank(at) != least:
                continue
            right = after[at]
            ids[at], ids[right], after[at] = int(self.made[least]), gone, after[right]
            if after[at] < n:
                before[after[at]] = at
            for x in (before[at], at):
                if x >= 0 and after[x] < n and (r := rank(x)) < none:
                    heapq.heappush(heap, (r, x))
        return [i for i in ids if i != gone]

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each word's begin and how many they are. A word is a text without white space, or a piece."""
        pieces: list[bytes] = []
        more: list[tuple[int, list[tuple[int, bool]]]] = []  # words of several pieces or special tokens
        at = np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            at[i] = len(pieces)
            if PIECE.fullmatch(word):
                pieces.append(word.encode())
                continue
            parts: list[tuple[int, bool]] = []
            for part in self.specials.split(word) if self.specials else [word]:
                if part in self.special:
                    parts.append((self.special[part], True))
                elif part:
                    for piece, _ in self.split(self.normalized(part)):
                        parts.append((len(pieces), False))
                        pieces.append(bytes(map(self.bytes.__getitem__, piece)))
            more.append((i, parts))
        if not pieces:
            pieces.append(b"!")  # so that there is one to point at
        pool, start, length = self.merged(pieces)
        at = np.minimum(at, len(pieces) - 1)
        starts, lengths, extra, end = start[at], length[at], [pool], len(pool)
        for i, parts in more:
            found = [np.array([p], np.int32) if special else pool[start[p] : start[p] + length[p]] for p, special in parts]
            extra.append(np.concatenate(found) if found else np.zeros(0, np.int32))
            starts[i], lengths[i] = end, len(extra[-1])
            end += len(extra[-1])
        return np.concatenate(extra), starts, lengths


_models: dict[str, Bpe] = {}
_lexicons: dict[str, Transducer] = {}


def model(path: str) -> Bpe:
    """One for each worker, kept from task to task."""
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def portions(text: str, most: int = PORTION) -> Iterator[str]:
    """The text in pieces of so many characters or fewer, cut at white space; longer ones where there is none."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in " \t\n\r\x0b\x0c")
        if cut <= at:
            found = BLANK.search(text, at + 1)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _words(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of some of the texts' portions, and how many of them each text has; of at most PORTION characters together, or of one portion."""
    words, counts, held = [], np.zeros(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        for portion in portions(text or ""):
            if held and held + len(portion) > PORTION:
                yield words, counts
                words, counts, held = [], np.zeros(len(texts), np.int64), 0
            parts = Encoder.parts(portion)
            words += parts
            counts[i] += len(parts)
            held += len(portion)
    yield words, counts


class Coder:
    """Encodes texts with a transducer for the frequent words, and merges the others."""

    def __init__(self, path: str, transducer: Transducer) -> None:
        self.bpe, self.transducer, self.merged = model(path), transducer, 0

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, one after the other, and how many each has."""
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        place = self.transducer.find([w.encode() for w in number])
        starts, pool = self.transducer.starts, self.transducer.ids
        known = place >= 0
        start = np.where(known, starts[np.maximum(place, 0)], 0).astype(np.int64)
        length = np.where(known, starts[np.maximum(place, 0) + known] - start, 0)
        if not known.all():
            unseen = [w for w, k in zip(number, known.tolist(), strict=True) if not k]
            ids, start[~known], length[~known] = self.bpe.ids(unseen)
            start[~known] += len(pool)
            pool = np.concatenate([pool, ids])
            self.merged += len(unseen)
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        lengths = length[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(start[at] - (ends - lengths), lengths) + np.arange(total)], lengths

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        ids, sizes = [], np.zeros(len(texts), np.int64)
        for words, counts in _words(texts):
            some, lengths = self.words(words)
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
            sizes += np.diff(ends, prepend=0)
            ids.append(some)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def decoded(ids: pa.ListArray, tokens: pa.StringArray) -> pa.Array:
    """The tokens of each list, with a blank between them."""
    flat = ids.flatten()
    if len(flat) and (pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(tokens)):
        raise KeyError("an id that the vocabulary does not have")
    texts = tokens.take(flat)
    if texts.null_count:
        raise KeyError("an id that the vocabulary does not have")
    sizes = pc.fill_null(pc.list_value_length(ids), 0)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), " ")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts, of words of LONGEST bytes at most; the longer ones are never in a lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("bpe")
        counts: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()

        for batch in batches:
            for words, _ in _words(batch.column(0).to_pylist()):
                counts.update(w for w in words if len(w) <= LONGEST // 4 or len(w.encode()) <= LONGEST)
                if len(counts) > COUNTED:
                    yield from rows()
        yield from rows()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = LEXICON) -> DataFrame:
    """The words of the largest counts, ``most`` at most: all of those counts that fit. Counts are compared by steps, of which there are few."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()  # 64 * STEPS rows at most
    least, held = math.inf, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if held + r["n"] > most:
            break
        held += r["n"]
        least = r["step"]
    return counts.where(step >= least) if held else counts.limit(0)


def build(docs: DataFrame, tokenizer_path: str, most: int = LEXICON) -> str:
    """Compiles the frequent words of the texts; the name of the file, which every executor gets."""
    spark = docs.sparkSession
    ship_code(spark)
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path)
        for batch in batches:
            ids, start, length = bpe.ids(batch.column(0).to_pylist())
            lists = pa.array([ids[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["word", "ids"])

    path = new_folder(spark, "words")
    word_counts(docs).write.parquet(path)
    chosen = frequent(spark.read.schema("word string, n bigint").parquet(path), most)
    found = chosen.select("word").mapInArrow(run, "word string, ids array<int>").toArrow()  # a bounded number of words
    remove_folder(spark, path)
    name = f"lexicon-{uuid.uuid4().hex}"
    local = os.path.join(tempfile.mkdtemp(prefix="millrace-lexicon-"), name)
    with open(local, "wb") as f:
        f.write(compiled({w.encode(): ids for w, ids in zip(found["word"].to_pylist(), found["ids"].to_pylist(), strict=True)}))
    spark.sparkContext.addFile(local)
    return name


def _transducer(name: str) -> Transducer:
    if name not in _lexicons:
        _lexicons.clear()
        _lexicons[name] = Transducer(SparkFiles.get(name))
    return _lexicons[name]


def encode(docs: DataFrame, tokenizer_path: str, lexicon: str, decode_too: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) for each document (doc_id, text), and decoded, the text of the ids, if wanted; lexicon as build names it."""
    ship_code(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("bpe")
        coder = Coder(tokenizer_path, _transducer(lexicon))
        tokens = pa.array(coder.bpe.tokens(), pa.string())
        for batch in batches:
            for part in _slices(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))):
                ids = coder.encode(part.column(1).to_pylist())
                columns = {"doc_id": part.column(0), "ids": ids} | ({"decoded": decoded(ids, tokens)} if decode_too else {})
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>" + (", decoded string" if decode_too else ""))


def decode(rows: DataFrame, tokenizer_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of the ids in a column, or replaces a column of that name."""
    ship_code(rows.sparkSession)
    bound_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != name]
    at = others.index(ids) if ids in others else -1
    if at < 0:
        raise ValueError(f"no column {ids}, or it is the one to be written")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(model(tokenizer_path).tokens(), pa.string())
        for batch in batches:
            for part in _slices(batch, np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0))):
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column(at).cast(pa.list_(pa.int32())), tokens)], names=[*others, name])

    kept = rows.select(*others)
    return kept.mapInArrow(run, kept.withColumn(name, F.lit("")).schema)


def _slices(batch: pa.RecordBatch, weights: np.ndarray, most: int = 4 * PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in parts of rows that weigh so much together at most, or of one row."""
    at, held = 0, 0
    for i, w in enumerate(weights.tolist()):
        if i > at and held + w > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += w
    if len(batch) > at:
        yield batch.slice(at)

