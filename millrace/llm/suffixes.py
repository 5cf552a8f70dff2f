"""Passages that documents share, found with a sparse suffix array over words.

Suffixes are retained where a minimiser stands: the smallest hash of GRAM words in some window of WINDOW of them. Two equal
passages of MIN_WORDS words choose the same places, the first of them at most WINDOW - 1 words after the passage's start, so
their suffixes agree for HEAD = MIN_WORDS - WINDOW + 1 words at least. A suffix is ordered by the hash of its first HEAD words,
then by the words that follow, then by the words before it, backwards; with all three cut where a passage of MIN_WORDS
words is decided. Suffixes whose head stands in one document only are dropped before texts are read again.

Sorted suffixes are compared with their NEIGHBOURS next ones: from the common head, the match is extended right and left, and it
counts if it has MIN_WORDS words or more and stands in two documents. Longer passages are covered by their several places. As only suffixes
of one head are compared, the array is dealt by head and sorted in each part, with ties broken by document and place: nothing is sampled,
and no comparison crosses two parts.
``matches`` gives every match with its other document; ``shared_passages`` joins what the matches of a document cover.

Neighbours are all suffixes of a head that has NEIGHBOURS + 1 rows at most. Those of a more common head are not in the array: each
gives the hashes of all windows of MIN_WORDS words around its head, and the windows that stand in two documents are the matches.
Both ways are exact, but for equal hashes of unequal words.

Edge cases: null or empty texts, and those under MIN_WORDS words, have no passages; rows with a null doc_id are ignored; rows
with one doc_id are one document; passages that repeat only within a document don't count; very long texts are taken whole; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import written
from .memo import own
from .shingles import rolled, word_hashes

MIN_WORDS, GRAM, WINDOW = 50, 8, 24
HEAD = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1
NEIGHBOURS = 8
#: Bytes that stand for a word in the contexts.
CODE = 3


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions of the smallest GRAM-word hash of each window (the first, if equal), where a whole head follows."""
    grams = rolled(words, GRAM)
    if len(words) < MIN_WORDS or len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(1) + np.arange(len(grams) - WINDOW + 1)
    places = np.unique(least)
    return places[places <= len(words) - HEAD]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own("shingles")
    for batch in batches:
        for at in range(0, len(batch), 128):
            part = batch.slice(at, 128)
            ids, heads, places = [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = word_hashes(text.as_py() or "")
                found = minimisers(words)
                if len(found):
                    places.append(found)
                    heads.append(rolled(words, HEAD)[found])
                    ids.append(np.full(len(found), doc_id, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32))], names=["head", "doc_id", "place"])


def windows_around(places: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of MIN_WORDS words, among n, that hold a head at one of these places."""
    starts = np.unique(places[:, None] - np.arange(SIDE + 1))
    return starts[(starts >= 0) & (starts <= n - MIN_WORDS)]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the array, whose window is null, and of the windows around common heads, where place is the window's start."""
    own("shingles")
    names = ["head", "after", "before", "doc_id", "place", "window"]
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            rows, hashes, ids, starts = [], [], [], []
            for doc_id, text, chosen, common in zip(part.column(0).to_pylist(), part.column(1), part.column(2), part.column(3), strict=True):
                words = word_hashes(text.as_py() or "")
                if len(common.values):
                    around = windows_around(common.values.to_numpy(), len(words))
                    hashes.append(rolled(words, MIN_WORDS)[around])
                    starts.append(around)
                    ids.append(np.full(len(around), doc_id, np.int64))
                if not len(chosen.values):
                    continue
                heads = rolled(words, HEAD).view(np.int64)
                codes = np.ascontiguousarray(words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - CODE :])
                back = codes[::-1].tobytes()
                codes, n = codes.tobytes(), len(words)
                for p in chosen.values.to_pylist():
                    if p < len(heads):
                        end = (n - p) * CODE
                        rows.append((int(heads[p]), codes[(p + HEAD) * CODE : (p + HEAD + SIDE) * CODE], back[end : end + SIDE * CODE], doc_id, p))
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int64())], names=names)
            if ids:
                columns = [pa.array(np.concatenate(c).astype(k)) for c, k in ((ids, np.int64), (starts, np.int32), (hashes, np.uint64))]
                columns[2] = columns[2].view(pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), t) for t in types[:3]), *columns], names=names)


def common_prefix(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Words that rows of padded codes have in common at their start; na, nb: words that they have."""
    same = (a == b).reshape(len(a), SIDE, CODE).all(2)
    return np.minimum(np.where(same.all(1), SIDE, same.argmin(1)), np.minimum(na, nb))


def _padded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = values.to_pylist()
    wide = SIDE * CODE
    return np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in rows), np.uint8).reshape(-1, wide), np.array([len(x) // CODE for x in rows], np.int64)


MATCHES = "doc_id bigint, start int, stop int, other bigint"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("other", pa.int64())])


def _neighbours(each: bool):  # noqa: ANN202
    """Matches of sorted suffixes with the next ones. each: a row for each match; else one for each suffix, from where its matches
    start to where they stop: all of them hold its head."""

    def matches(t: pa.Table) -> pa.RecordBatch:
        head, doc, place = (t.column(c).to_numpy() for c in ("head", "doc_id", "place"))
        after, na = _padded(t.column("after").combine_chunks())
        before, nb = _padded(t.column("before").combine_chunks())
        out, start, stop = [], place.copy(), np.zeros_like(place)
        for d in range(1, NEIGHBOURS + 1):
            i = np.flatnonzero((head[:-d] == head[d:]) & (doc[:-d] != doc[d:])) if len(head) > d else np.zeros(0, np.int64)
            if not len(i):
                continue
            j = i + d
            right = common_prefix(after[i], after[j], na[i], na[j])
            left = common_prefix(before[i], before[j], nb[i], nb[j])
            ok = right + left + HEAD >= MIN_WORDS
            i, j, right, left = i[ok], j[ok], right[ok], left[ok]
            for x, y in ((i, j), (j, i)):
                if each:
                    out.append((doc[x], place[x] - left, place[x] + HEAD + right, doc[y]))
                else:
                    start[x], stop[x] = np.minimum(start[x], place[x] - left), np.maximum(stop[x], place[x] + HEAD + right)
        if not each:
            some = np.flatnonzero(stop)
            out.append((doc[some], start[some], stop[some], doc[some]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64, np.int32, np.int32, np.int64), strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([tail, t]) if tail is not None else t
            found = matches(t)
            if found.num_rows:
                yield found
            tail = t.slice(max(0, t.num_rows - NEIGHBOURS))

    return run


def _found(docs: DataFrame, partitions: int, each: bool) -> tuple[DataFrame, DataFrame]:
    """What the array's neighbours have in common (doc_id, start, stop, other), and the windows around common heads (window, doc_id, start)."""
    ship_code(docs.sparkSession)
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    # written, as it is read twice: the texts are hashed once
    heads = written(docs.mapInArrow(_heads, "head bigint, doc_id bigint, place int"), "heads")
    shared = heads.groupBy("head").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    # written, so that both sides of the join are plain shuffles, in which Spark splits the rows of a very common head
    shared = written(shared.select("head", (F.col("n") > NEIGHBOURS + 1).alias("common")), "shared")
    of = lambda common: F.collect_set(F.when(F.col("common") == common, F.col("place")))
    chosen = heads.join(shared, "head").groupBy("doc_id").agg(of(False).alias("places"), of(True).alias("common"))
    keys = ["head", "after", "before", "doc_id", "place"]
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "places", "common")
    # written, as it is read once for the array and twice for the windows
    rows = written(rows.mapInArrow(_contexts, "head bigint, after binary, before binary, doc_id bigint, place int, window bigint"), "contexts")
    array = rows.where("window is null").select(*keys).repartition(partitions, "head").sortWithinPartitions(*keys)
    return array.mapInArrow(_neighbours(each), MATCHES), rows.where("window is not null").select("window", "doc_id", F.col("place").alias("start"))


def _twice(windows: DataFrame) -> DataFrame:
    """The windows that stand in two documents, with the smallest and the largest."""
    return written(windows.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b"), "windows")


def matches(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, start, stop (words), other: passages of docs (doc_id, text), each of which stands in the document other from end to end.

    Of a suffix and its neighbours every pair is given; of a window around a common head one other document. partitions: of the array.
    """
    found, windows = _found(docs, partitions, True)
    other = F.when(F.col("a") == F.col("doc_id"), F.col("b")).otherwise(F.col("a")).alias("other")
    return found.unionByName(windows.join(_twice(windows), "window").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop"), other)).distinct()


def shared_passages(docs: DataFrame, partitions: int) -> DataFrame:
    """doc_id, start, stop: the longest runs of words of docs (doc_id, text) that passages cover which stand in another document too."""
    found, windows = _found(docs, partitions, False)
    found = found.drop("other").unionByName(windows.join(_twice(windows), "window").select("doc_id", "start", (F.col("start") + MIN_WORDS).alias("stop")))
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    found = found.withColumn("new", F.coalesce((F.col("start") > F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    found = found.withColumn("passage", F.sum("new").over(by))
    return found.groupBy("doc_id", "passage").agg(F.min("start").cast("bigint").alias("start"), F.max("stop").cast("bigint").alias("stop")).drop("passage")
