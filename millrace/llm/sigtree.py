"""Jaccard self-join of word shingles by signature trees.

1. Texts with equal shingle sets become one class, whose smallest doc_id stands for it.
2. Sets that can be similar are brought together. Hash space is cut into m segments, one more than two linked sets can have
   different shingles, plus some for segments that are empty: so at least one segment has the same shingles in both. m
   depends on the larger set's size class; a set is keyed for its own class and the next. Up to ALL segments all are used,
   which is exact by the pigeonhole principle: sets of up to some 600 shingles (500 at similarity 0.8). With more segments
   the first USED are: each differs with a probability under 0.63, so that a linked pair is missed with one under 1e-19, which is what
   two unequal shingles have of one 64-bit hash. If a set has more empty segments than are allowed for, then so has a set that it is
   linked with by empty segments only: both are keyed by the smallest hashes too, of which linked sets share one. Each task
   emits a set once, however many copies it has.
3. Over the sets of each key's star (all that share a key with one set) a signature tree is descended by bitmaps alone: sets
   whose bitmaps let them be similar stay together, in connected components, the candidate groups. A star of more than CHUNK
   sets stays together whole. A group is cut into chunks of at most CHUNK sets. In
   a task, a signature tree stands over a chunk: nodes hold the OR of their sets' token bitmaps and the range of their
   sizes. Two trees, or one with itself, are descended together, and a pair of nodes is pruned if the overlap that they can
   have at most is less than the least that a link needs, or if all their sets are linked already. Pairs of sets that remain
   are compared exactly.
4. A group of one chunk is done then. In larger groups the first chunk of each group meets all others; after that only sets outside the
   group's largest component have to meet the rest, and they do so in blocks. So no link between components is lost, and a
   large group of copies costs in proportion to its size.

Edge cases: a null or empty text has an empty set and links with nothing; a text of fewer than k words is one shingle; equal
texts link; a null doc_id is never what a component is named after, and such rows link through their equals only; rows with
one doc_id are one document, which its texts link together, and one_of_each keeps the row with the smallest hash; very long texts are taken whole; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import written
from .components import Union, components
from .memo import own
from .shingles import mixed, shingle_set

ALL, USED = 112, 96
CHUNK, CHUNK_SHINGLES = 1024, 2_000_000
LEAF, FANOUT, BITS, MOST_BITS = 8, 4, 1024, 16_384
#: Sets that a task remembers having keyed.
SEEN = 200_000
#: Up to so many sets are named to the scan of the texts by broadcast, more by shuffle.
BROADCAST_SETS = 500_000


# ---- candidate keys


class Keys:
    """Keys such that two sets whose similarity is at least t share one."""

    def __init__(self, t: Fraction) -> None:
        self.t, bounds = t, [1]
        while bounds[-1] < 1 << 40:
            bounds.append(int(bounds[-1] / t) + 1)
        self.bounds, self.table = np.array(bounds, np.int64), {}

    def segments(self, scheme: int) -> tuple[int, int]:
        """The segments of a size class, and how many of them may be empty."""
        top = int(self.bounds[scheme + 1]) - 1
        most = int(2 * top * (1 - self.t) / (1 + self.t))
        if not most:
            return 0, 0
        slack = 1 + (most + 1) // 8
        return most + 1 + slack, slack

    def scheme(self, scheme: int) -> tuple[int, int, int, np.ndarray, np.uint64]:
        """Segments, those that may be empty, those that are used, where they end, and a salt."""
        if scheme not in self.table:
            m, slack = self.segments(scheme)
            used = m if m <= ALL else USED
            borders = [min(-(-(i << 64) // m), (1 << 64) - 1) for i in range(1, used + 1)]
            self.table[scheme] = m, slack, used, np.array(borders, np.uint64), np.uint64((scheme * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
        return self.table[scheme]

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n, out = len(tokens), []
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        both = n * self.t.denominator // self.t.numerator >= self.bounds[own + 1]
        for scheme in (own, own + 1) if both else (own,):
            m, slack, used, borders, salt = self.scheme(scheme)
            if not m:
                continue
            ends = np.searchsorted(tokens, borders)
            if used == m:
                ends[-1] = n
            starts = np.concatenate([[0], ends[:-1]])
            full = np.flatnonzero(ends > starts)
            if len(full):
                sums = np.add.reduceat(mixed(tokens[: ends[-1]] ^ salt), starts[full])
                out.append(mixed(sums + full.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            if used == m and m - len(full) > slack:
                least = -(-n * self.t.numerator // self.t.denominator)
                out.append(mixed(tokens[: n - least + 1] + salt))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def set_ids(tokens: np.ndarray) -> tuple[int, int]:
    data = tokens.tobytes()
    return (x - (1 << 64) if x >= 1 << 63 else x for x in (xxhash.xxh64_intdigest(data, 1), xxhash.xxh64_intdigest(data, 2)))


def _described(k: int, t: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, size, hash and signature of the set, and its keys if the task has not met the set before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("shingles")
        keys, seen = Keys(t), set()
        nothing = np.zeros(0, np.uint64)
        for batch in batches:
            rows, found, marks = [], [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), k)
                s1, s2 = set_ids(tokens)
                rows.append((len(tokens), s1, s2))
                marks.append(signature(tokens))
                new = len(tokens) and s1 not in seen
                if new and len(seen) < SEEN:
                    seen.add(s1)
                found.append(keys(tokens) if new else nothing)
            if rows:
                n, s1, s2 = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), n, s1, s2, lists, pa.array(marks, pa.binary())], names=["doc_id", "n", "s1", "s2", "keys", "mark"])

    return run


# ---- signature trees


def bitmap(tokens: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bits at the tokens' hashes. bits: a power of two."""
    out = np.zeros(bits, bool)
    out[(tokens >> np.uint64(40)).astype(np.int64) % bits] = True
    return np.packbits(out).view(np.uint64)


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of about two bits a token, from BITS to MOST_BITS."""
    bits = BITS
    while bits < MOST_BITS and bits < 2 * len(tokens):
        bits *= 2
    return bitmap(tokens, bits).tobytes()


def folded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of one width: longer ones are folded, which ORs what meets."""
    width = min(map(len, signatures))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), 0) for x in signatures])


class Tree:
    """Sets in order of size, in leaves of LEAF, under nodes of FANOUT. Level 0 holds the sets themselves.

    sizes and ors: the sets' sizes and bitmaps. Without sets, what bitmaps allow counts as a link.
    """

    def __init__(self, ids: list[int], labels: list[int], sizes: list[int], ors: np.ndarray, sets: list[np.ndarray] | None = None) -> None:
        order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
        self.ids, self.sets = [ids[i] for i in order], sets and [sets[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.int64)
        ors, sizes = ors[order], np.array([sizes[i] for i in order], np.int64)
        # what a set has more than bits: tokens that share one
        excess = sizes - np.bitwise_count(ors).sum(1, dtype=np.int64)
        self.levels = [(ors, sizes, sizes, excess, self.labels, self.labels)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            ors, low, high, excess, first, last = self.levels[-1]
            cuts = np.arange(0, len(ors), width)
            self.levels.append((np.bitwise_or.reduceat(ors, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(excess, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)))
            width = FANOUT

    @classmethod
    def of_sets(cls, ids: list[int], labels: list[int], sets: list[np.ndarray]) -> Tree:
        return cls(ids, labels, [len(s) for s in sets], np.stack([bitmap(s) for s in sets]), sets)

    def children(self, level: int) -> tuple[int, int]:
        """Children for each node of a level, and how many nodes the level below has."""
        return LEAF if level == 1 else FANOUT, len(self.levels[level - 1][0])


def may_link(a: Tree, b: Tree, level_a: int, level_b: int, x: np.ndarray, y: np.ndarray, t: Fraction) -> np.ndarray:
    """Which pairs of nodes can hold a link between different labels."""
    ors_a, low_a, high_a, over_a, first_a, last_a = (v[x] for v in a.levels[level_a])
    ors_b, low_b, high_b, over_b, first_b, last_b = (v[y] for v in b.levels[level_b])
    most = np.bitwise_count(ors_a & ors_b).sum(1, dtype=np.int64) + np.minimum(over_a, over_b)
    most = np.minimum(most, np.minimum(high_a, high_b))
    p, q = t.numerator, t.denominator
    enough = (p + q) * most >= p * (low_a + low_b)
    sizes = (q * high_a >= p * low_b) & (q * high_b >= p * low_a)
    joined = (first_a == last_b) & (last_a == first_b) & (first_a == last_a)
    return enough & sizes & ~joined


def linked(a: Tree, b: Tree, t: Fraction) -> Iterator[tuple[int, int]]:
    """Links between sets of two trees (or of one with itself) that connect all labels that links connect."""
    same, p, q, union = a is b, t.numerator, t.denominator, Union()

    def descend(la: int, lb: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        for at in range(0, len(x), 1 << 14):
            xs, ys = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
            keep = may_link(a, b, la, lb, xs, ys, t)
            xs, ys = xs[keep], ys[keep]
            if not len(xs):
                continue
            if la == lb == 0:
                for i, j in zip(xs.tolist(), ys.tolist(), strict=True):
                    u, v = union.find(int(a.labels[i])), union.find(int(b.labels[j]))
                    if u == v:
                        continue
                    if a.sets is None:
                        union.join(u, v)
                        yield a.ids[i], b.ids[j]
                        continue
                    m, n = a.sets[i], b.sets[j]
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    if (p + q) * both >= p * (len(m) + len(n)):
                        union.join(u, v)
                        yield a.ids[i], b.ids[j]
                continue
            down_a, down_b = la >= lb, lb >= la
            if down_a:
                width, n = a.children(la)
                step = np.arange(width)
                xs, ys = (xs[:, None] * width + step).ravel(), np.repeat(ys, width)
                keep = xs < n
                xs, ys = xs[keep], ys[keep]
            if down_b:
                width, n = b.children(lb)
                step = np.arange(width)
                xs, ys = np.repeat(xs, width), (ys[:, None] * width + step).ravel()
                keep = ys < n
                xs, ys = xs[keep], ys[keep]
            if same:
                keep = xs < ys if la - down_a == 0 else xs <= ys
                xs, ys = xs[keep], ys[keep]
            yield from descend(la - down_a, lb - down_b, xs, ys)

    yield from descend(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


# ---- rounds


def _allowed(t: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows hub, node, n, mark come sorted by hub. Pairs that connect the sets of a hub that their bitmaps let be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and held[0][0] != row[0]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        found: list[tuple[int, int]] = []
        for rows in groups():
            rows = list({r[1]: r for r in rows}.values())
            ids = [r[1] for r in rows]
            tree = Tree(ids, ids, [r[2] for r in rows], folded([r[3] for r in rows]))
            found += linked(tree, tree, t)
            if len(found) > 4096:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                found = []
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own("shingles")
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(x.as_py(), k).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "tokens"])

    return run


def _joined(t: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows task, side, rep, label, tokens come sorted by task. Side 0 meets itself if there is no side 1, else side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tasks() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                task, side, rep, label = (batch.column(i).to_pylist() for i in range(4))
                for i, key in enumerate(task):
                    if held and held[0][0] != key:
                        yield held
                        held = []
                    held.append((key, side[i], rep[i], label[i], batch.column(4)[i].as_buffer().to_pybytes()))
            if held:
                yield held

        for rows in tasks():
            # rows with one doc_id and several texts are sets of one name
            sides = [[r for r in {(r[2], r[4]): r for r in rows if r[1] == s}.values() if r[4]] for s in (0, 1)]
            trees = [Tree.of_sets([r[2] for r in s], [r[3] for r in s], [np.frombuffer(r[4], np.uint64) for r in s]) if s else None for s in sides]
            if trees[0] is None:
                continue
            found = list(linked(trees[0], trees[1] if any(r[1] for r in rows) and trees[1] else trees[0], t)) if trees[1] or not any(r[1] for r in rows) else []
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _round(docs: DataFrame, plan: DataFrame, k: int, t: Fraction) -> DataFrame:
    """plan: task, side, rep, label. The links that the tasks find."""
    wanted = written(plan.select("rep").distinct(), "wanted")
    if wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    sets = docs.join(wanted, docs.doc_id == wanted.rep, "left_semi").select("doc_id", "text").mapInArrow(_sets(k), "rep bigint, tokens binary")
    rows = plan.join(sets, "rep").select("task", "side", "rep", "label", "tokens").repartition("task").sortWithinPartitions("task", "side", "rep")
    return written(rows.mapInArrow(_joined(t), "u bigint, v bigint"), "links")


def link_classes(docs: DataFrame, described: DataFrame, classes: DataFrame, k: int, t: Fraction) -> DataFrame:
    """node, component for the classes that have links. docs: doc_id, text; described: n, s1, keys, mark; classes: rep, n, s1."""
    keys = described.select(F.explode("keys").alias("key"), F.col("s1").alias("node"))
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    stars = written(keys.join(shared, "key").where("hub <> node").select("hub", "node").distinct(), "stars")
    # all sets of a key are in its hub's star: a tree of bitmaps over each star leaves what may link
    sizes = stars.groupBy("hub").agg(F.count("*").alias("c"))
    small, large = sizes.where(F.col("c") < CHUNK).select("hub"), sizes.where(F.col("c") >= CHUNK).select("hub")
    marks = described.where("n > 0").groupBy(F.col("s1").alias("node")).agg(F.first("n").alias("n"), F.first("mark").alias("mark"))
    inner = stars.join(small, "hub")
    inner = inner.unionByName(inner.select("hub", F.col("hub").alias("node")).distinct()).join(marks, "node").select("hub", "node", "n", "mark")
    inner = inner.repartition("hub").sortWithinPartitions("hub").mapInArrow(_allowed(t), "u bigint, v bigint")
    # written, so that no task has a Python worker for the trees and one for the components at once
    allowed = written(inner.unionByName(stars.join(large, "hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))), "allowed")
    groups = components(allowed)
    members = classes.join(groups, classes.s1 == groups.node).select("rep", "n", F.col("component").alias("grp"))
    bins = members.withColumn("bin", F.floor(F.log(F.col("n")) / F.log(F.lit(1.1))).cast("int"))
    bins = written(bins, "members")
    totals = bins.groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).withColumn("big", (F.col("c") > CHUNK) | (F.col("s") > CHUNK_SHINGLES))
    one = bins.join(totals.where(~F.col("big")), "grp").select(F.xxhash64("grp").alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("label"))
    large = totals.where("big").select("grp")
    large = written(large, "large")
    if large.isEmpty():
        return components(_round(docs, one, k, t))
    # chunks of a large group: sets of about one size, dealt by hash
    parts = bins.join(large, "grp")
    dealt = parts.groupBy("grp", "bin").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("parts"))
    parts = parts.join(dealt, ["grp", "bin"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    parts = written(parts.select("grp", "bin", "chunk", "parts", "rep", "n"), "chunks")
    task = lambda *c: F.xxhash64(*c)
    own = parts.select(task("grp", "bin", "chunk").alias("task"), F.lit(0).alias("side"), "rep", F.col("rep").alias("label"))
    links = _round(docs, one.unionByName(own), k, t)
    labelled = _labels(parts, components(links))
    # the first chunk of every size meets the other chunks of its own and of all larger sizes that can link
    reach = int(np.ceil(np.log(float(1 / t)) / np.log(1.1))) + 1
    first = labelled.where("chunk = 0")
    others = labelled.select("grp", F.col("bin").alias("b2"), F.col("chunk").alias("c2")).distinct()
    meets = dealt.select("grp", "bin").join(others, "grp").where(f"b2 between bin and bin + {reach} and not (b2 = bin and c2 = 0)")
    links = links.unionByName(_round(docs, _meeting(first, labelled, meets.withColumn("chunk", F.lit(0))), k, t))
    labelled = _labels(parts, components(links))
    # what is outside the group's largest component meets all the group
    sizes = labelled.groupBy("grp", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    outside = labelled.join(main, "grp").where("label <> main").drop("main")
    counts = outside.groupBy("grp", "bin").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("blocks"))
    outside = written(outside.join(counts, ["grp", "bin"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks"), "outside")
    if not outside.isEmpty():
        blocks = outside.select("grp", "bin", "chunk").distinct()
        meets = blocks.join(others, "grp").where(f"abs(b2 - bin) <= {reach}")
        links = links.unionByName(_round(docs, _meeting(outside, labelled, meets), k, t))
    return components(links)


def _labels(parts: DataFrame, found: DataFrame) -> DataFrame:
    """parts with label: the component of each class so far."""
    out = parts.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    return written(out, "labels")


def _meeting(left: DataFrame, right: DataFrame, meets: DataFrame) -> DataFrame:
    """A task for each pair of chunks in meets (grp, bin, chunk, b2, c2); both have grp, bin, chunk, rep, label."""
    meets = meets.withColumn("task", F.xxhash64("grp", "bin", "chunk", "b2", "c2", F.lit("pair")))
    a = left.join(meets, ["grp", "bin", "chunk"]).select("task", F.lit(0).alias("side"), "rep", "label")
    b = right.withColumnRenamed("bin", "b2").withColumnRenamed("chunk", "c2").join(meets.drop("bin", "chunk"), ["grp", "b2", "c2"])
    return a.unionByName(b.select("task", F.lit(1).alias("side"), "rep", "label"))


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark, t = docs.sparkSession, Fraction(percent, 100)
    ship_code(spark)
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = written(docs.mapInArrow(_described(k, t), "doc_id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, mark binary"), "sets")
    slim = described.drop("keys", "mark")
    classes = slim.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    found = link_classes(docs, described, classes.where("rep is not null"), k, t)
    named = classes.join(found, classes.rep == found.node, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = slim.join(named, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each component: that of its smallest doc_id. Rows without doc_id stay, as nothing names them."""
    found = written(similar_components(docs, k, percent), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.isEmpty():
        best = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *[F.xxhash64(c) for c in docs.columns if c not in ("doc_id", "text")])
        one = kept.join(again, "doc_id", "left_semi").withColumn("__best", F.row_number().over(best)).where("__best = 1").drop("__best")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)
