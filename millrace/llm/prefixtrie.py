"""A trie of conversations: what is saved if turns that conversations begin with in common are kept once.

``turn_rows`` numbers the turns of each conversation and keeps of a turn the digest of its role and text and the number of its words, so
texts are read once and never shuffled. ``digests`` gives the digest of every prefix in rounds: after round k a turn has that of the
last 2^k turns before and with it, made of two halves; equal prefixes have equal digests, and nothing walks along a conversation.
``nodes`` groups them, with each node's parent as an edge. ``rollup`` adds up what subtrees have by pointer jumping: after round k a
node has the sums of its descendants nearer than 2^k and an edge to its ancestor at that distance; it gives the sums to that
ancestor, and takes that one's edge as its next. So the number of rounds is the logarithm of the greatest depth, and a few long
conversations add rounds of their own rows only.

A conversation, a first turn or a node may have a third of all rows: turns are numbered by ranges, sums are formed in each task before
they are shuffled, and joins are plain ones, whose skewed partitions Spark splits. Every round is written to the shared folder. The
ids of the conversations that end in a node are hashed as one stream: they are joined to texts of 1024 ids at most by many tasks
first, but one node's texts pass one task, one after the other, since SHA-256 can't be split.

Edge cases: rows with a null conv_id are no conversation and are left out; null roles and texts are empty; turns with a null
number come first, turns with equal numbers in order of their digests (repeated turns are turns each); conversations without any
turn are members of the root alone; an empty table has no node, not even the root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..session import bound_batches, ship_code
from .common import word_count, written

#: Ids that are joined to one text before they are hashed.
CHUNK = 1024
#: A node's key is its smallest conversation and its depth: no other node of that depth has that conversation.
#: reach is the length of its longest member, own_saved what the node itself saves.
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "own_saved", "reach"]


def turn_key(role: Column, text: Column) -> Column:
    """A digest of role and text; the role's length keeps ("ab", "c") and ("a", "bc") apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), key, words for each turn (conv_id, turn, role, text)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), turn_key(F.col("role"), F.col("text")).alias("key"), word_count(F.col("text")).alias("words"))
    return numbered(rows, ["conv_id"], ["turn", "key"], "depth", first=1).drop("turn")


def digests(turns: DataFrame) -> DataFrame:
    """Adds prefix, the digest of the turns 1 to depth of a conversation, and length, its number of turns. Depths have no gaps. A round has
    those conversations alone that are longer than what the rounds before have covered."""
    lengths = turns.groupBy("conv_id").agg(F.max("depth").alias("length"))
    rows = written(turns.select("conv_id", "depth", "words", F.col("key").alias("prefix")).join(lengths, "conv_id"), "prefixes")
    longest, step, done = rows.agg(F.max("length")).first()[0] or 0, 1, []
    while step < longest:
        done.append(rows.where(F.col("length") <= step))
        rows = rows.where(F.col("length") > step)
        before = rows.where(F.col("depth") + step <= F.col("length")).select("conv_id", (F.col("depth") + step).alias("depth"), F.col("prefix").alias("__before"))
        joined = rows.where(F.col("depth") > step).join(before, ["conv_id", "depth"]).withColumn("prefix", F.unhex(F.sha2(F.concat("__before", "prefix"), 256))).select(*rows.columns)
        rows = written(rows.where(F.col("depth") <= step).unionByName(joined), "prefixes")
        step *= 2
    return reduce(DataFrame.unionByName, [*done, rows])


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of ids in order of (depth, node, chunk) to one digest for each node."""
    now, state, out = None, None, []
    for batch in batches:
        for node, depth, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (node, depth) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (node, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "depth", "ends_sha256"])
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "depth", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """members: conv_id, node, depth for the node that a conversation ends in. node, depth, ends_sha256 over its ids in order."""
    ship_code(members.sparkSession)
    bound_batches(members.sparkSession)
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    texts = members.groupBy("node", "depth", chunk).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = texts.select("node", "depth", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    dealt = texts.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk").select("node", "depth", "text")
    return dealt.mapInArrow(_id_texts, "node bigint, depth bigint, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (see NODE), written, and for each conversation (conv_id of convs) the node that it ends in."""
    rows = digests(turns)
    number = lambda n: F.lit(n).cast("bigint")
    # the root may have descendants at any distance
    root = convs.select("conv_id", number(0).alias("depth"), number(0).alias("words"), number(1 << 60).alias("length"), F.lit(b"").alias("prefix"))
    places = rows.select(*root.columns).unionByName(root)
    grouped = places.groupBy("depth", "prefix").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.max("length").alias("reach"))
    grouped = written(grouped, "nodes")
    at = written(places.select("conv_id", "depth", "prefix").join(grouped.select("depth", "prefix", "node"), ["depth", "prefix"]).drop("prefix"), "places")
    # a node's smallest conversation passes its parent too
    above = at.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    edges = grouped.where("depth > 0").join(above, ["node", "depth"]).unionByName(grouped.where("depth = 0").withColumn("parent", F.lit(None).cast("bigint")))
    # a row for each node, and what its children say of it
    own = edges.select("node", "depth", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"), "reach", number(0).alias("n_children"))
    none = F.lit(None).cast("bigint")
    children = edges.where("parent is not null").select(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"), none.alias("parent"), none.alias("n_convs"), none.alias("own_saved"), none.alias("reach"), number(1).alias("n_children"))
    kept = [F.max(c).alias(c) for c in ("parent", "n_convs", "own_saved", "reach")]
    out = own.unionByName(children).groupBy("node", "depth").agg(*kept, F.sum("n_children").alias("n_children"))
    last = at.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("depth"))
    names = {"node": "conv_id", "parent": "parent_conv_id"}
    return written(out.withColumnsRenamed(names).select(*NODE), "trie"), last


def rollup(trie: DataFrame) -> DataFrame:
    """trie: rows of NODE. conv_id, depth, n_leaves and saved_tokens of the whole subtree. A round has those nodes alone that have an
    ancestor or may have a descendant at its distance."""
    rows = trie.select("conv_id", "depth", "reach", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), F.col("own_saved").alias("saved_tokens"), F.col("parent_conv_id").alias("up"))
    deepest, step, done, none = rows.agg(F.max("depth")).first()[0] or 0, 1, [], F.lit(None).cast("bigint")
    while step <= deepest:
        live = F.greatest("depth", F.col("reach") - F.col("depth")) >= step
        done.append(rows.where(~live))
        rows = rows.where(live)
        has_up, nothing = rows.where(F.col("depth") >= step), F.lit(0).cast("bigint")
        given = has_up.select(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth"), none.alias("reach"), "n_leaves", "saved_tokens", none.alias("up"))
        # who has an ancestor at twice the distance takes it from the one that it points to
        next_up = has_up.select(F.col("conv_id").alias("up"), (F.col("depth") + step).alias("depth"), F.col("up").alias("next"))
        far = rows.where(F.col("depth") >= 2 * step).select("conv_id", "depth", "up").join(next_up, ["up", "depth"])
        edges = far.select("conv_id", "depth", none.alias("reach"), nothing.alias("n_leaves"), nothing.alias("saved_tokens"), F.col("next").alias("up"))
        every = rows.withColumn("up", none).unionByName(given).unionByName(edges)
        summed = every.groupBy("conv_id", "depth").agg(F.max("reach").alias("reach"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("up").alias("up"))
        rows = written(summed, "rollup")
        step *= 2
    return reduce(DataFrame.unionByName, [*done, rows]).select("conv_id", "depth", "n_leaves", "saved_tokens")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns: conv_id, depth (1, 2, ... in each conversation), key, words; convs: conv_id of every conversation, once. A row for each node:
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    trie, last = nodes(turns, convs)
    texts = ends(last).withColumnRenamed("node", "conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = trie.join(rollup(trie), ["conv_id", "depth"]).join(texts, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def shared_starts(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations that are rebuilt: conversation c gets the first h turns of conversation c - c % every, h = crc32(c) % most (all,
    if that has fewer), and then its own turns after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    pairs = convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("from"))
    heads = turns.where((F.col("depth") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "from")
    lent = pairs.join(heads, "from").where("depth <= h").select("conv_id", "depth", "key", "words")
    n = heads.groupBy("from").agg(F.max("depth").alias("n"))
    shift = pairs.join(n, "from", "left").select("conv_id", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got"))
    own = turns.join(shift, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("got")).alias("depth"), "key", "words")
    return lent.unionByName(own)
