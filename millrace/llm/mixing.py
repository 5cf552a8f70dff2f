"""Mixing sources to target weights by capped water-filling and seeded repetitions.

Every source gets a share of the mix by its weight. A source that would be repeated more than ``max_epochs`` times stops
there, and what it can't take is shared again by weight among the others, until none is above its cap. The fixed point is
found in closed form: sources are sorted by cap / weight, so that the capped ones are a prefix of that order.

A document is repeated floor(target / source_size) times whole. The fractional repetition goes to documents in the order of
a seeded hash until the source's target is used up; the document at the border takes the words that are left. So each
source takes its target, rounded to a word.

Prefix sums over documents run on two levels (hash buckets of a source, then the documents of a bucket), so that a source
with a third of all rows is spread over ``BUCKETS`` groups.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of its own and comes last; sources whose
documents are all empty have target 0; repeated rows count each; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_hash, word_count
from .quality import split_words

#: Groups into which the documents of each source are dealt by hash.
BUCKETS = 1 << 16
HASH_BITS = 60


def targets(sources: DataFrame, weights: list[float], mix: float, max_epochs: float) -> DataFrame:
    """sources: source, source_size, one row each. Adds target. One task sorts the sources: a row for each, no documents."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sources.withColumn("weight", weight).withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.lit(float(mix)) * F.sum("source_size").over(every))
        .withColumn("level", level)
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("level", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.coalesce(F.col("level") * F.col("weight") < F.col("cap"), F.lit(False)), F.col("level") * F.col("weight")).otherwise(F.col("cap")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, weights: list[float], mix: float = 1.5, max_epochs: float = 2.0, seed: int = 7, size: Column | None = None, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source). row: a struct of the row under this name."""
    carried = [] if row is None else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.xxhash64("text").alias("__tie")]
    slim = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"),
        (word_count(F.col("text")) if size is None else size).alias("size"), key_hash(F.col("doc_id"), seed=seed).alias("h"), *carried,
    ).withColumn("bucket", F.shiftright("h", HASH_BITS - 16).cast("int"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *(["__tie"] if carried else [])).rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    slim = slim.withColumn("before", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, mix, max_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    b, p = starts.alias("b"), plan.alias("p")
    starts = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b.bucket", "bucket_before", "source_size", "target")
    d, s = slim.alias("d"), starts.alias("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.round("target").cast("long") - F.col("whole") * F.col("source_size") - F.col("bucket_before") - F.col("before")
    return (
        d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
        .select("d.doc_id", "d.source", "size", "source_size", "target", "bucket_before", "before", whole.alias("whole"), *([row] if row else []))
        .withColumn("taken", F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), part)))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *([row] if row else []))
    )


def repeat(docs: DataFrame, weights: list[float], mix_share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """docs as the mix takes them, with docs' columns.

    A document of which k whole repetitions and some words more are taken gives k rows and one with those first words,
    whose n_chars follows. What takes nothing goes. Rows carry their own share of the plan, so null and repeated doc_ids are rows
    like others; among rows of one doc_id and size, the text's hash decides which one is cut.
    """
    c = F.col
    plan = mix(docs, weights, mix_share, max_epochs, seed, row="__row").where("taken > 0")
    whole, rest = F.floor(c("taken") / c("size")).cast("int"), (c("taken") % c("size")).cast("int")
    each = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = plan.select("__row", F.explode(each).alias("__words"))
    cut = F.concat_ws(" ", F.slice(split_words(c("__row.text")), F.lit(1), F.greatest(c("__words"), F.lit(1))))
    rows = rows.withColumn("__text", F.when(c("__words") > 0, cut).otherwise(c("__row.text")))
    new = {"text": c("__text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(c("__words") > 0, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(c("__row.n_chars"))
    return rows.select(*[new.get(x, c(f"__row.`{x}`")).alias(x) for x in docs.columns])
