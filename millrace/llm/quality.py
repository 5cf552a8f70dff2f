"""Quality rules from the lines that documents of one host share. DataFrame functions only.

A line is normalised (lower case, runs of white space to one space, ends trimmed) and hashed. For each host and line the
distinct documents (doc_ids) are counted, exact copies among them. Lines in more than ``max_docs`` documents of a host are removed. A document is depleted, and rejected, if fewer than
``min_words`` words or less than ``min_share`` of its words are left.

All is computed in the scan's tasks but for the line counts, which are summed in each task before they are shuffled by
(host, line, doc_id) and then by (host, line). The removed lines are broadcast if they are few (``BROADCAST_LINES``), else joined by shuffle.

Edge cases: a null or empty text has no words or lines and fails the base rules; a null host is a host of its own; repeated
rows each get a row, and rows of one doc_id count as one document; rows with a null doc_id count each; a document in one long line is one line; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, written

#: Above so many removed lines (24 bytes each) they are joined by shuffle instead of broadcast.
BROADCAST_LINES = 200_000
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    """The words of a text, as an array."""
    inner = F.btrim(text, F.lit(BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def windows(words: Column, k: int) -> Column:
    """Hashes of the windows of k words, by position; none if there are fewer words."""
    hashed = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(line, SPACE, " "))))


def features(docs: DataFrame) -> DataFrame:
    """docs has rid, doc_id, host, t. Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and lines."""
    c = F.col
    # A window's hash and its position share a long, so that one sort of longs brings equal windows together; what the
    # hash loses that way is checked on the whole hashes.
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size("grams")))) - 1
    twin = lambda x, y: ((x.bitwiseXOR(y)).bitwiseAND(c("upper")) == 0) & (F.get(c("grams"), x.bitwiseAND(c("mask")).cast("int")) == F.get(c("grams"), y.bitwiseAND(c("mask")).cast("int")))
    repeated = F.filter("packed", lambda x, i: twin(x, F.get(c("packed"), i - 1)) | twin(x, F.get(c("packed"), i + 1)))
    cover = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(c("at"), i + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        docs.withColumn("words", split_words(c("t")))
        .withColumn("grams", windows(c("words"), 3))
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.translate("t", BLANK, "")).cast("long"))
        .withColumn("n_symbols", (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long"))
        .drop("words")
        .withColumn("mask", mask).withColumn("upper", F.bitwise_not("mask"))
        .withColumn("packed", F.sort_array(F.transform("grams", lambda g, i: g.bitwiseAND(c("upper")).bitwiseOR(i.cast("long")))))
        .withColumn("at", F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(c("mask")))))
        .withColumn("n_repeat_words", cover)
        .drop("grams", "mask", "upper", "packed", "at")
        .withColumn("lines", _lines(c("t")))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    )


def frequent_lines(docs: DataFrame, max_docs: int) -> DataFrame:
    """host, line (hash) of the lines in more than max_docs documents of a host. docs has doc_id, host, t."""
    lines = docs.select("doc_id", "host", F.explode(F.array_distinct(F.transform(_lines(F.col("t")), _line_hash))).alias("line"))
    unnamed = F.count_if(F.col("doc_id").isNull())
    return (
        lines.groupBy("host", "line", "doc_id").agg(unnamed.alias("unnamed")).groupBy("host", "line")
        .agg((F.count("doc_id") + F.sum("unnamed")).alias("documents")).where(F.col("documents") > max_docs).select("host", "line")
    )


def judge(docs: DataFrame, max_docs: int = 20, min_words: int = 25, min_share: float = 0.5) -> DataFrame:
    """A row for each row of docs (doc_id, text, host): the counts, words_left, base_failed and kept."""
    docs = docs.select("doc_id", F.col("host").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    bad = written(frequent_lines(docs, max_docs), "lines")
    few = bad.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    bad = bad.select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line"))
    bad = F.broadcast(bad) if few else bad
    # The row's number is that of its place in the scan, which is the same whenever a task runs again.
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = features(docs.withColumn("rid", F.monotonically_increasing_id()))
    rows = rows.select("rid", "host", *own, F.transform("lines", lambda x: F.struct(_line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines"))
    rows = rows.select("rid", "host", *own, F.explode_outer("lines").alias("l")).select("rid", "host", *own, "l.line", "l.n")
    rows = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line")), "left")
    left = F.coalesce(F.sum(F.when(F.col("bad_line").isNull(), F.col("n"))), F.lit(0)).cast("long")
    out = rows.groupBy("rid", *own).agg(left.alias("words_left"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    full = (F.col("words_left") >= min_words) & (F.col("words_left") >= F.lit(min_share) * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & full).drop("rid")
