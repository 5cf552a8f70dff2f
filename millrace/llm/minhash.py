"""Fingerprints by one-permutation MinHash. DataFrame functions only.

Shingles of five words are hashed once. The top bits of a hash choose one of 256 bins, and each bin keeps its smallest hash:
after one sort these are the first hashes of each run of equal top bits. An empty bin copies the value of a filled one, by
optimal densification: it probes bins in an order of its own, the same for every document, until one is filled. The four
low-order bits of each bin are stored, 16 bins to a long. Two fingerprints' share of equal bins, m, gives the similarity
(m - 1/16) / (1 - 1/16), at least 0, as bins agree by chance once in 16. The standard error is near 0.03.

Edge cases: a null text is the empty text; a text without words has a mark of its own as its only shingle, so that such
texts are alike with likeness 1 and like nothing else; a text of fewer than five words is one shingle; equal texts have equal
fingerprints; very long texts are taken whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import split_words, windows

BINS, BIN_BITS, LOW_BITS, PER_LONG, WORDS = 256, 8, 4, 16, 5
#: Probes of an empty bin before all filled bins are ranked for it.
PROBES = 8


def shingle_hashes(words: Column) -> Column:
    empty = F.array(F.xxhash64(F.lit(""), F.lit(-1)))
    return F.when(F.size(words) >= WORDS, windows(words, WORDS)).when(F.size(words) == 0, empty).otherwise(F.array(F.xxhash64(words)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column name: an array of 16 longs with the low bits of the 256 bins."""
    c, top = F.col, lambda x: F.shiftright(x, 64 - BIN_BITS)
    half = BINS // 2
    gap = lambda x, i: top(x) - F.when(i == 0, F.lit(-half - 1).cast("long")).otherwise(top(F.get(c("__first"), i - 1))) - 1
    nothing = F.lit(None).cast("bigint")
    runs = F.flatten(F.transform("__first", lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i).cast("int")), F.array(x))))
    tail = F.array_repeat(nothing, (F.lit(half - 1) - top(F.element_at("__first", -1))).cast("int"))
    probe = lambda b, k: F.get(c("__slots"), F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int"))
    ranked = lambda b: F.array_min(F.transform("__first", lambda x: F.struct(F.xxhash64(b, top(x)).alias("r"), x.alias("v"))))["v"]
    dense = F.transform("__slots", lambda x, b: F.coalesce(x, *[probe(b, k) for k in range(PROBES)], ranked(b)))
    fold = lambda j: F.aggregate(F.slice(c("__dense"), j * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, LOW_BITS).bitwiseOR(x.bitwiseAND(F.lit(15).cast("bigint"))))
    # one by one, not in a lambda: the optimiser would move __dense into it and compute it for every long
    packed = F.array(*[fold(j) for j in range(BINS // PER_LONG)])
    return (
        df.withColumn("__words", split_words(c(text)))
        .withColumn("__sorted", F.sort_array(shingle_hashes(c("__words")))).drop("__words")
        .withColumn("__first", F.filter("__sorted", lambda x, i: (i == 0) | (top(x) != top(F.get(c("__sorted"), i - 1))))).drop("__sorted")
        .withColumn("__slots", F.concat(runs, tail))
        .withColumn("__dense", F.when(F.size("__first") == BINS, c("__first")).otherwise(dense)).drop("__slots", "__first")
        .withColumn(name, packed).drop("__dense")
    )


def as_text(bins: Column) -> Column:
    """A hexadecimal digit for each bin."""
    return F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints."""
    ones = F.lit(0x1111111111111111)

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), ((BINS - apart) / F.lit(float(BINS)) - chance) / (1 - chance))


#: Borders that are compared with a key at once, at each level of a search.
FAN = 32


def borders_up_to(key: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are at most key: a search tree over a literal array, of about FAN * log(borders) / log(FAN) comparisons."""
    whole = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    if len(borders) <= FAN:
        return F.size(F.filter(whole(borders), lambda x: x <= key)) if borders else F.lit(0)
    # levels of every FAN-th border, then what lies between two of them
    levels = [borders]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1][FAN - 1 :: FAN])
    at = F.size(F.filter(whole(levels[-1]), lambda x: x <= key))
    for level in reversed(levels[:-1]):
        at = at * FAN + F.size(F.filter(F.slice(whole(level), at * FAN + 1, F.lit(FAN)), lambda x: x <= key))
    return at


def with_next(df: DataFrame, key: str, carried: list[str], buckets: int) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the row with the next larger key; after the last comes the first.

    Rows are dealt into ranges of the key, whose borders are existing keys (approximate quantiles: as many numbers as there
    are ranges come to the driver). The first row of each range also visits the range before it, as a guest at its end.
    Null keys come first; rows with equal keys are ordered by a hash of the carried columns.
    """
    quantiles = [F.lit(i / buckets) for i in range(1, buckets)]
    found = df.agg(F.min(key).alias("low"), F.percentile_approx(key, F.array(*quantiles), F.lit(50 * buckets)).alias("q") if quantiles else F.lit(None).alias("q"), F.count_if(F.col(key).isNull()).alias("nulls")).first()
    borders = sorted({x for x in [found["low"], *(found["q"] or [])] if x is not None})
    # ranges: that of null keys, if there are any, and one from each border on
    ranges, nulls = max(1, len(borders) + bool(found["nulls"])), 1 if found["nulls"] else 0
    upto = F.when(F.col(key).isNull(), F.lit(0)).otherwise(borders_up_to(F.col(key), borders) - 1 + nulls)
    starts = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>") if borders else F.array().cast("array<bigint>")
    head = F.coalesce(F.col(key) == F.get(starts, F.col("__at") - nulls), F.col(key).isNull())
    homes = F.array(F.struct(F.col("__at").alias("at"), F.lit(0).alias("guest")))
    visits = F.array(F.struct(F.pmod(F.col("__at") - 1, F.lit(ranges)).alias("at"), F.lit(1).alias("guest")))
    dealt = df.withColumn("__at", upto.cast("int")).withColumn("__to", F.explode(F.when(head, F.concat(homes, visits)).otherwise(homes)))
    by = Window.partitionBy("__bucket").orderBy("__guest", F.col(key).asc_nulls_first(), "__tie")
    dealt = dealt.withColumn("__bucket", F.col("__to.at")).withColumn("__guest", F.col("__to.guest")).withColumn("__tie", F.xxhash64(*carried)).drop("__to", "__at")
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(by))
    return dealt.where("__guest = 0").drop("__bucket", "__guest", "__tie")


def compare_with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """docs: doc_id, text. Fingerprints each text, and the text whose last quarter the next document's start replaces."""
    c = F.col
    rows = with_fingerprint(docs.select(c("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")), "t", "f")
    rows = with_next(rows, "doc_id", ["t", "f"], buckets)
    n = F.length("t")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "f", c("next_f"), F.concat(F.substring(c("t"), F.lit(1), n - cut), F.substring(c("next_t"), F.lit(1), cut)).alias("e"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2("e", 256)), "e", "g")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(c("f")).alias("fingerprint"), as_text(c("g")).alias("edited_fingerprint"),
        likeness(c("f"), c("g")).alias("near_edited"), likeness(c("f"), c("next_f")).alias("near_next"),
    )
