"""From documents to packed training sequences, in five stages.

Every stage takes what the one before it kept and returns the columns of documents; the last returns the pieces of the packed
sequences. Between stages the rows are written as Parquet in the shared folder and read again, so that a lost executor costs
a stage at most.

Edge cases, for all stages: null or empty texts, null ids, languages and sources, repeated rows, ties and very long texts are rows like others,
with the results below; an empty table gives an empty one; extra columns go on as they are, whatever their names, up to the last
stage, but for ``__lang`` and ``__score``, for which the first one raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, packing, secrets, sigtree
from millrace.llm.common import table, written
from millrace.llm.queries import END_ID, MAX_EPOCHS, MIX, TOKENIZER, WEIGHTS, WINDOW


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have. Learns from docs' own labels, of rows with a doc_id; a null text and one without letters
    go. Repeated rows stay, each; with fewer than 8 held-out texts nothing goes for its language."""
    found = langid.identify(docs, docs.select("doc_id", "text", "lang"), keep=docs.columns, names=("__lang", "__score"), reject=True)
    return found.where(F.col("__lang") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more. Of rows with one doc_id one stays, also
    if their texts differ; rows without a doc_id all stay, as nothing names them; a text without words is like none other; of a group the
    smallest doc_id stays."""
    return sigtree.one_of_each(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, in the whole text; a null text stays null. n_chars follows the text where something was replaced."""
    return secrets.redact(docs, secrets.default_forest(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one like the others, the last; a document without words takes nothing and goes; rows
    with null or repeated doc_ids are rows like others."""
    return mixing.repeat(docs, WEIGHTS, MIX, MAX_EPOCHS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end token alone; a null doc_id stays null. Which pieces share a sequence depends
    on how the rows lie in partitions; every token is in one piece."""
    return packing.pack(docs, TOKENIZER, END_ID, WINDOW)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

#: The stages hash, learn and search in ways that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
