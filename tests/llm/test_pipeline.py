"""The pipeline's stages, one by one over small and odd rows, and from end to end."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from millrace.llm.common import written
from tests.llm import brute
from tests.llm.test_operators import ODD, SCHEMA, check_packing

SF = "/root/testdata/sf0.001"


def test_registered():
    assert entry.queries()["pipeline"] is pipeline.run and "pipeline" not in entry.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op") and q[2].isdigit()}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_rows_and_none(spark, name):
    stage = dict(pipeline.STAGES)[name]
    labelled = [(1000 + i, "the end of the house and the dog is here and there again " * 3, "en", "a", 9) for i in range(3)]
    odd = spark.createDataFrame(ODD + labelled, SCHEMA)
    for c in ("t", "size", "score", "lang_pred", "component_id", "taken", "findings"):
        odd = odd.withColumn(c, F.lit("clash"))
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, SF)
        assert out.columns == (docs.columns if name != "pack_windows" else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "by_rule"])
        assert (out.count() > 0) == (docs is odd)


FOREIGN = [
    "В начале было слово и это слово было очень важным для всех людей которые жили тогда на этой земле и думали о том что будет потом ",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava ",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "Ολοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα ",
]


def test_unlearned_languages_go_and_short_and_mixed_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(4)
    junk = lambda chars: " ".join("".join(draw.choice(chars) for _ in range(draw.randint(2, 9))) for _ in range(200))
    gone = [t * 4 for t in FOREIGN] + [junk("abcdefghijklmnopqrstuvwxyz"), junk("bcdfghjklmnpqrstvwxz")]
    some = {lang: docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1000)).orderBy("doc_id").first()["text"] for lang in ("en", "de", "fr", "es")}
    stay = [t[:n] for t in some.values() for n in (60, 300)] + [some["en"][:900] + "\n" + some["fr"][:900], some["de"][:900] + "\n" + some["es"][:900]]
    planted = spark.createDataFrame([(10**6 + i, t, None, "a", len(t)) for i, t in enumerate(gone + stay)], SCHEMA)
    out = [r["doc_id"] for r in pipeline.language_id(spark, docs.select(*planted.columns).unionByName(planted), SF).select("doc_id").collect()]
    assert sorted(d - 10**6 for d in out if d >= 10**6) == list(range(len(gone), len(gone + stay)))
    assert sum(d < 10**6 for d in out) >= 0.98 * docs.count()


def test_near_duplicates_keep_one_of_each(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == sorted(d for d, (_, c) in brute.components(texts, 5, 80).items() if c == d)
    twice = docs.unionByName(docs.where("doc_id < 5"))
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, twice, SF).collect()) == kept


def test_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] >= 0.97 * 200 and sizes[2] == sizes[1]
    check = docs.dropDuplicates(["doc_id", "text"])
    out = pipeline.pack_windows(spark, check, SF).collect()
    check_packing([(r["doc_id"], r["text"]) for r in check.collect()], out, pipeline.TOKENIZER, pipeline.WINDOW)
