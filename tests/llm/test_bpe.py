"""Encoding against the tokenizers library, token by token; the transducer against a dictionary."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, lexicon, queries
from tests.llm.test_operators import CLASHING, LONG, ODD, SCHEMA, SF

LIBRARY = Tokenizer.from_file(queries.TOKENIZER)
STRANGE = [
    "don't WE'RE i'm 's''s 'S 't it''ll", "a<|endoftext|>b<|startoftext|><|endoftext", "<|ENDOFTEXT|> x", "İstanbul ΣΣ σς STRASSE ẞ", "é é ﬁ Å Å", "日本語 テスト 한국어 العربية हिन्दी",
    " no break\u0085next line　wide", "\x1c\x1d\x1e\x1f \x00\x7f \xad\xaa\xba\xb5", "½ ² 12³ ٣ 1,234.5 x1y2", "🙂👨‍👩‍👧 \U0001d11e", "a" * 3000, "ab" * 2001 + "!" * 777, "é" * 999, "一" * 500, "", " \t\r\n ", "�﻿ x", "ǅ ŉ ß ŒUVRE",
]


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def coder(tmp_path_factory):
    """A lexicon of a few words, so that both ways are taken."""
    words = ["the", "there", "then", "'s", "don", "!", "é", "日本語", "st", "a"]
    path = tmp_path_factory.mktemp("lexicon") / "file"
    model = bpe.Bpe(queries.TOKENIZER)
    ids, start, length = model.ids(words)
    path.write_bytes(lexicon.compiled({w.encode(): ids[a : a + n].tolist() for w, a, n in zip(words, start, length, strict=True)}))
    return bpe.Coder(queries.TOKENIZER, lexicon.Transducer(str(path)))


def test_strange_texts(coder):
    import pyarrow as pa

    texts = [*STRANGE, "\n".join(STRANGE), None]
    out = coder.encode(texts)
    assert out.to_pylist() == [plain(t)[0] for t in texts]
    assert bpe.decoded(out, pa.array(coder.bpe.tokens(), pa.string())).to_pylist() == [plain(t)[1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinorst '́ÄéÉß<|>\n ")), max_size=40), max_size=4))
def test_any_text(coder, texts):
    assert coder.encode(texts).to_pylist() == [plain(t)[0] for t in texts]


def test_any_portions(coder, monkeypatch):
    monkeypatch.setattr(bpe, "PORTION", 7)
    monkeypatch.setattr(bpe.portions, "__defaults__", (7,))
    texts = [*STRANGE, "the there then thine " * 9, LONG[:5000]]
    assert all("".join(bpe.portions(t)) == t for t in texts)
    assert coder.encode(texts).to_pylist() == [plain(t)[0] for t in texts]


def test_long_pieces_are_merged_as_short_ones(coder, monkeypatch):
    draw = random.Random(3)
    pieces = ["".join(draw.choice("aeinorsthe") for _ in range(n)) for n in (1, 2, 3, 6, 7, 9, 40, 48, 49, 64, 65, 400)] + ["a" * 47, "a" * 48, "aab" * 16, "aab" * 30]
    for widths in ((6, 9, 12, 16, 24, 48), (1,), (400,)):
        monkeypatch.setattr(bpe, "WIDTHS", widths)
        ids, start, length = coder.bpe.merged([p.encode() for p in pieces])
        assert [ids[a : a + n].tolist() for a, n in zip(start, length, strict=True)] == [plain(p)[0] for p in pieces]


def test_transducer_equals_a_dictionary(tmp_path):
    draw = random.Random(5)
    words = sorted({bytes(draw.choice(b"abcd\xff") for _ in range(draw.randint(0, 7))) for _ in range(3000)} | {b"", b"x" * 64})
    ids = {w: [draw.randrange(49_408) for _ in range(draw.randint(0, 3))] for w in words}
    (tmp_path / "file").write_bytes(lexicon.compiled(ids))
    found = lexicon.Transducer(str(tmp_path / "file"))
    place = found.find(words)
    assert place.tolist() == list(range(len(words)))
    assert [found.ids[a:b].tolist() for a, b in zip(found.starts, found.starts[1:], strict=False)] == [ids[w] for w in words]
    others = [w + b"z" for w in words[:50]] + [w[:-1] for w in words if w[:-1] not in ids][:50] + [b"x" * 63, b"x" * 65, b"\x00"]
    assert (found.find(others) == -1).all() and found.find([]).tolist() == []
    assert isinstance(found.keys.base, np.memmap) or isinstance(found.keys, np.memmap)


def test_automaton_is_minimal():
    """As many states as there are different sets of endings."""
    words = sorted({p + r + e for p in (b"un", b"re", b"") for r in (b"do", b"make", b"tie") for e in (b"", b"s", b"ing", b"able")})
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    states, _ = lexicon.minimal(words)
    assert len(states) == len(endings) < len({w[:i] for w in words for i in range(len(w) + 1)}) / 2
    with pytest.raises(ValueError):
        lexicon.minimal([b"b", b"a"])
    assert len(lexicon.minimal([])[0]) == 1


def test_query_equals_the_library(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r for r in queries.op12_bpe_codec(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, text = plain(d["text"])
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(text)), d["doc_id"]


def test_odd_documents(spark):
    odd = spark.createDataFrame(ODD + [(100 + i, t, None, None, None) for i, t in enumerate(STRANGE)], SCHEMA)
    for c in (*CLASHING, "word", "ids", "decoded"):
        odd = odd.withColumn(c, F.lit("clash"))
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for most in (0, 12, bpe.LEXICON):
        out = bpe.encode(odd.repartition(3), queries.TOKENIZER, bpe.build(odd, queries.TOKENIZER, most), decode_too=True).collect()
        assert len(out) == len(ODD) + len(STRANGE)
        for r in out:
            assert (r["ids"], r["decoded"]) == plain(texts[r["doc_id"]])
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(none, queries.TOKENIZER, bpe.build(none, queries.TOKENIZER)).count() == 0


def test_decode_alone(spark):
    rows = [(1, LIBRARY.encode("The cat's whiskers", add_special_tokens=False).ids), (2, []), (3, None), (4, [49_406, 320, 49_407])]
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>").withColumn("decoded", F.lit("old")), queries.TOKENIZER).collect()}
    assert out == {d: LIBRARY.decode(ids or [], skip_special_tokens=False) for d, ids in rows}
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id bigint, ids array<int>"), queries.TOKENIZER).collect()


def test_lexicon_takes_all_words_of_the_counts_that_fit(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 << (i % 10)) for i in range(100)], "word string, n bigint")
    taken = {r["word"] for r in bpe.frequent(counts, 35).collect()}
    assert taken == {f"w{i}" for i in range(100) if i % 10 >= 7}
    assert bpe.frequent(counts, 5).count() == 0 and bpe.frequent(counts.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "b a b " + "x" * 65), (2, "B don't"), (3, None)], "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in bpe.word_counts(docs).collect()} == {"a": 1, "b": 3, "don": 1, "'t": 1}
