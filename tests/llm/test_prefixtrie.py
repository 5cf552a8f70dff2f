"""The conversation trie against a plain walk along each conversation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import prefixtrie
from tests.llm import brute

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows, rebuilt=True):
    """Sorted rows of the trie; rows: conv_id, turn, role, text. Equal turn numbers are in order of the digest of role and text."""
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((t is not None, t or 0), digest, role, text))
    own = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, turns in own.items():
        if rebuilt:
            h, source = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
            turns = own.get(source, [])[:h] + turns[h:]
        full[c] = turns
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for prefix, found in members.items():
        words = len(brute.words(prefix[-1][1])) if prefix else 0
        out[prefix] = {"own": (len(found) - 1) * words, "children": 0, "leaves": 0, "saved": 0}
    for prefix in members:
        if prefix:
            out[prefix[:-1]]["children"] += 1
    for prefix in members:
        for d in range(len(prefix) + 1):
            out[prefix[:d]]["leaves"] += out[prefix]["children"] == 0
            out[prefix[:d]]["saved"] += out[prefix]["own"]
    result = []
    for prefix, found in members.items():
        ending = ",".join(str(c) for c in sorted(c for c in found if len(full[c]) == len(prefix)))
        o = out[prefix]
        parent = min(members[prefix[:-1]]) if prefix else None
        result.append((min(found), len(prefix), parent, len(found), o["children"], o["leaves"], o["saved"], hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(result, key=str)


def trie(df, rebuilt=True):
    turns = prefixtrie.turn_rows(df)
    convs = turns.select("conv_id").distinct()
    out = prefixtrie.prefix_trie(prefixtrie.shared_starts(turns, convs) if rebuilt else turns, convs)
    return sorted((tuple(r) for r in out.collect()), key=str)


ODD = [(0, 0, "user", "a b"), (0, 1, "bot", "c"), (0, 2, "user", "d e f"), (0, 3, "bot", "g"), (20, None, None, None), (20, 5, "user", ""), (20, 5, "user", "tie"),
       (20, 5, "user", "tie"), (-7, 1, "user", "a b"), (-7, 2, "x", " \t\n"), (None, 1, "user", "nobody"), (41, 1, "user", "y " * 20_000), (41, 2, None, "z"), (61, 9, "ab", "c"), (81, 9, "a", "bc")]


@pytest.mark.parametrize("rebuilt", [True, False])
def test_odd_conversations(spark, rebuilt):
    rows = ODD + [(c, t, "user" if t % 2 else None, f"w{t} same") for c in range(100, 140) for t in range(c % 5)] + [(c, 0, "user", "same start") for c in range(200, 230)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("depth", "key", "words", "node", "prefix", "up", "range", "run_place", "tie", "__before"):
        df = df.withColumn(c, F.lit("clash"))
    assert trie(df.repartition(5), rebuilt) == plain(rows, rebuilt)


def test_turnless_conversations_are_members_of_the_root(spark):
    """Conversations that have fewer turns than they borrow, from one that is not there."""
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    found, expected = trie(spark.createDataFrame(rows, SCHEMA)), plain(rows)
    assert found == expected and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)


def test_a_long_conversation_and_its_copies(spark):
    """One conversation has most of the rows, over several ranges; depths of no power of two."""
    rows = [(c, t, "user", f"t{t} of many") for c in (1, 2) for t in range(700)] + [(3, t, "user", f"t{t} of many") for t in range(333)] + [(4, 0, "user", "alone")]
    assert trie(spark.createDataFrame(rows, SCHEMA).repartition(7), False) == plain(rows, False)


def test_ids_of_a_full_node_are_in_numeric_order(spark):
    rows = [(c, 0, "user", "all alike") for c in [*range(-5, 3000, 7), 10**12]]
    assert trie(spark.createDataFrame(rows, SCHEMA), False) == plain(rows, False)


def test_no_conversations(spark):
    assert trie(spark.createDataFrame([], SCHEMA)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
