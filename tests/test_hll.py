import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hll

# Fixed value: the stored bytes of a sketch of four strings, as the storage format defines them.
GOLDEN = bytes([
    18, 139, 127, 165, 171, 229, 36, 51, 65, 150, 204, 166, 54, 223, 36, 180, 128, 179, 96, 247, 35, 127, 96, 49, 70, 47, 150, 3, 194, 204, 79, 8, 188, 203, 205,
])


def h(*values: bytes) -> list[int]:
    return hll.murmur_many(list(values))


def test_packed_bytes_of_four_strings():
    assert hll.pack(hll.build(h(b"test1", b"test2", b"test3", b"test4"))) == GOLDEN


def test_published_hashes_with_blocks():
    # first halves of MurmurHash3_x64_128, seed 0
    assert hll.murmur_many([b"", b"hello"]) == [0, 0xCBD8A7B341BD9B02 - (1 << 64)]
    assert hll.murmur_many([b"The quick brown fox jumps over the lazy dog"])[0] == 0xE34BBC7BBC071B6C - (1 << 64)


def test_a_batch_of_lengths_hashes_as_one_by_one():
    values = [bytes(range(n)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 31, 32, 33)]
    assert hll.murmur_many(values) == [hll.murmur_many([v])[0] for v in values]
    assert hll.murmur_many([None, b"x"])[0] is None


def test_union_of_explicit_sketches():
    both = hll.union(hll.build(h(b"test1", b"test2")), hll.build(h(b"test1", b"test3")))
    assert both.describe() == "EXPLICIT, 3 elements, nregs=2048, nbits=5, expthresh=-1(160), sparseon=1"


def test_promotion_at_161():
    values = h(*[b"v%d" % i for i in range(161)])
    assert hll.build(values[:160]).kind == "EXPLICIT" and hll.build(values).kind == "COMPRESSED"
    assert hll.union(hll.build(values[:100]), hll.build(values[100:])) == hll.build(values)


def test_tolerance():
    for n in (1000, 20_000):
        assert abs(hll.build(h(*[i.to_bytes(8, "little") for i in range(n)])).cardinality() - n) <= n / 10


def test_undefined_absorbs_and_empty_is_identity():
    some, undefined, empty = hll.build(h(b"a")), hll.Sketch(hll.DEFAULT, None, None), hll.build([])
    assert hll.union(some, undefined).kind == "UNDEFINED" and hll.union(some, empty) == some
    assert undefined.cardinality() == -1 and hll.unpack(hll.pack(undefined)) == undefined


def test_parameters_must_agree():
    with pytest.raises(ValueError):
        hll.union(hll.build([]), hll.build([], hll.Shape(10)))
    with pytest.raises(ValueError):
        hll.Shape(32)


@pytest.mark.parametrize("bad", [b"", b"\x22\x8b\x7f", GOLDEN[:-1], GOLDEN[:3] + GOLDEN[11:19] + GOLDEN[3:11], b"\x14\x8b\x7f\x00"])
def test_broken_bytes_are_refused(bad):
    with pytest.raises(ValueError):
        hll.unpack(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=900), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=900))
def test_union_properties_and_round_trip(a, b):
    x, y = hll.build(a), hll.build(b)
    assert hll.union(x, y) == hll.union(y, x) == hll.build(a + b)
    assert hll.union(x, x) == x
    assert hll.unpack(hll.pack(x)) == x


def test_spark_sketches_equal_python_ones(spark):
    data = [("few", i % 50) for i in range(200)] + [("some", i) for i in range(400)] + [("many", i) for i in range(5000)]
    df = spark.createDataFrame(data, "k string, v bigint")
    hashed = df.select("k", hll.hash_column(df, "v").alias("h"))
    packed = {r["k"]: bytes(r["s"]) for r in hll.sketches(hashed, ["k"], "h", "s").collect()}
    estimates = {r["k"]: r["e"] for r in hll.estimates(hashed, ["k"], "h", "e").collect()}
    for k in ("few", "some", "many"):
        expected = hll.build(h(*[v.to_bytes(8, "little") for x, v in data if x == k]))
        assert packed[k] == hll.pack(expected)
        assert estimates[k] == pytest.approx(expected.cardinality())


def test_slices_of_hashes_are_explicit_and_in_order(spark):
    """Hashes close together, far apart, of few bits, null and twice; no slice has more than an explicit sketch holds."""
    values = [i * i for i in range(900)] + [-i for i in range(1, 400)] + h(*[b"%d" % i for i in range(700)]) + [-(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([("a", v) for v in values * 2] + [("b", v) for v in values[:3]] + [("b", None), ("none", None)], "k string, h bigint")
    rows = hll.sliced(df, ["k"], "h").collect()
    assert sorted((r["k"], r["h"]) for r in rows if r["h"] is not None) == sorted({("a", v) for v in values} | {("b", v) for v in values[:3]})
    assert sorted((r["k"], r["slice"]) for r in rows if r["h"] is None) == [("b", 0), ("none", 0)]
    by = {}
    for r in rows:
        if r["h"] is not None:
            by.setdefault(r["slice"], set()).add(r["h"])
    assert len(by) > 1 and max(map(len, by.values())) <= 160
    order = sorted(by)
    assert all(max(by[a]) < min(by[b]) for a, b in zip(order, order[1:], strict=False))
    assert {r["slice"] for r in hll.sliced(df.where("k = 'b'"), ["k"], "h").collect()} == {0}
    assert hll.sliced(df.limit(0), ["k"], "h").count() == 0


def test_integers_hash_by_width(spark):
    df = spark.createDataFrame([(34, 304), (1, 1), (1, 1)], "a int, b bigint")
    hashes = {r[0] for r in df.select(hll.hash_column(df, "a")).collect()} | {r[0] for r in df.limit(1).select(hll.hash_column(df, "b")).collect()}
    assert len(hashes) == 3


def test_address_bytes(spark):
    rows = [(bytes([153, 23, 1, 4]),), (bytes(16),), (bytes(8),), (bytes(5),), (b"",), (b"abc",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "b binary").select(hll.address_bytes("b")).collect()]
    assert [None if x is None else bytes(x) for x in out] == [bytes([153, 23, 1, 4]), bytes(8), bytes(8), None, None, None, None]


def test_distributed_union_equals_the_union_of_all(spark):
    """All kinds of sketches, nulls, a key with many sketches, null keys, and sums beside them."""
    draw, rows = random.Random(1), []
    values = {k: [draw.getrandbits(63) for _ in range(n)] for k, n in (("few", 5), ("edge", 160), ("more", 161), ("many", 9000), (None, 40))}
    for k, all_of in values.items():
        for _ in range(60):
            some = draw.sample(all_of, draw.randint(0, len(all_of)))
            rows.append((k, hll.pack(hll.build(some)), 1))
        rows.append((k, hll.pack(hll.build(all_of)), 1))
        rows.append((k, None, None))
    rows += [("none", None, 2), ("empty", hll.pack(hll.build([])), 1), ("gone", hll.pack(hll.Sketch(hll.DEFAULT, None, None)), 1), ("gone", rows[0][1], 1)]
    df = spark.createDataFrame(rows, "k string, s binary, n int").repartition(7)
    expected = {k: hll.pack(hll.build(v)) for k, v in values.items()} | {"none": None, "empty": hll.pack(hll.build([])), "gone": hll.pack(hll.Sketch(hll.DEFAULT, None, None))}
    out = {r["k"]: (None if r["s"] is None else bytes(r["s"]), r["n"]) for r in hll.union_agg(df, ["k"], ["s"], ["n"]).collect()}
    assert {k: s for k, (s, _) in out.items()} == expected and all(out[k][1] == 61 for k in values) and out["none"][1] == 2
    assert "collect_list" not in hll.union_agg(df, ["k"], ["s"])._jdf.queryExecution().toString()
    one = hll.union_agg(df.where("k <> 'gone'"), [], ["s"]).collect()
    assert len(one) == 1 and bytes(one[0]["s"]) == hll.pack(hll.build([h for k, v in values.items() if k for h in v]))
    assert hll.union_agg(df.limit(0), ["k"], ["s"], ["n"]).count() == 0


def test_contents_and_text_of_sketches(spark):
    few, full, none, empty = hll.build([5, -3, 1 << 40]), hll.build(range(1000, 9000)), hll.Sketch(hll.DEFAULT, None, None), hll.build([])
    rows = [("few", hll.pack(few)), ("full", hll.pack(full)), ("none", hll.pack(none)), ("empty", hll.pack(empty)), ("null", None)]
    df = spark.createDataFrame(rows, "k string, s binary")
    found = {}
    for r in hll.contents(df, ["k"], "s").collect():
        found.setdefault((r["k"], r["kind"]), []).append((r["at"], r["value"]))
    assert found == {("few", "EXPLICIT"): [(0, -3), (1, 5), (2, 1 << 40)], ("full", "COMPRESSED"): list(full.registers), ("none", "UNDEFINED"): [(None, None)], ("empty", "EMPTY"): [(None, None)]}
    text = {r["k"]: r["t"] for r in df.select("k", hll.dump("s").alias("t")).collect()}
    assert text["null"] is None and text["empty"] == empty.describe()
    assert text["few"].splitlines() == [few.describe() + ":", f"0: {-3:20d} ", f"1: {5:20d} ", f"2: {1 << 40:20d} "]
    lines = text["full"].splitlines()
    assert len(lines) == 1 + 2048 // 32 and lines[2].startswith("  32: ") and [int(x) for line in lines[1:] for x in line[6:].split()] == [dict(full.registers).get(i, 0) for i in range(2048)]


def test_distributed_union_refuses_other_parameters(spark):
    df = spark.createDataFrame([(hll.pack(hll.build([1])),), (hll.pack(hll.build([1], hll.Shape(10))),)], "s binary")
    with pytest.raises(Exception, match="different parameters"):
        hll.union_agg(df, [], ["s"]).collect()


def test_a_task_sends_one_sketch_of_a_key_on(spark):
    """A key with very many sketches: what is dealt by key is a row for each task that had some."""
    data = hll.pack(hll.build(range(5000)))
    df = spark.range(0, 5000, 1, 5).select((F.col("id") % 2).alias("k"), F.lit(data).alias("s"))
    assert hll.united_in_tasks(df, ["k"], ["s"]).count() == 2 * 5
    assert {bytes(r["s"]) for r in hll.union_agg(df, ["k"], ["s"]).collect()} == {data}
