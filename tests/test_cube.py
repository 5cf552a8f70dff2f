import pytest
from pyspark.sql import functions as F

from millrace.operators import cube
from millrace.operators.spec import CubeSpec, Dimension, Measure, epoch_seconds
from millrace.operators.table import CubeTable

SPEC = CubeSpec("Test", (Dimension("d1", "time"), Dimension("d2", "int")), (Measure("a1"), Measure("a2")))
# The time that the test's rows begin at, and below the wording of the table's definition.
START = 1257894000


def table(spark, tmp_path, spec=SPEC):
    return CubeTable(spark, f"file://{tmp_path}/cube", spec)


def delta(spark, rows):
    return spark.createDataFrame(rows, "part_start bigint, d1 bigint, d2 bigint, a1 bigint, a2 bigint")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [(x is None, x) for x in t])


def test_groups_by_all_dimensions(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1), (1, 1, 1, 1), (2, 1, 3, 4)], "d1 long, d2 long, a1 long, a2 long")
    assert got(cube.aggregate(df, ["d1", "d2"], {"a1": F.col("a1"), "a2": F.col("a2")})) == [(1, 1, 2, 2), (2, 1, 4, 5)]


def test_null_is_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "k string, v long")
    assert got(cube.aggregate(df, ["k"], {"v": F.col("v")})) == [("a", 0), (None, 3)]


def test_definition_as_sql():
    assert SPEC.create_sql("Test") == "CREATE TABLE IF NOT EXISTS Test (d1 INT, d2 INT, a1 INT, a2 INT, PRIMARY KEY(d1, d2))"
    assert SPEC.drop_sql("Test") == "DROP TABLE IF EXISTS Test CASCADE"


def test_copy_lines(spark):
    df = delta(spark, [(START, START + 60 * i, 1, 1, 1) for i in range(3)])
    assert sorted(r[0] for r in df.select(SPEC.copy_line()).collect()) == [f"{START + 60 * i}\t1\t1\t1" for i in range(3)]


def test_spec_is_checked(spark):
    with pytest.raises(ValueError):
        CubeSpec("x", (Dimension("a"),))
    with pytest.raises(ValueError):
        CubeSpec("x", (Dimension("t", "time"), Dimension("T")))
    with pytest.raises(ValueError):
        Dimension("h", "hll")
    with pytest.raises(ValueError):
        SPEC.check(spark.createDataFrame([(1, "x", 1, 1)], "d1 long, d2 string, a1 long, a2 long"))


def test_three_upserts_add(spark, tmp_path):
    t = table(spark, tmp_path)
    t.create()
    d = delta(spark, [(START, START + 60 * i, 1, 1, 2) for i in range(3)])
    for n in (1, 2, 3):
        t.upsert(d)
        assert got(t.read().select("a1", "a2")) == [(n, 2 * n)] * 3


def test_replayed_batch_counts_once_and_late_rows_are_added(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.upsert(delta(spark, [(7200, 7200, 1, 1, 1)]), "feed", 0)
    assert t.upsert(delta(spark, [(3600, 3601, 1, 5, 5)]), "feed", 1)
    assert not t.upsert(delta(spark, [(3600, 3601, 1, 5, 5)]), "feed", 1)
    assert t.upsert(delta(spark, [(3600, 3601, 1, 5, 5)]), "other", 1)
    assert got(t.read().select("d1", "a1")) == [(3601, 10), (7200, 1)]
    assert t.partitions() == [3600, 7200] and got(t.read(start=7200).select("a1")) == [(1,)]
    t.drop_partition(7200)
    assert t.partitions() == [3600]


def test_two_writers_of_one_version_clash(spark, tmp_path):
    t = table(spark, tmp_path)
    t.create()
    with pytest.raises(RuntimeError):
        t._publish({"version": 1, "applied": {}, "parts": {}})


def test_upsert_in_parts_equals_upsert_at_once(spark, tmp_path):
    rows = [(3600 * (i % 3), 3600 * (i % 3) + i % 5, i % 2, i, 1) for i in range(60)]
    a, b = table(spark, tmp_path / "a"), table(spark, tmp_path / "b")
    a.upsert(a.merged([delta(spark, rows)]))
    b.upsert(b.merged([delta(spark, rows[:20])]))
    b.upsert(b.merged([delta(spark, rows[20:])]))
    assert got(a.read()) == got(b.read())


def test_stored_sketches_merge(spark, tmp_path):
    from millrace.functions import hll

    spec = CubeSpec("s", (Dimension("t", "time"),), (Measure("n"), Measure("u", "hll")))
    t = table(spark, tmp_path, spec)
    for base in (0, 100):
        df = spark.range(base, base + 150).selectExpr("0L AS part_start", "0L AS t", "id")
        hashed = df.select("part_start", "t", hll.hash_column(df, "id").alias("h"))
        t.upsert(hll.sketches(hashed, ["part_start", "t"], "h", "u").withColumn("n", F.lit(150).cast("long")))
    row = t.read().select("n", hll.cardinality("u").alias("c")).first()
    assert row["n"] == 300 and abs(row["c"] - 250) < 25


def test_time_buckets(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-03 12:34:56' AS a, timestamp'2024-01-03 12:34:56.9' AS b, timestamp_ntz'1969-12-31 23:59:58.5' AS c")
    s = epoch_seconds(df, "a")
    row = df.select(cube.bucket(s, 7 * 86400).alias("w"), cube.bucket(s, 3600).alias("h"), epoch_seconds(df, "b").alias("b"), epoch_seconds(df, "c").alias("c")).first()
    assert (row["w"], row["h"], row["b"], row["c"]) == (1704067200, 1704283200, 1704285296, -2)


def test_repartitioning_must_divide(spark):
    df = spark.createDataFrame([(0,)], "part_start long")
    for fine, coarse in ((3600, 60), (7, 60)):
        with pytest.raises(ValueError):
            cube.repartitioned(df, fine, coarse)


def test_overlapping_cubes_are_refused(spark):
    a = spark.createDataFrame([(0, 1), (60, 1)], "part_start long, n long")
    with pytest.raises(ValueError):
        cube.merge_disjoint(a, a.where("part_start = 60"))


def test_federated(spark, tmp_path):
    a = spark.createDataFrame([(1, 5), (2, 1)], "k long, n long")
    assert got(cube.federated([a, a.where("k = 1")])) == [(1, 5), (2, 1)]
    assert got(cube.federated([a, a.where("k = 1")], (["k"], ["n"]))) == [(1, 10), (2, 1)]


def test_view_and_page(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(delta(spark, [(0, i, 1, i, 0) for i in range(10)]))
    assert spark.table(t.view("Test", [t.read()])).count() == 10
    assert [r["d1"] for r in t.page(["d1"], "a1 > 2", limit=3, offset=1).collect()] == [4, 5, 6]
