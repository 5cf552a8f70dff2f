"""Places in an order, and windows over the last rows, without one task for all."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import mapping, ordering
from millrace.streaming import pipeline


@pytest.mark.parametrize("by", [["k"], ["k", "j"], []])
def test_places_in_groups(spark, by):
    """A hot group, null keys, ties and null orders; a group that fills several ranges."""
    draw = random.Random(7)
    rows = [("hot" if i % 3 else draw.choice(["a", "b", None]), draw.choice([0, None]), draw.choice([None, *range(20)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, j int, o int, id int").withColumns({"range": F.lit(1), "run_place": F.lit(1), "tie": F.lit(1), "carried": F.lit(1)})
    out = ordering.numbered(df.repartition(6), by, ["o"], first=1).collect()
    assert len(out) == 900 and set(out[0].asDict()) == {*df.columns, "place"}
    groups = {}
    for r in out:
        groups.setdefault(tuple(r[c] for c in by), []).append((r["place"], -1 if r["o"] is None else r["o"]))
    for found in groups.values():
        found.sort()
        assert [p for p, _ in found] == list(range(1, len(found) + 1)) and [o for _, o in found] == sorted(o for _, o in found)
    assert ordering.numbered(df.limit(0), by, ["o"]).count() == 0


def test_places_in_files(spark, tmp_path):
    """Rows keep the places that they have in the files, although tasks read parts of files, in another order."""
    rows = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat(cast(id * 7919 % 1000 AS string), 20) AS text")
    path = f"file://{tmp_path}/in"
    rows.where("id < 3000").coalesce(1).write.option("maxRecordsPerFile", 1100).option("parquet.block.size", 4096).parquet(path + "/a")
    rows.where("id >= 3000").coalesce(1).write.parquet(path + "/b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = ordering.in_order(spark, path + "/*").withColumn("task", F.spark_partition_id())
        found = out.select("id", "place", "task").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 5000 and all(r["id"] == r["place"] for r in found) and len({r["task"] for r in found}) > 4
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan and "Sort" not in plan
    twice = mapping.ordered_in_place(ordering.in_order(spark, path + "/*", columns=["id"]), "place", F.when(F.col("id") % 2 == 0, F.array("id", -F.col("id"))), "x")
    assert [r["x"] for r in sorted(twice.collect(), key=lambda r: (r["place"], r["pos"]))] == [x for i in range(0, 5000, 2) for x in (i, -i)]


@pytest.mark.parametrize("size", [5, 7, 10_000])
def test_running_counts_in_blocks(spark, size):
    counts = [random.Random(i).randint(0, 50) for i in range(83)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "at int, n int").withColumn("block", F.lit("clash"))
    out = pipeline.running_count(df.repartition(4), "at", "n", size=size)
    assert {r["at"]: r["mean"] for r in out.collect()} == {i: max(1, sum(counts[max(0, i - 4) : i + 1]) // min(5, i + 1)) for i in range(83)}
    assert set(out.columns) == {"at", "n", "block", "mean"} and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pipeline.running_count(df, "at", "n", size=4)
