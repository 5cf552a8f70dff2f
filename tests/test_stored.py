"""Cubes stored in buckets: what is stored is not moved, and null keys match."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import hll
from millrace.operators import cube
from millrace.operators.spec import CubeSpec, Dimension, Measure
from millrace.operators.stored import KEY, StoredCube

SPEC = CubeSpec("hits", (Dimension("ts", "time"), Dimension("kind")), (Measure("n"),))


def frame(spark, rows):
    return spark.createDataFrame(rows, "ts bigint, kind string, n bigint")


@pytest.fixture
def both(spark):
    old = frame(spark, [(i, f"k{i % 7}", i) for i in range(500)] + [(1000, None, 5), (None, "x", 6), (None, None, 7)])
    new = frame(spark, [(i, f"k{i % 7}", 1) for i in range(300, 700)] + [(1000, None, 1), (None, None, 1), (None, "y", 1)])
    table = StoredCube.temporary(spark, SPEC, 5)
    table.store(old)
    yield table, old, new
    table.drop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_joins_equal_plain_ones(both):
    table, old, new = both
    assert rows(table.matched(new)) == rows(cube.matched(old, new, SPEC.dims, ["n"]))
    assert rows(table.inserted(new)) == rows(cube.inserted(old, new, SPEC.dims))
    assert rows(table.untouched(new)) == rows(cube.inserted(new, old, SPEC.dims))
    table.merge(new)
    assert rows(table.read()) == rows(cube.merge([old, new], SPEC.dims, ["n"]))
    table.merge(new.limit(0))
    assert rows(table.read()) == rows(cube.merge([old, new], SPEC.dims, ["n"]))


def test_stored_rows_are_not_exchanged(both):
    """The only exchange of the final plan is the delta's; the stored side goes from its scan to the join."""
    table, _, new = both
    for out in (table.matched(new), table.inserted(new), table.untouched(new)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert len(re.findall(r"\bExchange hashpartitioning", final)) == 1 and "SortMergeJoin" in final
        scan = [line for line in final.splitlines() if "FileScan parquet" in line or "Scan parquet" in line]
        assert len(scan) == 1 and "Bucketed: true" in scan[0]
        depth = lambda line: len(re.match(r"[\s:+\-*()0-9]*", line).group())
        lines = final.splitlines()
        at = next(i for i, line in enumerate(lines) if "parquet" in line and "Scan" in line)
        above, now = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < now:
                above.append(line)
                now = depth(line)
        below_join = above[: next(i for i, line in enumerate(above) if "SortMergeJoin" in line)]
        assert not any("Exchange" in line for line in below_join)


def test_stored_sketches_are_united(spark):
    spec = CubeSpec("s", (Dimension("t", "time"),), (Measure("n"), Measure("u", "hll")))
    make = lambda lo, hi, ts: [(t, 1, hll.pack(hll.build(range(lo, hi)))) for t in ts]
    schema = "t bigint, n bigint, u binary"
    table = StoredCube.temporary(spark, spec, 3)
    table.store(spark.createDataFrame(make(0, 100, [1, 2]), schema))
    table.merge(spark.createDataFrame(make(50, 150, [2, 3]), schema))
    out = {r["t"]: (r["n"], r["c"]) for r in table.read().withColumn("c", hll.cardinality("u")).collect()}
    assert out == {1: (1, 100.0), 2: (2, 150.0), 3: (1, 100.0)}
    table.drop()


def test_a_column_of_that_name_is_refused(spark):
    with pytest.raises(ValueError, match=KEY):
        StoredCube(spark, "x", CubeSpec("x", (Dimension("t", "time"), Dimension(KEY)), ()))


def test_keys_of_equal_hash_do_not_match(both, monkeypatch):
    table, old, new = both
    monkeypatch.setattr(StoredCube, "key", lambda self: F.lit(1).cast("bigint"))
    table.store(old)
    assert rows(table.matched(new)) == rows(cube.matched(old, new, SPEC.dims, ["n"]))
