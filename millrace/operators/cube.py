"""Grouping by all dimensions, time partitions, and merging of cubes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spec import CubeSpec, epoch_seconds

#: Monday 5 January 1970: buckets of whole weeks start on Mondays, as they do when counted from year 1.
WEEK_START = 4 * 86_400


def aggregate(df: DataFrame, dims: list[str], counts: dict[str, Column | int]) -> DataFrame:
    """A row for each key; each count is the sum of a column (1 counts rows). Null is a key like any other."""
    of = lambda c: F.lit(c) if isinstance(c, int) else c
    return df.groupBy(*dims).agg(*[F.coalesce(F.sum(of(c)), F.lit(0)).cast("bigint").alias(k) for k, c in counts.items()])


def bucket(seconds: Column, length: int) -> Column:
    """Start of the tumbling bucket of length seconds that holds the time."""
    if length < 1:
        raise ValueError("a bucket has one second at least")
    start = WEEK_START if length % (7 * 86_400) == 0 else 0
    return seconds - F.pmod(seconds - start, F.lit(length))


def time_partitioned(df: DataFrame, spec: CubeSpec, counts: dict[str, Column | int], length: int = 1) -> DataFrame:
    """The cube of df with part_start: groups within tumbling partitions. Times are cut to seconds before they are keys."""
    rows = df.withColumn(spec.time_col, epoch_seconds(df, spec.time_col))
    return aggregate(rows.withColumn("part_start", bucket(F.col(spec.time_col), length)), ["part_start", *spec.dims], counts)


def repartitioned(cube: DataFrame, fine: int, coarse: int, name: str = "outer_start") -> DataFrame:
    """Adds the coarser partition of each row; rows stay as fine as they are."""
    if coarse < fine or coarse % fine:
        raise ValueError(f"partitions of {fine} s don't make up partitions of {coarse} s")
    return cube.withColumn(name, bucket(F.col("part_start"), coarse))


def merge(cubes: list[DataFrame], dims: list[str], counts: list[str]) -> DataFrame:
    """Sums over equal keys."""
    return aggregate(reduce(DataFrame.unionByName, cubes), dims, {c: F.col(c) for c in counts})


def merge_disjoint(a: DataFrame, b: DataFrame, part: str = "part_start") -> DataFrame:
    """Both cubes' rows; raises if they have a partition in common."""
    common = a.select(part).distinct().join(b.select(part).distinct(), part, "left_semi").limit(1).collect()
    if common:
        raise ValueError(f"both cubes have partition {common[0][0]}")
    return a.unionByName(b)


def matched(old: DataFrame, delta: DataFrame, dims: list[str], counts: list[str]) -> DataFrame:
    """Keys in both, with summed counts. Null keys match null keys."""
    on = reduce(lambda x, y: x & y, [F.col(f"o.{d}").eqNullSafe(F.col(f"d.{d}")) for d in dims])
    sums = [(F.col(f"o.{c}") + F.col(f"d.{c}")).alias(c) for c in counts]
    return old.alias("o").join(delta.alias("d"), on).select(*[f"o.{d}" for d in dims], *sums)


def inserted(old: DataFrame, delta: DataFrame, dims: list[str]) -> DataFrame:
    """The delta's rows whose key is not in old."""
    on = reduce(lambda x, y: x & y, [F.col(f"d.{d}").eqNullSafe(F.col(f"o.{d}")) for d in dims])
    return delta.alias("d").join(old.select(*dims).alias("o"), on, "left_anti")


def closed(cube: DataFrame, part: str = "part_start") -> DataFrame:
    """Rows of partitions older than the newest one. The newest start comes by broadcast: one number."""
    newest = cube.agg(F.max(part).alias("__newest"))
    return cube.join(F.broadcast(newest), F.col(part) < F.col("__newest")).drop("__newest")


class Cutoff:
    """Flushes a growing cube's closed partitions once each: those older than the newest time seen, from the last cutoff on; then that
    time is the cutoff, and what is older is late."""

    def __init__(self, part: str = "part_start") -> None:
        self.part, self.at = part, None

    def flush(self, cube: DataFrame, newest: int) -> DataFrame:
        rows = cube.where(F.col(self.part) < newest)
        if self.at is not None:
            rows = rows.where(F.col(self.part) >= self.at)
        self.at = max(newest, self.at or newest)
        return rows

    def late(self, cube: DataFrame) -> DataFrame:
        """Rows of partitions that have been flushed already."""
        return cube.where(F.lit(False)) if self.at is None else cube.where(F.col(self.part) < self.at)


def top_partition(cube: DataFrame, part: str = "part_start") -> DataFrame:
    """Rows of the newest partition."""
    newest = cube.agg(F.max(part).alias("__newest"))
    return cube.join(F.broadcast(newest), F.col(part) == F.col("__newest")).drop("__newest")


def partition_bounds(cube: DataFrame, name: str, length: int, part: str = "part_start") -> DataFrame:
    """part_start, part_stop (its last second) and table_name for each partition."""
    starts = cube.select(part).distinct()
    return starts.select(F.col(part).alias("part_start"), (F.col(part) + length - 1).alias("part_stop"), F.concat_ws("_", F.lit(name), F.col(part).cast("string")).alias("table_name"))


def federated(nodes: list[DataFrame], aggregate_by: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """UNION of the nodes' tables, which makes one row of equal ones; or, given (dims, counts), sums over equal keys."""
    if aggregate_by:
        return merge(nodes, *aggregate_by)
    return reduce(DataFrame.unionByName, nodes).distinct()
