"""Weighted routing of slots to nodes, and the versions (eras) of the node list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights by disk, the disk below which a node weighs less, slots, and eras that are kept.
WEIGHT, LOW_WEIGHT, LOW_DISK = 50, 30, 0.000809804
SLOTS, ERAS = 100, 10


def node_weight(disk: Column) -> Column:
    return F.when(disk < LOW_DISK, LOW_WEIGHT).otherwise(WEIGHT)


def slots(nodes: DataFrame, parity: bool = False) -> DataFrame:
    """slot (0 to 99) and node for the nodes (node, weight) of one era, in order of name; a row for each node is all that the window sorts.

    Each node gets weight * 100 / sum of weights slots, rounded down, after those before it. parity: a node's slots end where its own
    number of slots does, so that later nodes get few or none.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    sized = nodes.withColumn("n", F.floor(F.col("weight") * SLOTS / F.sum("weight").over(every)).cast("int"))
    sized = sized.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    stop = F.col("n") if parity else F.col("start") + F.col("n")
    return sized.where(stop > F.col("start")).select(F.explode(F.sequence(F.col("start"), stop - 1)).alias("slot"), "node")


def route(df: DataFrame, slot: Column, table: DataFrame) -> DataFrame:
    """Adds the node of each row's slot; a slot of 100 and above is slot 0. table: 100 rows at most, so it is broadcast."""
    at = F.when(slot >= SLOTS, 0).otherwise(slot)
    return df.withColumn("slot", at.cast("int")).join(F.broadcast(table), "slot", "left")


def era_lookup(times: DataFrame, eras: DataFrame) -> DataFrame:
    """The era whose time is exactly the row's (t), else the current one. eras: t, era; the newest is current."""
    current = eras.agg(F.max_by("era", "t").alias("__current"))
    found = times.join(eras.select("t", "era"), "t", "left").join(F.broadcast(current))
    return found.withColumn("era", F.coalesce("era", "__current")).drop("__current")


def retained(eras: DataFrame, kept: int = ERAS) -> DataFrame:
    """The newest eras."""
    return eras.orderBy(F.desc("t"), F.desc("era")).limit(kept)
