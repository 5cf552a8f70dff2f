"""Connected components of a graph that is given as pairs: forests of what each task has, then alternating stars.

Edge cases: pairs with a null node, of a node with itself, and repeated ones change nothing; nodes without a pair have no row; a table
without pairs gives none; nodes are numbers, of which ties can't be; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import written

#: Pairs that a task joins at once (some 100 bytes each). Up to so many are joined in one task, which needs no rounds.
IN_ONE_TASK = 200_000


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x


def _forest(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows u, v. For every ``most`` of them: each node, but the smallest, with the smallest that they connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> Iterator[pa.RecordBatch]:
            nodes = list(union.up)
            for at in range(0, len(nodes), 8192):
                rows = [(x, root) for x in nodes[at : at + 8192] if (root := union.find(x)) != x]
                if rows:
                    u, v = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        union, held = Union(), 0
        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                union.join(u, v)
                held += 1
                if held == most:
                    yield from stars()
                    union, held = Union(), 0
        yield from stars()

    return run


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (bigint). node, component (the smallest node reachable) for every node that has an edge.

    Reading edges should need no Python: a task would have two workers, whose memory adds up.

    Each task first leaves of its pairs what connects the same nodes: a row for each node at most, however many pairs it has.
    Of IN_ONE_TASK pairs or fewer that are left, one more such pass over all is the result.

    More are joined in rounds. Each hangs a node's larger neighbours on its smallest one, and then its smaller ones. Neighbourhoods
    are never collected: their smallest node is an aggregate that each task computes for its part first, and the join that
    brings it back makes a row for each pair; it is one whose skewed partitions Spark splits. A round is written to the shared
    folder; the number of rounds grows with the logarithm of the graph's diameter.
    """
    ship_code(edges.sparkSession)
    bound_batches(edges.sparkSession)
    forest = lambda df: df.mapInArrow(_forest(max(IN_ONE_TASK, 1)), "u bigint, v bigint")
    pairs = written(forest(edges.where("u <> v").select("u", "v")).distinct(), "pairs")
    if pairs.count() <= IN_ONE_TASK:
        pairs = written(forest(pairs.coalesce(1)), "pairs")
    else:
        while not _are_stars(pairs):
            both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            pairs = written(small.where("u <> v").distinct(), "pairs")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every pair, whose u is the larger node, leads from a node with no other pair to one that leads nowhere."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()
