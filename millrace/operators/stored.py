"""A cube stored in buckets of its keys, so that a delta is matched with it without moving what is stored.

Rows lie in buckets of a hash of all dimensions, sorted by it. A join by that hash needs no exchange on the stored side: only the
delta is dealt, to as many tasks as there are buckets. The dimensions themselves are compared too, null with null, so that equal hashes of
different keys don't match.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hll
from ..session import new_folder
from .spec import CubeSpec

KEY = "key_hash"


class StoredCube:
    """A table in the session's catalogue, with its files under path."""

    def __init__(self, spark: SparkSession, name: str, spec: CubeSpec, buckets: int = 64, path: str | None = None) -> None:
        if KEY in spec.columns:
            raise ValueError(f"a cube with a column {KEY} can't be stored in buckets")
        self.spark, self.name, self.spec, self.buckets = spark, name, spec, buckets
        self.path = path or new_folder(spark, "stored")

    @classmethod
    def temporary(cls, spark: SparkSession, spec: CubeSpec, buckets: int) -> StoredCube:
        """With a name and a place of its own."""
        return cls(spark, f"{spec.name}_{uuid.uuid4().hex}", spec, buckets)

    def key(self) -> Column:
        """xxhash64 passes nulls over, so each dimension says whether it is one."""
        return F.xxhash64(*[x for d in self.spec.dims for x in (F.col(d), F.col(d).isNull())])

    def store(self, cube: DataFrame) -> None:
        """Writes a cube, one row a key, in place of what is there. A bucket's rows come from one task, so there is a file for each."""
        rows = cube.select(*self.spec.columns).withColumn(KEY, self.key()).repartition(self.buckets, KEY)
        folder = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.mode("overwrite").option("path", folder).bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.spec.columns)

    def _join(self, delta: DataFrame, left: str, how: str) -> DataFrame:
        """left: which side comes first, s or d. merge: a broadcast would not move stored rows either, but the delta has no bound."""
        sides = {"s": self.spark.table(self.name).alias("s"), "d": delta.withColumn(KEY, self.key()).hint("merge").alias("d")}
        # said by order: equalities would be taken as keys of the join, by which stored rows would have to lie too
        same = [((F.col(f"s.{c}") >= F.col(f"d.{c}")) & (F.col(f"s.{c}") <= F.col(f"d.{c}"))) | (F.col(f"s.{c}").isNull() & F.col(f"d.{c}").isNull()) for c in self.spec.dims]
        on = reduce(lambda a, b: a & b, same, F.col(f"s.{KEY}") == F.col(f"d.{KEY}"))
        return sides[left].join(sides["d" if left == "s" else "s"], on, how)

    def matched(self, delta: DataFrame) -> DataFrame:
        """Keys in both, with their counts added; sketches are united (see ``merged``)."""
        if self.spec.sketches:
            both = self._join(delta, "s", "left_semi").select(*self.spec.columns).unionByName(self._join(delta, "d", "left_semi").select(*self.spec.columns))
            return hll.union_agg(both, self.spec.dims, self.spec.sketches, self.spec.counts).select(*self.spec.columns)
        sums = [(F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))).alias(c) for c in self.spec.counts]
        return self._join(delta, "s", "inner").select(*[f"s.{d}" for d in self.spec.dims], *sums)

    def inserted(self, delta: DataFrame) -> DataFrame:
        """The delta's rows whose key is not stored."""
        return self._join(delta, "d", "left_anti").select(*self.spec.columns)

    def untouched(self, delta: DataFrame) -> DataFrame:
        """Stored rows whose key the delta does not have."""
        return self._join(delta, "s", "left_anti").select(*self.spec.columns)

    def merge(self, delta: DataFrame) -> None:
        """Adds a delta, one row a key: the three kinds of rows make up the new table, which takes the place of the old one when it is written."""
        new = self.untouched(delta).unionByName(self.matched(delta)).unionByName(self.inserted(delta))
        staged = StoredCube.temporary(self.spark, self.spec, self.buckets)
        staged.store(new)
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        self.spark.sql(f"ALTER TABLE `{staged.name}` RENAME TO `{self.name}`")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
