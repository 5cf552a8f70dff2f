"""Clusters around centroids by delta Lloyd rounds, in whole numbers.

A pass over the vectors gives each its nearest centroid and writes vectors, owners and distances as Parquet to the shared folder.
The sums and counts of all clusters are kept from round to round; what changes them comes from the same pass: each task leaves for each
cluster one row with the signed sum of what has moved in and out, which Spark adds up. A centroid is the floor of sum by count.

The next pass compares a vector with the centroids that have changed, and with all of them only if its own has changed: no other
centroid was nearer than its own before. If none has changed, there is no pass. Products are matrix products of whole batches, in
64-bit floats where every sum is exact in them, else in 64-bit integers; so results do not depend on the order of rows.

The driver and each task hold the centroids, k rows of d numbers, and nothing that grows with the table. No vector is shuffled.

Edge cases: a vector that is null, has another number of components, or a null, NaN or infinite one, is left out; components are cut to
what keeps distances within 64 bits (in 64 components: 2^27 either way, that is 2^19 before scaling); repeated ids and equal vectors
are rows each; a null id is kept, as an empty text in the hash; equal distances go to the smaller number; with fewer vectors than
k there are as many centroids as vectors; an empty cluster keeps its centroid; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import new_folder, remove_folder

STATE = "vec_id bigint, vec array<int>, owner int, distance bigint, moved array<bigint>"


def bound(size: int) -> int:
    """The largest component that keeps 4 * size * bound^2 under 2^63."""
    return 1 << ((60 - (size - 1).bit_length()) // 2)


def whole_vectors(vectors: DataFrame, size: int, scale: int, name: str = "embedding") -> DataFrame:
    """vec_id, vec: the floor of scale times each component, of vectors with size finite components."""
    finite = F.forall(name, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    most = float(bound(size))
    whole = F.transform(name, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("int"))
    return vectors.where((F.size(name) == size) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("vec"))


def seed_order(vec_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b, exact: whole numbers, of which no sum of products is beyond 64 bits."""
    top = lambda m: int(np.abs(m).max(initial=0))
    if a.shape[1] * top(a) * top(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squares = lambda m: (m * m).sum(axis=1)
    return squares(vectors)[:, None] - 2 * products(vectors, centroids.T) + squares(centroids)[None, :]


def nearest(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances. A vector without owner has -1."""
    owner, distance = owner.copy(), distance.copy()
    fresh = (owner < 0) | changed[owner]
    if fresh.any():
        d = distances(vectors[fresh], centroids)
        owner[fresh] = d.argmin(axis=1)
        distance[fresh] = d.min(axis=1)
    rest = np.flatnonzero(~fresh)
    if len(rest):
        numbers = np.flatnonzero(changed)
        d = distances(vectors[rest], centroids[numbers])
        best, least = numbers[d.argmin(axis=1)], d.min(axis=1)
        better = (least < distance[rest]) | (least == distance[rest]) & (best < owner[rest])
        owner[rest[better]], distance[rest[better]] = best[better], least[better]
    return owner, distance


def _pass(centroids: np.ndarray, changed: np.ndarray, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of STATE: the vectors with their new owners, then a row for each cluster that gained or lost: sums, and count last, in moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        moved = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            vec = batch.column("vec")
            v = np.asarray(vec.flatten()).astype(np.int64).reshape(len(batch), size)
            was = np.asarray(batch.column("owner")).astype(np.int64)
            owner, distance = nearest(v, was, np.asarray(batch.column("distance")), centroids, changed)
            other = np.flatnonzero(owner != was)
            if len(other):
                signs = np.zeros((k, len(other)), np.int64)
                signs[owner[other], np.arange(len(other))] += 1
                left = np.flatnonzero(was[other] >= 0)
                signs[was[other[left]], left] -= 1
                moved += products(signs, np.column_stack([v[other], np.ones(len(other), np.int64)]))
            columns = [batch.column("vec_id"), vec, pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.nulls(len(batch), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        rows = np.flatnonzero(moved.any(axis=1))
        if len(rows):
            none = lambda t: pa.nulls(len(rows), t)
            columns = [none(schema.field(0).type), none(schema.field(1).type), pa.array(rows, pa.int32()), none(pa.int64()), pa.array(moved[rows].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class Clusters:
    """State between passes: centroids, sums and counts of all clusters here; owners and distances in the shared folder."""

    def __init__(self, vectors: DataFrame, size: int, k: int, seed: int) -> None:
        """vectors: vec_id, vec of size whole numbers."""
        self.spark, self.size = vectors.sparkSession, size
        ship_code(self.spark)
        bound_batches(self.spark)
        first = vectors.orderBy(seed_order(F.col("vec_id"), seed), "vec_id", "vec").limit(k).collect()
        self.centroids = np.array([r["vec"] for r in first], np.int64).reshape(len(first), size)
        self.totals = np.zeros((len(first), size + 1), np.int64)
        self.changed = np.ones(len(first), bool)
        none = F.lit(None).cast("array<bigint>").alias("moved")
        self.rows = vectors.select("vec_id", "vec", F.lit(-1).alias("owner"), F.lit(0).cast("bigint").alias("distance"), none)
        self.path: str | None = None
        self.passes = 0

    def assign(self) -> None:
        """Every vector to its nearest centroid; the sums and counts as they are then. No pass if no centroid has changed."""
        if not self.changed.any():
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        path, before = new_folder(self.spark, "clusters"), self.path
        schema = self.spark.createDataFrame([], STATE).schema
        self.rows.mapInArrow(_pass(self.centroids, self.changed, to_arrow_schema(schema)), schema).write.parquet(path)
        state = self.spark.read.schema(schema).parquet(path)
        moved = state.where("moved is not null").select("owner", F.posexplode("moved").alias("at", "x"))
        for r in moved.groupBy("owner", "at").agg(F.sum("x").alias("x")).collect():  # k times size + 1 numbers at most
            self.totals[r["owner"], r["at"]] += r["x"]
        self.rows, self.path, self.passes = state.where("moved is null"), path, self.passes + 1
        if before:
            remove_folder(self.spark, before)

    def move(self) -> None:
        """Each centroid to the floor of its cluster's mean."""
        n = self.totals[:, self.size]
        new = np.where(n[:, None] > 0, self.totals[:, : self.size] // np.maximum(n, 1)[:, None], self.centroids)
        self.changed = (new != self.centroids).any(axis=1)
        self.centroids = new


def cluster(vectors: DataFrame, size: int, k: int, rounds: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """vec_id, vec, owner, distance for each of the vectors (vec_id, vec) after so many rounds, and the centroids."""
    state = Clusters(vectors, size, k, seed)
    if not len(state.centroids):
        return state.rows.drop("moved"), state.centroids
    for _ in range(rounds):
        state.assign()
        state.move()
    state.assign()
    return state.rows.drop("moved"), state.centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Sums beyond 64 bits are the largest number of 64 bits."""
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    long = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("bigint")
    sums = assigned.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum"))
    total = sums.agg(F.sum("sum").cast("decimal(38,0)").alias("all"))
    known = assigned.sparkSession.createDataFrame(digests, "owner int, centroid_sha256 string")
    small = sums.join(known, "owner").join(F.broadcast(total)).select("owner", long(F.col("sum")).alias("cluster_inertia"), long(F.col("all")).alias("inertia"), "centroid_sha256")
    return assigned.join(F.broadcast(small), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
