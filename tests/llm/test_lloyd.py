"""Delta rounds against rounds that compare everything."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lloyd, queries
from tests.llm.test_operators import CLASHING

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, size, k, rounds, seed, scale=256):
    """Sorted rows of the report, in Python's whole numbers."""
    most = lloyd.bound(size)
    kept = []
    for i, x in rows:
        if x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(min(max(scale * float(np.float32(c)), -most), most)) for c in x]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        owners = [j for _, j in assign()]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners, strict=True) if o == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, sums = assign(), {}
    for d, j in found:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, sums[j], sum(sums.values()), digest[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def ours(df, size, k, rounds, seed, scale=256):
    out = lloyd.report(*lloyd.cluster(lloyd.whole_vectors(df, size, scale), size, k, rounds, seed))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("n", "k", "rounds"), [(300, 7, 5), (40, 40, 2), (5, 9, 3), (120, 3, 0)])
def test_clusters_equal_plain_ones(spark, n, k, rounds):
    draw = random.Random(n)
    rows = [(i, [draw.choice((-1, 1)) * draw.random() * 10 ** draw.randint(-2, 1) for _ in range(6)]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ours(df, 6, k, rounds, 2) == plain(rows, 6, k, rounds, 2)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]), (None, [-0.001, 5.0]), (None, [3.0, 3.0]),
            (9, [3e38, -3e38]), (10, [-3e38, 3e38]), (11, [1.0, 2.0, 3.0]), (12, [0.0, -0.0]), (13, [1e-45, -1e-45])]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in (*CLASHING, "owner", "distance", "moved", "vec", "at", "x", "cluster"):
        df = df.withColumn(c, F.lit("clash"))
    for k in (1, 3, 30):
        assert ours(df.repartition(3), 2, k, 4, 2) == plain(rows, 2, k, 4, 2)


def test_no_vectors(spark):
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None)], SCHEMA)):
        assert ours(df, 64, 40, 5, 2) == []


def test_a_hot_vector_and_ties(spark):
    """Most rows are one vector; centroids that are equal tie, and empty clusters keep theirs."""
    rows = [(i, [0.5, 0.5, 0.5]) for i in range(400)] + [(1000 + i, [i / 7, 0.5, -i / 3]) for i in range(30)]
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(6), 3, 12, 5, 2) == plain(rows, 3, 12, 5, 2)


def test_later_passes_compare_less_and_stop(spark, monkeypatch):
    """Vectors of centroids that stay are compared with the changed ones alone; without a change there is no pass."""
    draw = np.random.default_rng(1)
    centroids, vectors = draw.integers(-50, 50, (9, 4)), draw.integers(-60, 60, (200, 4))
    all_changed, some = np.ones(9, bool), np.arange(9) < 2
    owner, distance = lloyd.nearest(vectors, np.full(200, -1), np.zeros(200, np.int64), centroids, all_changed)
    moved = centroids.copy()
    moved[:2] += 3
    seen = []
    monkeypatch.setattr(lloyd, "distances", lambda v, c, f=lloyd.distances: seen.append(len(v) * len(c)) or f(v, c))
    after = lloyd.nearest(vectors, owner, distance, moved, some)
    full = lloyd.nearest(vectors, np.full(200, -1), np.zeros(200, np.int64), moved, all_changed)
    assert (after[0] == full[0]).all() and (after[1] == full[1]).all()
    assert sum(seen[:-1]) < seen[-1] == 200 * 9
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(50)], SCHEMA)
    state = lloyd.Clusters(lloyd.whole_vectors(df, 2, 256), 2, 2, 0)
    for _ in range(8):
        state.assign()
        state.move()
    assert state.passes <= 3 and state.totals[:, -1].sum() == 50


def test_exact_products_of_large_numbers():
    big = np.array([[(1 << 27) - 1] * 64, [-(1 << 27)] * 64])
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]
    assert lloyd.products(big, big.T).tolist() == exact
    assert lloyd.distances(big[:1], big[1:]).item() == 64 * ((1 << 28) - 1) ** 2


def test_query_has_production_parameters():
    assert (queries.SIZE, queries.SCALE, queries.CLUSTERS, queries.ROUNDS, queries.SEED) == (64, 256, 40, 5, 2)
