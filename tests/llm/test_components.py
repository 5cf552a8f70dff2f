"""Components of odd graphs, in one task and in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import components


@pytest.mark.parametrize("bound", [components.IN_ONE_TASK, 3])
def test_odd_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "IN_ONE_TASK", bound)
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 140)]
    draw.shuffle(chain)
    pairs = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 5), (6, None), (None, None), (-(2**62), 2**62), *chain, *[(1000, 1000 + i) for i in range(1, 30)]]
    df = spark.createDataFrame(pairs, "u bigint, v bigint").withColumn("node", F.lit("clash")).withColumn("m", F.lit(0)).repartition(5)
    out = {r["node"]: r["component"] for r in components.components(df).collect()}
    expected = {1: 1, 2: 1, -(2**62): -(2**62), 2**62: -(2**62)} | {i: 100 for i in range(100, 141)} | {1000 + i: 1000 for i in range(30)}
    assert out == expected
    assert components.components(df.limit(0)).count() == 0 and components.components(df.where("u = v or u is null")).count() == 0
