"""Streams that remember, over several runs from one checkpoint: each run is a restart."""

import time
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import cube
from millrace.operators.spec import CubeSpec, Dimension, Measure
from millrace.streaming import stateful

SPEC = CubeSpec("hits", (Dimension("ts", "time"), Dimension("kind")), (Measure("n"),))


class Feed:
    """A folder that a stream reads, and runs of the stream that each take all that is new."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.runs = spark, path, schema, 0

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"file://{self.path}/in")

    def run(self, make, mode="append", timers=False):
        """Rows of this run alone, as dicts with the micro-batch."""
        out, self.runs = [], self.runs + 1
        stream = self.spark.readStream.schema(self.schema).parquet(f"file://{self.path}/in")
        writer = make(stream).writeStream.foreachBatch(lambda b, i: out.extend(r.asDict() for r in b.collect()))
        writer = writer.option("checkpointLocation", f"file://{self.path}/state").outputMode(mode).trigger(availableNow=True)
        if timers:
            with stateful.data_batches_only(self.spark):
                query = writer.start()
        else:
            query = writer.start()
        query.awaitTermination()
        return out


def test_each_partition_closes_once_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts bigint, kind string")
    make = lambda s: stateful.closed_partitions(s, SPEC, {"n": 1}, 10)
    every, closed = [], []
    for part in ([(1, "a"), (2, "a"), (7, "b"), (12, "a")], [(13, None), (19, "b"), (19, None)], [(31, "a"), (24, "c")], [(45, "z"), (33, "y")]):
        feed.put(*part)
        every += part
        closed += feed.run(make)
    assert max(Counter((r["part_start"], r["ts"], r["kind"]) for r in closed).values()) == 1
    batch = cube.time_partitioned(spark.createDataFrame(every, feed.schema), SPEC, {"n": 1}, 10)
    assert sorted(closed, key=str) == sorted((r.asDict() for r in cube.closed(batch).collect()), key=str)
    assert feed.run(make) == []


def test_a_delay_keeps_partitions_open(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts bigint, kind string")
    make = lambda s: stateful.closed_partitions(s, SPEC, {"n": F.lit(3)}, 10, "10 seconds")
    feed.put((5, "a"), (21, "a"))
    assert [(r["part_start"], r["n"]) for r in feed.run(make)] == [(0, 3)]
    feed.put((12, "b"), (35, "a"))
    assert sorted((r["part_start"], r["ts"], r["n"]) for r in feed.run(make)) == [(10, 12, 3)]


def test_late_rows_go_to_their_own_output(spark, tmp_path):
    feed = Feed(spark, tmp_path, "ts timestamp_ntz, kind string")
    second = lambda s: pd.Timestamp(s, unit="s").to_pydatetime()
    make = lambda s: stateful.closed_and_late(s, SPEC, {"n": 1}, 10)
    seen = []
    for part in ([(1, "a"), (25, "a")], [(2, "a"), (3, "b"), (26, "a"), (2, "a")], [(40, "a"), (19, "a")], [(27, "a")]):
        feed.put(*[(second(s), k) for s, k in part])
        seen.append(sorted((r["part_start"], r["ts"], r["kind"], r["n"], r["late"]) for r in feed.run(make)))
    assert seen[0] == [(0, 1, "a", 1, False)]
    assert seen[1] == [(0, 2, "a", 2, True), (0, 3, "b", 1, True)]
    assert seen[2] == [(10, 19, "a", 1, True), (20, 25, "a", 1, False), (20, 26, "a", 1, False)]
    assert seen[3] == [(20, 27, "a", 1, True)]
    got = {True: [], False: []}
    query = stateful.split_writer(make(spark.readStream.schema(feed.schema).parquet(f"file://{tmp_path}/in")), lambda b, i: got[False].extend(b.collect()), lambda b, i: got[True].extend(b.collect()), f"file://{tmp_path}/other")
    query.trigger(availableNow=True).start().awaitTermination()
    assert not got[True] and sum(r["n"] for r in got[False]) == 8  # in one micro-batch nothing is late


def test_open_seconds_share_their_state(spark, tmp_path):
    """Many partitions of one second, dimensions that are null, numbers beyond a double, and rows without a time: the state has an entry for a
    block of time and key, not for a second, and closed and late rows are those of the batch."""
    spec = CubeSpec("hits", (Dimension("ts", "time"), Dimension("kind"), Dimension("code")), (Measure("n"),))
    feed = Feed(spark, tmp_path, "ts bigint, kind string, code bigint")
    make = lambda s: stateful.closed_and_late(s, spec, {"n": 1}, 1, "500 seconds")
    big = (1 << 60) + 1
    every, out = [], []
    for low in (0, 300, 100, 1200):
        part = [(low + i % 600, "ab"[i % 2], (None, 7, big)[i % 3]) for i in range(1000)] + [(None, "a", 7), (low + 1, None, None)]
        feed.put(*part)
        every += part
        out.append(feed.run(make))
        state = spark.read.format("statestore").option("path", f"file://{tmp_path}/state").option("stateVarName", "open").option("flattenCollectionTypes", True).load()
        assert state.select("key").distinct().count() <= 7
    late = Counter(r["late"] for rows in out for r in rows)
    assert late[True] and late[False]
    newest = max(t for t, *_ in every if t is not None)
    found = Counter()
    for r in (r for rows in out for r in rows):
        assert r["part_start"] == r["ts"]
        found[r["ts"], r["kind"], r["code"]] += r["n"]
    assert found == Counter(r for r in every if r[0] is not None and r[0] + 1 <= newest - 500)


def made(key):
    return (0, 1)


def counted(key, state, rows):
    n = state[0] + len(rows)
    return (n, state[1]), pd.DataFrame({"k": [key[0]], "n": [n]})


def ended(key, state):
    return pd.DataFrame({"k": [key[0]], "n": [-state[0]]})


def test_a_branch_lives_on_over_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, x bigint")
    make = lambda s: stateful.branches(s, ["k"], "n bigint, opened bigint", made, counted, "k string, n bigint")
    totals = Counter()
    for part in (["a", "a", "b"], ["b", None], ["a", "c", None, None]):
        feed.put(*[(k, 1) for k in part])
        totals.update(part)
        out = {}
        for r in feed.run(make, "update"):
            out[r["k"]] = max(r["n"], out.get(r["k"], 0))
        assert out == {k: totals[k] for k in set(part)}


def test_an_idle_branch_ends(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, x bigint")
    make = lambda s: stateful.branches(s, ["k"], "n bigint, opened bigint", made, counted, "k string, n bigint", ended, idle_ms=1)
    feed.put(("a", 1), ("a", 1))
    assert [(r["k"], r["n"]) for r in feed.run(make, "update", timers=True)] == [("a", 2)]
    time.sleep(0.1)
    feed.put(("b", 1))
    assert sorted((r["k"], r["n"]) for r in feed.run(make, "update", timers=True)) == [("a", -2), ("b", 1)]
    feed.put(("a", 1))
    assert ("a", 1) in {(r["k"], r["n"]) for r in feed.run(make, "update", timers=True)}


def test_batches_by_size_time_and_what_a_stop_leaves(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, x bigint, t string")
    slow = lambda s: stateful.batched(s, ["k"], 3, 3_600_000)
    show = lambda out: sorted((r["k"], r["batch"], r["n"], r["why"], sorted(i["x"] for i in r["items"])) for r in out)
    feed.put(*[("a", x, None) for x in range(7)], ("b", 100, "t"))
    first = feed.run(slow, timers=True)
    assert [s[:4] for s in show(first)] == [("a", 0, 3, "size"), ("a", 1, 3, "size")]
    left = [(r["k"], r["x"], r["t"]) for r in stateful.held(spark, f"file://{tmp_path}/state").collect()]
    assert len(left) == 2 and ("b", 100, "t") in left
    feed.put(("a", 7, None), ("a", 8, None), ("b", 101, None))
    second = feed.run(slow, timers=True)
    assert [s[:4] for s in show(second)] == [("a", 2, 3, "size")]
    held = {r["x"] for r in stateful.held(spark, f"file://{tmp_path}/state").collect()}
    assert held == {100, 101}
    assert sorted(i["x"] for r in first + second for i in r["items"]) == list(range(9))


def test_a_batch_goes_on_when_its_time_is_up(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, x bigint")
    make = lambda s: stateful.batched(s, ["k"], 100, 1)
    feed.put(("a", 1), ("a", 2))
    assert feed.run(make, timers=True) == []
    time.sleep(0.1)
    feed.put(("b", 3))
    out = feed.run(make, timers=True)
    assert [(r["k"], r["batch"], r["n"], r["why"], [i["x"] for i in r["items"]]) for r in out] == [("a", 0, 2, "time", [1, 2])]


def test_credit_bounds_what_goes_on_at_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, x bigint")
    make = lambda s: stateful.batched(s, ["k"], 2, 3_600_000, credit=1)
    feed.put(*[("a", x) for x in range(7)])
    runs = [feed.run(make, timers=True)]
    for x in (100, 101, 102):
        time.sleep(0.05)
        feed.put(("z", x))
        runs.append(feed.run(make, timers=True))
    sizes = [[r["n"] for r in run if r["k"] == "a"] for run in runs]
    assert sizes == [[2], [2], [2], []] and [r["batch"] for run in runs for r in run if r["k"] == "a"] == [0, 1, 2]
    assert {r["x"] for r in stateful.held(spark, f"file://{tmp_path}/state").where("k = 'a'").collect()} | {i["x"] for run in runs for r in run if r["k"] == "a" for i in r["items"]} == set(range(7))
    with pytest.raises(ValueError):
        stateful.batched(spark.readStream.schema(feed.schema).parquet(f"file://{tmp_path}/in"), ["k"], 0, 1)


def test_moving_means_go_on_over_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path, "k string, at bigint, n bigint")
    make = lambda s: stateful.moving_mean(s, ["k"], "at", "n", floor=1)
    rows = [(k, i, (i * i + len(k)) % 11) for i in range(12) for k in ("a", "bb")]
    out = []
    for at in (0, 10, 14):
        feed.put(*rows[at : {0: 10, 10: 14, 14: 24}[at]])
        out += feed.run(make, "update")
    expected = {}
    for k, i, n in rows:
        last = [m for key, j, m in rows if key == k and i - 4 <= j <= i]
        expected[k, i] = max(1, sum(last) // len(last))
    assert {(r["k"], r["at"]): r["mean"] for r in out} == expected
