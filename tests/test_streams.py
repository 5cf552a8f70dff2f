import os
import socket
import struct

import pytest
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.operators import mapping, routing
from millrace.operators.spec import CubeSpec, Dimension, Measure
from millrace.operators.table import CubeTable
from millrace.sources import framed, memory
from millrace.streaming import pipeline

SPEC = CubeSpec("s", (Dimension("ts", "time"), Dimension("k")), (Measure("n"),))


def test_frames():
    data = b"".join(struct.pack("<I", len(x)) + x for x in (b"abc", b"", b"defgh")) + struct.pack("<I", 9) + b"four"
    for size in (1, 3, 100):
        assert list(codecs.split_frames(iter([data[i : i + size] for i in range(0, len(data), size)]))) == [b"abc", b"defgh"]
    with pytest.raises(ValueError):
        list(codecs.split_frames(iter([b"\x01\x00"])))


def test_framed_source_and_sink(spark, tmp_path):
    framed.register(spark)
    rows = spark.createDataFrame([(os.urandom(i),) for i in range(1, 60)], "value binary").repartition(3)
    rows.write.format("framed").mode("append").save(f"file://{tmp_path}/f")
    back = spark.read.format("framed").load(f"file://{tmp_path}/f")
    assert sorted(bytes(r[0]) for r in back.collect()) == sorted(bytes(r[0]) for r in rows.collect())
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/f").select(F.col("path").alias("file"), "content")
    assert codecs.read_frames(files).count() == 59


def test_large_message(spark, tmp_path):
    framed.register(spark)
    big = os.urandom(1 << 20) * 16
    spark.createDataFrame([(big,)], "value binary").write.format("framed").mode("append").save(f"file://{tmp_path}/f")
    assert bytes(spark.read.format("framed").load(f"file://{tmp_path}/f").first()[0]) == big


def test_datagrams(spark, tmp_path):
    reader = framed.DatagramReader(str(tmp_path / "s"))
    rows, end = reader.read(reader.initialOffset())
    assert list(rows) == []
    sender = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
    for text in (b"x\n\ny\n", b"z"):
        sender.sendto(text, str(tmp_path / "s"))
    rows, end = reader.read({"line": 0})
    assert [r[0] for r in rows] == ["x", "y", "z"] and end == {"line": 3}
    assert [r[0] for r in reader.readBetweenOffsets({"line": 1}, end)] == ["y", "z"]
    reader.commit({"line": 2})
    assert [r[0] for r in reader.readBetweenOffsets({"line": 2}, end)] == ["z"]


def test_u32_refuses_negative_numbers(spark):
    assert bytes(spark.range(1).select(codecs.u32(F.lit(258))).first()[0]) == b"\x02\x01\x00\x00"
    with pytest.raises(Exception, match="unsigned"):
        spark.range(1).select(codecs.u32(F.col("id") - 1)).collect()


def test_json_of_broken_text_is_null(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "s string")
    assert [r[0] for r in df.select(codecs.json_decode(F.col("s"), "k bigint")["k"]).collect()] == [1, None, None]


def test_round_trips_keep_nulls(spark):
    df = spark.createDataFrame([("a" * 1000,), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(codecs.snappy_decode(codecs.snappy_encode(F.col("s").cast("binary"))).cast("string")).collect()] == ["a" * 1000, "", None]
    assert [r[0] for r in df.select(codecs.protobuf_decode(codecs.protobuf_encode("s"))).collect()] == ["a" * 1000, "", None]


def test_memory_buffers(spark):
    b = memory.MemoryBuffer()
    for x in (b"a", None, b"bc"):
        b.write(x)
    assert b.read_next() == b"a" and b.read_next() == b"bc" and b.byte_size() == 3 and len(b) == 3
    with pytest.raises(StopIteration):
        b.read_next()
    b.scan(1)
    assert list(b) == [b"bc"] and b.to_df(spark).count() == 1
    r = memory.ReplayBuffer(bound=3)
    assert [r.add(b"x") for _ in range(3)] == [1, 2, 3]
    with pytest.raises(BufferError):
        r.add(b"y")
    assert r.ack(2) == 2 and r.ack(2) == 0 and r.renumber() == [(1, b"x")]
    with pytest.raises(ValueError):
        r.ack(9)


def test_worker_hooks_run(spark, tmp_path):
    marks = tmp_path / "closed"
    marks.mkdir()

    def close(state):
        (marks / str(id(state))).touch()

    out = mapping.map_workers(spark.range(4, numPartitions=2), lambda: lambda row: [row] * (row["id"] % 2), "id bigint", close=close)
    assert sorted(r[0] for r in out.collect()) == [1, 3] and any(marks.iterdir())


def stream(spark, folder):
    return spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).parquet(folder)


def feed(spark, folder, n):
    rows = [(f"2024-01-01 0{h}:00:0{i}", "ab"[i % 2]) for i in range(6) for h in (n, 0)]
    spark.createDataFrame(rows, "ts string, k string").selectExpr("cast(ts as timestamp) ts", "k").coalesce(1).write.mode("append").parquet(folder)


def test_restart_counts_nothing_twice(spark, tmp_path):
    table = CubeTable(spark, f"file://{tmp_path}/cube", SPEC, 3600)
    folder, state = str(tmp_path / "feed"), str(tmp_path / "state")
    for n in (1, 2):
        feed(spark, folder, n)
        pipeline.cube_writer(stream(spark, folder), table, {"n": 1}, state).trigger(availableNow=True).start().awaitTermination()
    total = table.read().groupBy().sum("n").first()[0]
    assert total == 24 and len(table.partitions()) == 3
    batch = spark.read.parquet(folder)
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(tuple(r) for r in pipeline.batch_delta(batch, table, {"n": 1}).select(*table.read().columns).collect())


def test_soft_stop_drains_and_metrics_count(spark, tmp_path):
    table = CubeTable(spark, f"file://{tmp_path}/cube", SPEC, 3600)
    folder = str(tmp_path / "feed")
    feed(spark, folder, 1)
    metrics = pipeline.Metrics()
    spark.streams.addListener(metrics)
    try:
        query = pipeline.cube_writer(stream(spark, folder), table, {"n": 1}, str(tmp_path / "state")).queryName("drain").start()
        pipeline.soft_stop(query)
        assert table.read().groupBy().sum("n").first()[0] == 12
        for _ in range(50):
            if metrics.report()["rows"].get("drain", 0) >= 12:
                break
            import time

            time.sleep(0.2)
        assert metrics.report()["rows"]["drain"] == 12
    finally:
        spark.streams.removeListener(metrics)


def test_fan_out_writer(spark, tmp_path):
    folder, seen = str(tmp_path / "feed"), []
    feed(spark, folder, 1)
    sinks = [lambda df, i: seen.append(df.count()), lambda df, i: seen.append(df.where("k = 'a'").count())]
    pipeline.fan_out_writer(stream(spark, folder), sinks, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [12, 6]


def test_running_count(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 8)], "b long, n long")
    assert [r["mean"] for r in pipeline.running_count(df, "b", "n").orderBy("b").collect()] == [1, 1, 2, 2, 3, 4, 5]


@pytest.mark.parametrize(("weights", "counts", "parity"), [([50, 50], [50, 50], [50, 0]), ([30, 50], [37, 62], [37, 25]), ([50], [100], [100])])
def test_slots(spark, weights, counts, parity):
    nodes = spark.createDataFrame([(f"n{i}", w) for i, w in enumerate(weights)], "node string, weight int")
    for want, mode in ((counts, False), (parity, True)):
        found = {r["node"]: r["count"] for r in routing.slots(nodes, mode).groupBy("node").count().collect()}
        assert [found.get(f"n{i}", 0) for i in range(len(weights))] == want
    assert routing.slots(nodes).select("slot").distinct().count() == sum(counts)
