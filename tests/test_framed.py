"""Framed files in parts, as streams, and written by streams."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from millrace.sources import framed, sinks
from millrace.sources.framed import EpochWriter, FramedReader, FramedStreamReader, FramedWriter, Written


@pytest.fixture(autouse=True)
def small_steps(monkeypatch):
    monkeypatch.setattr(framed, "INDEX_STEP", 1000)


def frames(*values):
    return b"".join(struct.pack("<I", len(v)) + v for v in values)


def write(path, values):
    writer = FramedWriter(f"file://{path}")
    writer.run = "r"
    import pyspark

    class Context:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": staticmethod(lambda: 0)})

    real = pyspark.TaskContext
    pyspark.TaskContext = Context
    try:
        writer.commit([writer.write(iter([(v,) for v in values]))])
    finally:
        pyspark.TaskContext = real


def test_a_file_is_read_in_parts(tmp_path):
    values = [os.urandom(i % 97) for i in range(2000)]
    write(tmp_path, values)
    for split, least in ((1, 50), (10_000, 8), (1 << 30, 1)):
        reader = FramedReader(f"file://{tmp_path}", split)
        spans = reader.partitions()
        assert len(spans) >= least and [bytes(v) for s in spans for (v,) in reader.read(s)] == [v for v in values if v]
        assert all(s.end is None or s.end == t.start for s, t in zip(spans, spans[1:], strict=False))


def test_a_torn_tail_after_the_index(tmp_path):
    values = [b"x" * 400 for _ in range(20)]
    write(tmp_path, values)
    (name,) = [f for f in os.listdir(tmp_path) if f.endswith(".frames")]
    with open(tmp_path / name, "ab") as f:
        f.write(frames(b"more") + struct.pack("<I", 9) + b"torn")
    reader = FramedReader(f"file://{tmp_path}", 1500)
    assert len(reader.partitions()) > 3 and [bytes(v) for s in reader.partitions() for (v,) in reader.read(s)] == [*values, b"more"]


def test_files_without_index(spark, tmp_path):
    framed.register(spark)
    values = [os.urandom(1 + i % 50) for i in range(500)]
    (tmp_path / "a").write_bytes(frames(*values))
    (tmp_path / "b").write_bytes(frames(*values[:3]) + struct.pack("<I", 5))
    reader = FramedReader(f"file://{tmp_path}", 1)
    assert len(reader.partitions()) == 2
    framed.write_index(spark, f"file://{tmp_path}")
    read = lambda: sorted(bytes(v) for s in reader.partitions() for (v,) in reader.read(s))
    assert read() == sorted([*values, *values[:3]]) and sorted(os.listdir(tmp_path)) == [".a.index", ".b.index", "a", "b"]
    many = spark.read.format("framed").option("splitBytes", 1).load(f"file://{tmp_path}")
    assert many.rdd.getNumPartitions() == len(reader.partitions()) and many.count() == 503


def test_offsets_end_where_frames_end(tmp_path):
    reader = FramedStreamReader(f"file://{tmp_path}", 1 << 20)
    (tmp_path / "a").write_bytes(frames(b"one", b"two") + b"\x05\x00")
    first = reader.latestOffset()
    assert first == {str(tmp_path / "a"): 14}
    take = lambda start, end: [bytes(v) for s in reader.partitions(start, end) for (v,) in reader.read(s)]
    assert take(reader.initialOffset(), first) == [b"one", b"two"]
    with open(tmp_path / "a", "ab") as f:
        f.write(b"\x00\x00three"[:])
    (tmp_path / "b").write_bytes(frames(b"four"))
    again = FramedStreamReader(f"file://{tmp_path}", 1 << 20)
    second = again.latestOffset()
    assert second == {str(tmp_path / "a"): 23, str(tmp_path / "b"): 8} and take(first, second) == [b"three", b"four"] and take(second, second) == []


def test_a_stream_goes_on_at_its_offset_and_writes_each_epoch_once(spark, tmp_path):
    framed.register(spark)
    sinks.register(spark)
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    seen = []
    for run in range(3):
        values = [f"{run}-{i}".encode() for i in range(40)]
        seen += values
        (source / f"f{run}").write_bytes(frames(*values))
        for name, target in (("framed", out), ("raw", tmp_path / "raw")):
            stream = spark.readStream.format("framed").load(f"file://{source}")
            if name == "raw":
                stream = stream.select(F.concat("value", F.lit(b"\n")).alias("value"))
            stream.writeStream.format(name).option("checkpointLocation", f"file://{state}-{name}").trigger(availableNow=True).start(f"file://{target}").awaitTermination()
    assert sorted(bytes(r[0]) for r in spark.read.format("framed").load(f"file://{out}").collect()) == sorted(seen)
    assert sorted(b"".join((tmp_path / "raw" / f).read_bytes() for f in os.listdir(tmp_path / "raw") if f.startswith("epoch-")).splitlines()) == sorted(seen)


def put(folder, name, data):
    (folder / name).write_bytes(data)
    (folder / f".{name}.index").write_bytes(struct.pack("<QQ", 0, len(data)))
    return Written(str(folder / name), 1)


def test_an_epoch_that_comes_again_adds_nothing(tmp_path):
    writer = lambda: EpochWriter(f"file://{tmp_path}", "w", FramedWriter.suffix, FramedWriter.packed, True)
    reader = FramedReader(f"file://{tmp_path}")
    read = lambda: [bytes(v) for s in reader.partitions() for (v,) in reader.read(s)]
    writer().commit([put(tmp_path, "_t1", frames(b"a")), put(tmp_path, "_t2", frames(b"b"))], 0)
    assert read() == [b"a", b"b"]
    writer().commit([put(tmp_path, "_t3", frames(b"a")), put(tmp_path, "_t4", frames(b"b"))], 0)
    assert read() == [b"a", b"b"]
    # a commit that ended before its marker: what it has moved is not read, and the epoch's next commit replaces it
    put(tmp_path, "epoch-w-000000000001-000000.frames", frames(b"half"))
    put(tmp_path, "epoch-w-000000000001-000001.frames", frames(b"other half"))
    assert read() == [b"a", b"b"]
    writer().commit([put(tmp_path, "_t5", frames(b"half"))], 1)
    assert read() == [b"a", b"b", b"half"]
    writer().abort([put(tmp_path, "_t6", frames(b"failed")), None], 2)
    assert read() == [b"a", b"b", b"half"] and not [f for f in os.listdir(tmp_path) if f.lstrip(".").startswith("_t")]
    with pytest.raises(ValueError):
        EpochWriter(f"file://{tmp_path}", "a-b", "x", bytes, False)


def test_a_task_that_fails_adds_nothing(spark, tmp_path):
    """The failed micro-batch leaves no bytes; after a restart it is written once."""
    framed.register(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a").write_bytes(frames(b"1", b"2", b"x"))

    def start(fails):
        stream = spark.readStream.format("framed").load(f"file://{source}").select(F.col("value").cast("string").alias("v"))
        bad = F.raise_error(F.lit("bad record")).cast("string")
        value = F.when(F.col("v") == "x", bad).otherwise(F.col("v")) if fails else F.col("v")
        return stream.select(value.cast("binary").alias("value")).writeStream.format("framed").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{out}")

    with pytest.raises(Exception, match="bad record"):
        start(True).awaitTermination()
    assert not out.exists() or not [f for f in os.listdir(out) if f.startswith("epoch")]
    start(False).awaitTermination()
    assert sorted(bytes(r[0]) for r in spark.read.format("framed").load(f"file://{out}").collect()) == [b"1", b"2", b"x"]
