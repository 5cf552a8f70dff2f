"""The transport, the runner, the batcher, sinks and stream sources, and what watches them."""

import json
import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import mapping
from millrace.sources import framed, memory, sinks
from millrace.streaming import runner
from millrace.streaming.transport import Receiver, Sender

# ---- transport


def test_messages_arrive_in_order_and_are_acknowledged():
    got = []
    with Receiver(got.append, window=10) as receiver, Sender(receiver.address, window=10) as sender:
        for i in range(500):
            sender.send(b"m%d" % i)
        sender.flush()
        assert not sender.buffer.held and receiver.acks >= 1
    assert got == [b"m%d" % i for i in range(500)] and sender.connections == 1


def test_connections_that_break_lose_nothing():
    got, draw = [], random.Random(1)
    with Receiver(got.append, window=20, ack_every=0.01) as receiver:
        with Sender(receiver.address, window=20, ack_timeout=1, pause=0.01) as sender:
            for i in range(400):
                sender.send(b"%d" % i)
                if draw.random() < 0.03:
                    receiver.drop_connections()
    assert sender.connections > 1
    first = list(dict.fromkeys(got))  # at least once: some come twice, none out of order
    assert first == [b"%d" % i for i in range(400)]


def test_a_receiver_that_fails_gets_the_message_again():
    got, fail = [], [2]

    def take(payload):
        if payload == b"3" and fail[0]:
            fail[0] -= 1
            raise RuntimeError("not yet")
        got.append(payload)

    with Receiver(take, ack_every=0.01) as receiver:
        with Sender(receiver.address, ack_timeout=1, pause=0.01) as sender:
            for i in range(6):
                sender.send(b"%d" % i)
                time.sleep(0.02)
    assert list(dict.fromkeys(got)) == [b"%d" % i for i in range(6)] and isinstance(receiver.error, RuntimeError)


def test_sender_waits_for_a_receiver_that_comes_late_and_gives_up():
    port = socket.create_server(("127.0.0.1", 0))
    address = port.getsockname()[:2]
    port.close()
    with pytest.raises(OSError):
        Sender(address, retries=2, pause=0.01).send(b"x")
    got, late = [], []
    threading.Timer(0.3, lambda: late.append(Receiver(got.append, *address))).start()
    with Sender(address, retries=100, pause=0.05) as sender:
        sender.send(b"x")
    assert got == [b"x"]
    late[0].stop()


def test_large_messages_and_hard_close():
    got = []
    with Receiver(got.append) as receiver:
        sender = Sender(receiver.address)
        sender.send(bytes(20 << 20))
        sender.flush()
        sender.close(soft=False)
    assert [len(x) for x in got] == [20 << 20]


def test_rows_are_sent_by_tasks_and_read_as_a_stream(spark, tmp_path):
    sinks.register(spark)
    free = socket.create_server(("127.0.0.1", 0))
    port = free.getsockname()[1]
    free.close()
    stream = spark.readStream.format("transport").option("port", port).option("spool", str(tmp_path / "spool")).load()
    query = stream.select(F.col("value").cast("string").alias("v")).writeStream.format("memory").queryName("sent").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            assert query.exception() is None
            try:
                socket.create_connection(("127.0.0.1", port)).close()
                break
            except OSError:
                time.sleep(0.1)
        sinks.send_rows(spark.range(200).select(F.col("id").cast("string").alias("v")).repartition(3), "v", ("127.0.0.1", port))
        while spark.table("sent").count() < 200 and time.time() < deadline:
            time.sleep(0.2)
        assert sorted(int(r["v"]) for r in spark.table("sent").collect()) == list(range(200))
    finally:
        query.stop()


def test_datagrams_through_a_stream(spark, tmp_path):
    framed.register(spark)
    path = str(tmp_path / "socket")
    stream = spark.readStream.format("datagrams").option("socket", path).load()
    query = stream.writeStream.format("memory").queryName("datagrams_seen").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        sending, deadline = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM), time.time() + 60
        while time.time() < deadline:
            try:
                sending.connect(path)
                break
            except OSError:
                time.sleep(0.1)
        for i in range(20):
            sending.send(b"a%d\n\nb%d\n" % (i, i))
        while spark.table("datagrams_seen").count() < 40 and time.time() < deadline:
            time.sleep(0.2)
        assert sorted(r["value"] for r in spark.table("datagrams_seen").collect()) == sorted(x for i in range(20) for x in (f"a{i}", f"b{i}"))
    finally:
        query.stop()


# ---- sinks


def test_raw_writer_puts_nothing_between(spark, tmp_path):
    sinks.register(spark)
    spark.createDataFrame([(b"ab",), (b"",), (b"c\n",)], "value binary").coalesce(1).write.format("raw").mode("append").save(f"file://{tmp_path}/raw")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "raw").iterdir()) if not p.name.startswith((".", "_"))) == b"abc\n"
    with pytest.raises(Exception, match="scheme"):
        spark.createDataFrame([(b"a",)], "value binary").write.format("raw").mode("append").save(str(tmp_path / "bare"))


class _ToFile:
    def __init__(self, folder, partition, epoch):
        self.file = open(f"{folder}/{partition}-{epoch}", "w")  # noqa: SIM115

    def write(self, row):
        if row["id"] < 0:
            raise ValueError("bad row")
        self.file.write(f"{row['id']}\n")

    def close(self, error):
        self.file.write(f"end {error is not None}\n")
        self.file.close()


def test_objects_go_to_writers(spark, tmp_path):
    folder = str(tmp_path)
    sinks.write_objects(spark.range(10).repartition(2), lambda p, e: _ToFile(folder, p, e))
    lines = [x for p in tmp_path.iterdir() for x in p.read_text().split("\n") if x]
    assert sorted(x for x in lines if x.isdigit()) == sorted(map(str, range(10))) and lines.count("end False") == 2
    with pytest.raises(Exception, match="bad row"):
        sinks.write_objects(spark.range(-1, 0), lambda p, e: _ToFile(folder, p, e))


def test_printing():
    assert [sinks.shown(x) for x in (b"ab", "c", 3, None)] == ["ab", "c", "3", "None"]


def test_print_rows_and_tail(spark, tmp_path):
    said = []
    assert sinks.print_rows(spark.createDataFrame([(b"x", 1), (b"y", 2)], "a binary, b int").coalesce(1), said.append) == 2
    assert said == ["x\t1", "y\t2"]
    seen = str(tmp_path / "tail")
    rows = mapping.tail(spark.range(3).coalesce(1), lambda x: open(seen, "a").write(x + "\n"))
    assert rows.count() == 3 and open(seen).read() == "0\n1\n2\n"
    through, observation = mapping.observed(spark.range(7), "seen", most=F.max("id"))
    assert through.count() == 7 and observation.get == {"rows": 7, "most": 6}


def test_exit_hooks_run_once(spark, tmp_path):
    said = []
    assert mapping.with_exit(lambda: spark.range(3).count(), said.append) == 3 and said == [None]
    with pytest.raises(ZeroDivisionError):
        mapping.with_exit(lambda: 1 / 0, said.append)
    assert len(said) == 2 and isinstance(said[1], ZeroDivisionError)
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").start()
    hook = sinks.OnExit(str(query.id), said.append)
    spark.streams.addListener(hook)
    try:
        query.stop()
        deadline = time.time() + 20
        while len(said) < 3 and time.time() < deadline:
            time.sleep(0.1)
        assert said[2:] == [None]
    finally:
        spark.streams.removeListener(hook)


# ---- runner


def test_runner_ends_when_all_parts_have():
    said = []
    run = runner.Runner().add(lambda stop: said.append(1)).add(lambda stop: (time.sleep(0.05), said.append(2))).on_exit(lambda: said.append("end"))
    assert run.start().wait(5) and said == [1, 2, "end"]


def test_first_error_stops_the_others_and_is_kept():
    def fails(stop):
        raise ValueError("first")

    def waits(stop):
        assert stop.wait(5)
        raise KeyError("second")

    run = runner.Runner().add(waits).add(fails).start()
    with pytest.raises(ValueError, match="first"):
        run.wait(5)
    with pytest.raises(RuntimeError):
        run.start()


@pytest.mark.parametrize("soft", [True, False])
def test_runner_stops_streams(spark, tmp_path, soft):
    query = spark.readStream.format("rate").option("rowsPerSecond", 10).load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/state").start()
    run = runner.Runner().add(query).start()
    assert not run.wait(0.2)
    run.soft_stop() if soft else run.hard_stop()
    assert run.wait(60) and not query.isActive


def test_logging_goes_to_a_sink():
    lines = []
    runner.logs_to(lines.append).info("hello %d", 3)
    runner.logs_to(None).info("not heard")
    assert [json.loads(x)["message"] for x in lines] == ["hello 3"]


# ---- batcher


def test_batcher_by_time_size_and_credit():
    now, sent = [0.0], []
    b = runner.Batcher(sent.append, first_wait=1, between=2, clock=lambda: now[0])
    b.add(1)
    b.add(2)
    assert not sent and b.due() == 1
    now[0] = 1.0
    assert b.tick() and sent == [[1, 2]]
    b.add(3)
    now[0] = 9.0
    assert not b.tick() and b.due() is None  # no credit until the receiver is done
    b.done()
    assert sent == [[1, 2], [3]]
    b.done()
    b.add(4)
    now[0] = 10.5
    assert not b.tick()  # the first record has waited, but the last batch went 1.5 seconds ago
    now[0] = 11.0
    assert b.tick() and sent[-1] == [4]
    b.add(5)
    b.close()
    b.close()
    assert sent[-1] == [5] and b.batches == 4 and b.records == 5
    full = runner.Batcher(sent.append, most=2, credit=9, clock=lambda: 0.0)
    full.add(6)
    full.add(7)
    assert sent[-1] == [6, 7]


def test_batches_of_objects():
    assert list(runner.batched(range(5), 2)) == [[0, 1], [2, 3], [4]] and list(runner.batched([], 2)) == []


def test_batches_of_rows(spark):
    from millrace.streaming import pipeline

    rows = spark.range(25).withColumn("x", F.col("id") * 2).repartition(4)
    out = {r["batch"]: r for r in pipeline.batches_of(rows, "id", 10, "x").collect()}
    assert {k: v["n"] for k, v in out.items()} == {0: 10, 1: 10, 2: 5} and [tuple(i) for i in out[2]["items"]] == [(i, 2 * i) for i in range(20, 25)]


def test_work_in_flight():
    work, order = runner.InFlight(), []
    work.notify(2)
    assert not work.wait_below(2, 0.01)
    waiting = threading.Thread(target=lambda: (work.wait_below(1, 5), order.append("room")))
    waiting.start()
    work.done()
    work.done()
    waiting.join(5)
    assert order == ["room"] and work.most == 2
    with pytest.raises(ValueError):
        work.done()


# ---- counters


def test_rates_and_reports(spark):
    now = [0.0]
    rate = runner.Rate("lines", lambda: now[0])
    rate.add(30)
    now[0] = 2.0
    assert rate.per_second() == 15 and rate.line() == "lines: 30 items in 2.0 s, 15.0 a second"
    report = runner.Report("node-1", lambda: now[0])
    report.event("parse", 3)
    report.event("parse", 1, error=True)
    report.merge([("send", 5, 2)])
    now[0] = 4.5
    assert report.say() == {"name": "node-1", "uptime": 2.5, "operators": {"parse": {"events": 4, "errors": 1}, "send": {"events": 5, "errors": 2}}}
    lines, stop = [], threading.Event()
    threading.Timer(0.1, stop.set).start()
    report.every(0.03, lines.append, stop)
    assert len(lines) >= 2 and json.loads(lines[-1])["name"] == "node-1"


def test_acknowledgements_are_counted_as_the_buffer_does(spark):
    draw = random.Random(3)
    seqs = sorted(draw.sample(range(1, 100), 20))
    buffer = memory.ReplayBuffer()
    for _ in range(100):
        buffer.add(b"x")
    expected = [buffer.ack(s) for s in seqs]
    rows = spark.createDataFrame([("a", s) for s in seqs] + [("b", 7)], "sender string, seq bigint").repartition(3)
    out = memory.acknowledged(rows, "sender", "seq").orderBy("sender", "seq").collect()
    assert [r["newly_acked"] for r in out] == [*expected, 7]


def test_memory_of_tasks(spark):
    rows = spark.createDataFrame([("ab",), (None,), ("é",)], "v string")
    assert tuple(memory.stats(rows, "v").first()) == (3, 4) and tuple(memory.stats(rows.limit(0), "v").first()) == (0, 0)
    assert [tuple(r) for r in memory.objects(spark, [(1,), None, (2,)], "a int").collect()] == [(1,), (2,)]
