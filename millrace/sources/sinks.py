"""Sinks: raw concatenation, writers of single objects, printing, the reliable transport; and the transport as a stream source.

``register`` makes the formats ``raw`` and ``transport`` known to a session:

    df.select("value").write.format("raw").save(path)
    spark.readStream.format("transport").option("port", 9000).option("spool", "/data/spool").load()
"""

from __future__ import annotations

import os
import struct
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.types import StructType

from ..functions.codecs import split_frames
from ..session import ship_code
from ..streaming.runner import InFlight
from .framed import EpochWriter, FramedWriter


class RawWriter(FramedWriter):
    """A file for each task: its values one after another, with nothing between them."""

    suffix, indexed = "raw", False

    @staticmethod
    def packed(value: bytes) -> bytes:
        return value


class Raw(DataSource):
    """df.write.format("raw"): values (binary or string) as they are; for streams too, see ``framed.EpochWriter``."""

    @classmethod
    def name(cls) -> str:
        return "raw"

    def schema(self) -> str:
        return "value binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RawWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> EpochWriter:  # noqa: N802
        return EpochWriter(self.options["path"], self.options.get("writer", "stream"), RawWriter.suffix, RawWriter.packed, False)


# ---- objects


class ObjectSink:
    """Hands each row to a writer that make(partition, epoch) builds in the task: an object with write(row) and, if it likes, close(error).

    For writeStream.foreach, and for batches by write_objects. An error of write ends the task, which Spark tries again: a writer
    should know its partition and epoch by then.
    """

    def __init__(self, make: Callable[[int, int], object]) -> None:
        self.make, self.writer = make, None

    def open(self, partition: int, epoch: int) -> bool:
        self.writer = self.make(partition, epoch)
        return True

    def process(self, row: object) -> None:
        self.writer.write(row)

    def close(self, error: BaseException | None) -> None:
        if hasattr(self.writer, "close"):
            self.writer.close(error)


def write_objects(df: DataFrame, make: Callable[[int, int], object]) -> None:
    ship_code(df.sparkSession)

    def run(rows: Iterator) -> None:
        from pyspark import TaskContext

        sink, error = ObjectSink(make), None
        sink.open(TaskContext.get().partitionId(), 0)
        try:
            for row in rows:
                sink.process(row)
        except BaseException as e:
            error = e
            raise
        finally:
            sink.close(error)

    df.foreachPartition(run)


def object_stream(stream: DataFrame, make: Callable[[int, int], object], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreach(ObjectSink(make)).option("checkpointLocation", checkpoint)


# ---- printing


def shown(value: object) -> str:
    """Bytes and strings as text, other things as Python shows them."""
    if isinstance(value, bytes | bytearray):
        return bytes(value).decode(errors="replace")
    return value if isinstance(value, str) else repr(value)


def print_rows(df: DataFrame, say: Callable[[str], None] = print) -> int:
    """A line for each row, columns parted by tabs; rows stream through the driver partition by partition. How many there were."""
    n = 0
    for row in df.toLocalIterator():
        say("\t".join(map(shown, row)))
        n += 1
    return n


def print_stream(stream: DataFrame, say: Callable[[str], None] = print) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(lambda batch, _: print_rows(batch, say))


# ---- completion


class Completed(StreamingQueryListener):
    """Gives back one unit of work for each batch that a query has completed: what feeds it may wait until there is room."""

    def __init__(self, work: InFlight, name: str | None = None) -> None:
        self.work, self.name = work, name

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        if (self.name is None or event.progress.name == self.name) and event.progress.numInputRows:
            self.work.done(min(1, self.work.count))

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


class OnExit(StreamingQueryListener):
    """Calls a hook once, when the query of this id has ended, softly, hard or by an error (which it gets, or None)."""

    def __init__(self, query_id: str, hook: Callable[[str | None], None]) -> None:
        self.query_id, self.hook, self.called, self.lock = query_id, hook, False, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self.lock:
            if str(event.id) != self.query_id or self.called:
                return
            self.called = True
        self.hook(event.exception)


# ---- the reliable transport


def send_rows(df: DataFrame, column: str, address: tuple[str, int]) -> None:
    """Sends a column's values (binary or string) from the tasks, and returns when the receiver has them all.

    At least once: a task that is tried again sends again. Order holds within a partition.
    """
    ship_code(df.sparkSession)

    def run(rows: Iterator) -> None:
        from ..streaming.transport import Sender

        with Sender(address) as sender:
            for (value,) in rows:
                if value is not None:
                    sender.send(value.encode() if isinstance(value, str) else bytes(value))

    df.select(column).foreachPartition(run)


class TransportReader(SimpleDataSourceStreamReader):
    """Messages that senders have sent to a port. Each is appended to the spool file before it is acknowledged, so that a reader that
    starts again after a failure, or a task that reads a batch again, finds it at the same offsets. Empty messages are skipped. What
    has been committed is dropped from memory; the spool stays, to be removed with the query's checkpoint."""

    def __init__(self, host: str, port: int, spool: str) -> None:
        self.host, self.port, self.spool = host, port, spool
        self.receiver, self.held, self.first, self.lock = None, [], 0, None  # the reader itself is sent to another process

    def initialOffset(self) -> dict:  # noqa: N802
        return {"message": 0}

    def _take(self, payload: bytes) -> None:
        if not payload:
            return
        with self.lock:
            self.file.write(struct.pack("<I", len(payload)) + payload)
            self.file.flush()
            os.fsync(self.file.fileno())
            self.held.append(payload)

    def _listen(self) -> None:
        if self.receiver is None:
            from ..streaming.transport import Receiver

            self.held = self._spooled()
            self.lock = threading.Lock()
            self.file = open(self.spool, "ab")  # noqa: SIM115  (open as long as the reader)
            self.receiver = Receiver(self._take, self.host, self.port)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._listen()
        with self.lock:
            new = self.held[start["message"] - self.first :]
        return iter([(x,) for x in new]), {"message": start["message"] + len(new)}

    def _spooled(self) -> list[bytes]:
        if not os.path.exists(self.spool):
            return []
        with open(self.spool, "rb") as old:
            return list(split_frames(iter(lambda: old.read(1 << 20), b"")))

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """Runs in a task if a batch is read again: the spool has it."""
        return iter([(x,) for x in self._spooled()[start["message"] : end["message"]]])

    def commit(self, end: dict) -> None:
        self._listen()
        with self.lock:
            del self.held[: end["message"] - self.first]
            self.first = end["message"]


class Transport(DataSource):
    """spark.readStream.format("transport"): a row (value) for each message. Options host, port, spool (a file in a folder that tasks can read too)."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def schema(self) -> str:
        return "value binary"

    def simpleStreamReader(self, schema: StructType) -> TransportReader:  # noqa: N802
        return TransportReader(self.options.get("host", "127.0.0.1"), int(self.options["port"]), self.options["spool"])


def register(spark: SparkSession) -> None:
    ship_code(spark)
    spark.dataSource.register(Raw)
    spark.dataSource.register(Transport)
