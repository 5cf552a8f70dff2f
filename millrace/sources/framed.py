"""Spark data sources in Python: length-framed files, datagram sockets and memory."""

from __future__ import annotations

import os
import re
import socket
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codecs import split_frames


def _place(uri: str):  # noqa: ANN202
    from pyarrow import fs

    if not re.match(r"\w+:/", uri):
        raise ValueError(f"{uri} has no scheme: executors would read and write their own disks; say file:// if that is meant")
    return fs.FileSystem.from_uri(uri)


#: A writer notes where a frame begins about every so many bytes; a task of a reader gets about so many.
INDEX_STEP, SPLIT = 1 << 20, 64 << 20


def _index_name(path: str) -> str:
    """The index of a data file lies beside it, under a name that readers of data pass over."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.index"


def _index(place, path: str) -> list[int]:  # noqa: ANN001
    """Where frames begin, about every INDEX_STEP bytes, and where the last whole one ends; empty if there is no index."""
    try:
        with place.open_input_stream(_index_name(path)) as stream:
            data = stream.read()
    except FileNotFoundError:
        return []
    return [x for (x,) in struct.iter_unpack("<Q", data)]


def _hop(stream, start: int, size: int) -> Iterator[int]:  # noqa: ANN001
    """Where each whole frame from start on ends, by reading heads alone."""
    at = start
    while at + 4 <= size:
        stream.seek(at)
        (n,) = struct.unpack("<I", stream.read(4))
        if at + 4 + n > size:
            return
        at += 4 + n
        yield at


class Span(InputPartition):
    """Bytes of a file that begin with a frame. end: None for all that follow."""

    def __init__(self, path: str, start: int, end: int | None) -> None:
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


def _data_files(place, path: str) -> list:  # noqa: ANN001
    """Files with data, in order of their names. Those of an epoch of a stream count when the epoch has been committed."""
    from pyarrow import fs

    if place.get_file_info(path).type != fs.FileType.Directory:
        return [place.get_file_info(path)]
    files = [f for f in place.get_file_info(fs.FileSelector(path)) if f.is_file]
    done = {f.base_name.removeprefix("_committed-") for f in files if f.base_name.startswith("_committed-")}
    seen = [f for f in files if not f.base_name.startswith(("_", "."))]
    return sorted((f for f in seen if not f.base_name.startswith("epoch-") or f.base_name.rpartition("-")[0] in done), key=lambda f: f.path)


def _spans(place, path: str, start: int, end: int | None, split: int) -> list[Span]:  # noqa: ANN001
    """The bytes from start to end, cut where the index knows that a frame begins."""
    cuts, at = [start], start
    for offset in _index(place, path)[:-1]:
        if offset - at >= split and (end is None or offset < end):
            cuts.append(offset)
            at = offset
    return [Span(path, a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True)]


def _frames(uri: str, span: Span) -> Iterator[tuple]:
    """Frames that begin in the span, read in pieces of a megabyte. Beyond a given end nothing is read; without one, a frame that is cut
    off at the file's end is dropped, and a head that is cut off is an error."""
    place, _ = _place(uri)
    with place.open_input_file(span.path) as stream:
        stream.seek(span.start)
        left = None if span.end is None else span.end - span.start

        def pieces() -> Iterator[bytes]:
            nonlocal left
            while left is None or left > 0:
                data = stream.read(1 << 20 if left is None else min(1 << 20, left))
                if not data:
                    return
                left = left if left is None else left - len(data)
                yield data

        for value in split_frames(pieces()):
            yield (value,)


class FramedReader(DataSourceReader):
    """Tasks of about split bytes of a file, if it has an index, else a task for each file."""

    def __init__(self, path: str, split: int = SPLIT) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Span]:
        place, path = _place(self.path)
        return [span for f in _data_files(place, path) for span in _spans(place, f.path, 0, None, self.split)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _frames(self.path, partition)


class FramedStreamReader(DataSourceStreamReader):
    """A stream of the frames of a folder's files. Its offset is how much of each file has been read: up to the end of a frame.

    Files may be added and may grow. A file with an index is taken as it says; of others the driver reads the heads of new frames.
    """

    def __init__(self, path: str, split: int = SPLIT) -> None:
        self.path, self.split, self.known = path, split, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        place, path = _place(self.path)
        for f in _data_files(place, path):
            at = self.known.get(f.path, 0)
            if f.size > at:
                index = _index(place, f.path)
                if index and index[-1] > at:
                    at = index[-1]
                with place.open_input_file(f.path) as stream:
                    for at in _hop(stream, at, f.size):  # noqa: B007
                        pass
                self.known[f.path] = at
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        place, _ = _place(self.path)
        return [span for path, stop in sorted(end.items()) if stop > start.get(path, 0) for span in _spans(place, path, start.get(path, 0), stop, self.split)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return _frames(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class FramedWriter(DataSourceWriter):
    """A file for each task, with its index, in place only when the whole write has succeeded."""

    suffix, indexed = "frames", True

    @staticmethod
    def packed(value: bytes) -> bytes:
        return struct.pack("<I", len(value)) + value

    def __init__(self, path: str) -> None:
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        place, folder = _place(self.path)
        place.create_dir(folder, recursive=True)
        path, n, at, index = f"{folder}/_{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}", 0, 0, [0]
        with place.open_output_stream(path) as out:
            for row in rows:
                data = self.packed(row[0].encode() if isinstance(row[0], str) else bytes(row[0]))
                out.write(data)
                n, at = n + 1, at + len(data)
                if at - index[-1] >= INDEX_STEP:
                    index.append(at)
        if self.indexed:
            with place.open_output_stream(_index_name(path)) as out:
                out.write(b"".join(struct.pack("<Q", x) for x in (*index, at)))
        return Written(path, n)

    def _move(self, message: Written, name: str) -> None:
        place, _ = _place(self.path)
        to = f"{message.path.rpartition('/')[0]}/{name}.{self.suffix}"
        if self.indexed:
            place.move(_index_name(message.path), _index_name(to))
        place.move(message.path, to)

    def _drop(self, messages: list[Written | None]) -> None:
        place, _ = _place(self.path)
        for m in messages:
            for path in (m.path, _index_name(m.path)) if m else ():
                try:
                    place.delete_file(path)
                except FileNotFoundError:
                    pass

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                self._move(m, f"part-{m.path.rpartition('/')[2].split('-')[1]}-{self.run}")

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)


class EpochWriter(FramedWriter, DataSourceStreamWriter):
    """The same for a stream: the files of an epoch count when its marker is there, which names the writer and the epoch. An epoch that comes
    again after its marker was written adds nothing; before that, what it left behind is replaced."""

    def __init__(self, path: str, writer: str, suffix: str, packed: Callable[[bytes], bytes], indexed: bool) -> None:
        super().__init__(path)
        if not re.fullmatch(r"[A-Za-z0-9_]+", writer):
            raise ValueError(f"a writer's name has letters, digits and _ only: {writer}")
        self.writer, self.suffix, self.packed, self.indexed = writer, suffix, packed, indexed

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        place, folder = _place(self.path)
        place.create_dir(folder, recursive=True)
        epoch = f"epoch-{self.writer}-{batchId:012d}"
        files = [f for f in place.get_file_info(fs.FileSelector(folder)) if f.is_file]
        if any(f.base_name == f"_committed-{epoch}" for f in files):
            self._drop(messages)
            return
        for f in files:
            if f.base_name.removeprefix(".").startswith(f"{epoch}-"):
                place.delete_file(f.path)
        for i, m in enumerate(m for m in messages if m and m.rows):
            self._move(m, f"{epoch}-{i:06d}")
        self._drop([m for m in messages if m and not m.rows])
        with place.open_output_stream(f"{folder}/_committed-{epoch}") as out:
            out.write(b"")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class Framed(DataSource):
    """spark.read.format("framed").load(path): a row (value) for each frame; df.write.format("framed"); and both for streams.

    Options: splitBytes, about how much of a file a task reads; writer, the name under which a stream's epochs are known in the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "value binary"

    def reader(self, schema: StructType) -> FramedReader:
        return FramedReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def streamReader(self, schema: StructType) -> FramedStreamReader:  # noqa: N802
        return FramedStreamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> FramedWriter:
        return FramedWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> EpochWriter:  # noqa: N802
        return EpochWriter(self.options["path"], self.options.get("writer", "stream"), FramedWriter.suffix, FramedWriter.packed, True)


def write_index(spark: SparkSession, path: str) -> None:
    """Writes the index of files that have none, a task for each: it reads the heads of the frames and passes over the rest."""
    from ..session import ship_code

    ship_code(spark)
    place, folder = _place(path)
    missing = [(f.path,) for f in _data_files(place, folder) if not _index(place, f.path)]

    def run(rows: Iterator) -> None:
        there, _ = _place(path)
        for row in rows:
            index, at = [0], 0
            with there.open_input_file(row[0]) as stream:
                for at in _hop(stream, 0, stream.size()):
                    if at - index[-1] >= INDEX_STEP:
                        index.append(at)
            with there.open_output_stream(_index_name(row[0])) as out:
                out.write(b"".join(struct.pack("<Q", x) for x in (*index, at)))

    if missing:
        spark.createDataFrame(missing, "path string").repartition(len(missing)).foreachPartition(run)


#: Bytes that are read of a datagram.
DATAGRAM = 4092


class DatagramReader(SimpleDataSourceStreamReader):
    """Lines of datagrams at a Unix socket. What has been read stays until it is committed, so a batch can be read again."""

    def __init__(self, path: str) -> None:
        self.path, self.socket, self.lines, self.first = path, None, [], 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def _listen(self) -> socket.socket:
        if self.socket is None:
            if os.path.exists(self.path):
                os.unlink(self.path)
            self.socket = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
            self.socket.bind(self.path)
            self.socket.setblocking(False)
        return self.socket

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        listening = self._listen()
        while True:
            try:
                self.lines += [x for x in listening.recv(DATAGRAM).split(b"\n") if x]
            except BlockingIOError:
                break
        new = self.lines[start["line"] - self.first :]
        return iter([(x.decode(errors="replace"),) for x in new]), {"line": start["line"] + len(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(x.decode(errors="replace"),) for x in self.lines[start["line"] - self.first : end["line"] - self.first]])

    def commit(self, end: dict) -> None:
        del self.lines[: end["line"] - self.first]
        self.first = end["line"]


class Datagrams(DataSource):
    """spark.readStream.format("datagrams").option("socket", path): a row (value) for each line; unescape it with codecs.unescape."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> DatagramReader:  # noqa: N802
        return DatagramReader(self.options["socket"])


def register(spark: SparkSession) -> None:
    """Makes the formats framed and datagrams known to the session."""
    from ..session import ship_code

    ship_code(spark)
    spark.dataSource.register(Framed)
    spark.dataSource.register(Datagrams)
