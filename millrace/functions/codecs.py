"""Encoders and decoders between rows, text and bytes."""

from __future__ import annotations

import importlib
import io
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_code


def unescape(c: Column) -> Column:
    """Log text with \\x22 for a quote and \\x5C for a backslash; an escape at the very end stays as it is."""
    return F.regexp_replace(F.regexp_replace(c, r"\\x22(?=[\s\S])", '"'), r"\\x5C(?=[\s\S])", r"\\")


def u32(c: Column) -> Column:
    """A number below 2^32 as four little-endian bytes; raises for a negative one."""
    n = c.cast("bigint")
    h = F.lpad(F.hex(F.when((n >= 0) & (n < 1 << 32), n).otherwise(F.raise_error(F.lit("not an unsigned 32-bit number")).cast("bigint"))), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def from_u32(c: Column) -> Column:
    h = F.hex(c)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def frame(payload: Column) -> Column:
    """Length and payload."""
    return F.concat(u32(F.octet_length(payload)), payload)


def multipart(parts: Column) -> Column:
    """One frame for the parts of a message together."""
    return frame(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)))


#: Commands of the reliable transport.
DATA, ACK, CLOSE = 0, 1, 2


def message(command: int, seq: Column, payload: Column) -> Column:
    """A transport message: length of what follows, command, sequence number, payload."""
    return frame(F.concat(u32(F.lit(command)), u32(seq), payload))


def message_fields(c: Column) -> list[Column]:
    """length, command, seq and payload of a transport message."""
    return [from_u32(F.substring(c, 1, 4)).alias("length"), from_u32(F.substring(c, 5, 4)).alias("command"), from_u32(F.substring(c, 9, 4)).alias("seq"), F.substring(c, 13, 1 << 30).alias("payload")]


def split_frames(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Non-empty payloads of length-framed bytes that come in pieces of any size. A payload that is cut off is dropped; a
    header that is cut off is an error."""
    held = bytearray()
    for piece in stream:
        held += piece
        at = 0
        while len(held) - at >= 4:
            (n,) = struct.unpack_from("<I", held, at)
            if len(held) - at - 4 < n:
                break
            if n:
                yield bytes(held[at + 4 : at + 4 + n])
            at += 4 + n
        del held[:at]
    if 0 < len(held) < 4:
        raise ValueError("a frame's header is cut off")


def read_frames(df: DataFrame) -> DataFrame:
    """df: file (string), content (binary), as Spark's binaryFile source gives them. A row for each frame, with its place."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(split_frames(iter([content.as_buffer().to_pybytes()])))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["file", "place", "value"])

    return df.select("file", "content").mapInArrow(run, "file string, place bigint, value binary")


@F.pandas_udf(T.BinaryType())
def snappy_encode(values: pd.Series) -> pd.Series:
    """Raw snappy blocks."""
    codec = pa.Codec("snappy")
    return pd.Series([None if v is None else codec.compress(v, asbytes=True) for v in values])


def _varint(data: bytes) -> int:
    n = shift = 0
    for b in data[:5]:
        n |= (b & 127) << shift
        if not b & 128:
            return n
        shift += 7
    raise ValueError("not a snappy block")


@F.pandas_udf(T.BinaryType())
def snappy_decode(values: pd.Series) -> pd.Series:
    codec = pa.Codec("snappy")
    return pd.Series([None if v is None else codec.decompress(v, decompressed_size=_varint(v), asbytes=True) for v in values])


@F.pandas_udf(T.BinaryType())
def protobuf_encode(values: pd.Series) -> pd.Series:
    """Strings as messages with one string field."""
    from google.protobuf.wrappers_pb2 import StringValue

    return pd.Series([None if v is None else StringValue(value=v).SerializeToString() for v in values])


@F.pandas_udf(T.StringType())
def protobuf_decode(values: pd.Series) -> pd.Series:
    from google.protobuf.wrappers_pb2 import StringValue

    return pd.Series([None if v is None else StringValue.FromString(v).value for v in values])


def protobuf_codec(message: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Encoder and decoder for any message class ("package.module:Class"), between its bytes and its JSON text, in which from_json and
    to_json take over. Unknown fields are an error; null stays null."""

    def cls() -> type:
        module, _, name = message.partition(":")
        return getattr(importlib.import_module(module), name)

    @F.pandas_udf(T.BinaryType())
    def encode(values: pd.Series) -> pd.Series:
        from google.protobuf import json_format

        kind = cls()
        return pd.Series([None if v is None else json_format.Parse(v, kind()).SerializeToString(deterministic=True) for v in values])

    @F.pandas_udf(T.StringType())
    def decode(values: pd.Series) -> pd.Series:
        from google.protobuf import json_format

        kind = cls()
        return pd.Series([None if v is None else json_format.MessageToJson(kind.FromString(v), indent=None, preserving_proto_field_name=True) for v in values])

    return encode, decode


@F.pandas_udf(T.BinaryType())
def binary_encode(values: pd.Series) -> pd.Series:
    """Each value as an Arrow stream of its own."""

    def one(v: object) -> bytes:
        batch, out = pa.RecordBatch.from_pylist([{"v": v}]), io.BytesIO()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return out.getvalue()

    return pd.Series([None if pd.isna(v) else one(v) for v in values])


@F.pandas_udf(T.LongType())
def binary_decode_long(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else pa.ipc.open_stream(v).read_all().column(0)[0].as_py() for v in values], dtype="Int64")


def binary_decode(kind: T.DataType) -> Callable[[Column], Column]:
    """A decoder of binary_encode's bytes to values of this type."""

    @F.pandas_udf(kind)
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else pa.ipc.open_stream(v).read_all().column(0)[0].as_py() for v in values], dtype=object)

    return decode


def json_decode(c: Column, schema: str) -> Column:
    """Null fields where the text is no such object."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def json_encode(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
