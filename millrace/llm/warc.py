"""Writing pages as WARC records, and reading archives back by verifying the chain of record boundaries.

Writing: of pages with equal payloads (SHA-1 and length) of at least ``min_bytes``, the one with the largest id becomes the
response; the others become revisits that refer to it and carry no payload. Only ids and digests are shuffled for that; few
revisits are broadcast to the scan, many are joined by shuffle. Spark's text writer makes the files, in the shared folder.

Reading: Spark's line reader splits the files, and within them splits at every magic ``WARC/1.``, in a payload or not. From
each, a task emits the offset of the candidate record and of its successor, which the record's lengths give. Candidates that
lead to the very next candidate form runs; from run to run, reachability from the file's start is found by pointer jumping,
where each round doubles the jump. What can't be reached is magic inside a payload, and is given back to the payload.

Any archive can be read: records of all types, versions 1.0 and 1.1, ids of any form, plain or as .gz. A record is well formed if it has a type
and a length; the chain ends at one that is not, or that is cut off, and ``unreached`` says how many bytes of each file it has not reached.

Edge cases: null html is an empty payload; a null url is left out; pages with equal ids and payloads are all responses if
theirs is the largest id; a null id is never the largest, and is read back as null; payloads may hold whole WARC records; a
record cut off at a file's end is dropped; an empty table gives no records; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bound_batches, ship_code
from .common import written

MAGIC, HTTP = "WARC/1.0\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:page:"
#: Above so many revisits they are joined by shuffle instead of broadcast.
BROADCAST_REVISITS = 100_000


def base32(hex_digest: Column) -> Column:
    """A hexadecimal SHA-1 in base 32: five hexadecimal digits are four of base 32."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """pages: page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("bigint"))
    ids = rows.where(F.col("n") >= min_bytes).select("page_id", "sha", "n")
    last = ids.groupBy("sha", "n").agg(F.max("page_id").alias("refers_to")).where(F.col("refers_to").isNotNull())
    again = ids.join(last, ["sha", "n"]).where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    again = written(again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to").distinct(), "revisits")
    if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")), "left")
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC), _field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", urn(F.col("page_id"))), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))), _field("X-Payload-Length", F.col("n")),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _field("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        _field("Content-Type", F.lit("application/http;msgtype=response")), _field("Content-Length", F.octet_length("block")),
        F.lit("\r\n"), F.col("block"), F.lit("\r\n\r"),
    )
    # the writer ends each line with the separator, which is the record's last character
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", "\n").text(path)


# ---- reading

SLIM = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("extent", pa.int64()), ("kind", pa.string()),
    ("id", pa.int64()), ("record_id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()), ("found", pa.string()), ("found_bytes", pa.int64()),
])
#: Types of the fields in Spark.
TYPES = {pa.string(): "string", pa.int64(): "bigint"}
SLIM_DDL = ", ".join(f"{f.name} {TYPES[f.type]}" for f in SLIM)
#: What a reader gives of a record, and what it is made of.
OUT = ["id", "record_id", "kind", "digest", "bytes", "refers_to", "refers_to_id"]
MADE = [*OUT, "found", "found_bytes"]
#: The magic that files are split at, and what follows it in a record.
TOKEN, VERSIONS = "WARC/1.", (b"0\r\n", b"1\r\n")


def parse(piece: bytes) -> dict | None:
    """What a candidate says, from the bytes after the token. extent: the record's bytes, the token included. id and refers_to are numbers of
    pages, where the ids are this writer's; record_id and refers_to_id are the ids as they stand, without brackets."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or piece[:3] not in VERSIONS:
        return None
    lines = [line.partition(b":") for line in piece[3:end].split(b"\r\n")]
    fields = {name.strip().lower(): value.strip().decode(errors="replace") for name, colon, value in lines if colon}
    length, kind = fields.get(b"content-length", ""), fields.get(b"warc-type")
    if not (length.isascii() and length.isdigit()) or not kind:
        return None

    def ids(key: bytes) -> tuple[str | None, int | None]:
        text = fields.get(key)
        text = text if text is None else text.removeprefix("<").removesuffix(">")
        own = (text or "").removeprefix(URN) if (text or "").startswith(URN) else ""
        return text, int(own) if re.fullmatch(r"-?[0-9]{1,19}", own) and -(1 << 63) <= int(own) < 1 << 63 else None

    start, n, size = end + 4, int(length), fields.get(b"x-payload-length", "")
    (record_id, page), (refers_to_id, refers_to) = ids(b"warc-record-id"), ids(b"warc-refers-to")
    out = {
        "kind": kind, "id": page, "record_id": record_id, "digest": fields.get(b"warc-payload-digest", fields.get(b"warc-block-digest", "")).removeprefix("sha1:") or None,
        "bytes": int(size) if re.fullmatch(r"[0-9]{1,18}", size) else None, "refers_to": refers_to, "refers_to_id": refers_to_id, "extent": len(TOKEN) + start + n + 4, "found": None, "found_bytes": None,
    }
    if piece[start + n : start + n + 4] == b"\r\n\r\n":
        block = piece[start : start + n]
        http = fields.get(b"content-type", "").lower().startswith("application/http")
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        out |= {"found": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "found_bytes": len(payload)}
    return out


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """file, block, bytes of the block's pieces before, piece."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            piece, key = value.as_py(), (file, block)
            out.append((*key, at.get(key, 0), piece))
            at[key] = at.get(key, 0) + len(piece) + len(TOKEN)
        yield out


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _placed(batches):
        yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "local": at, "size": len(p)} | (parse(p) or {}) for f, b, at, p in rows], SLIM)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _placed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "local", "piece"])


def reachable_runs(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """jumps: file, run, to_run, to_off; starts: file, run, entry. The runs that can be reached, with where each is entered."""
    reached = starts
    while not jumps.isEmpty():
        onward = reached.join(jumps, ["file", "run"]).select("file", F.col("to_run").alias("run"), F.col("to_off").alias("entry"))
        reached = written(reached.unionByName(onward), "reached")
        j = jumps.select("file", F.col("run").alias("to_run"), F.col("to_run").alias("far"), F.col("to_off").alias("far_off"))
        jumps = written(jumps.join(j, ["file", "to_run"]).select("file", "run", F.col("far").alias("to_run"), F.col("far_off").alias("to_off")), "jumps")
    return reached


def _chain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The pieces of the files; all candidates with their offsets (off), written; those of them that the chains reach; each file's bytes."""
    ship_code(spark)
    bound_batches(spark)
    source = spark.read.option("lineSep", TOKEN).text(path)
    source = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    slim = written(source.mapInArrow(_candidates, SLIM_DDL), "candidates")
    # a block's first byte, as a sum over the blocks before it
    blocks = slim.groupBy("file", "block").agg(F.sum(F.col("size") + len(TOKEN)).alias("n"))
    sizes = blocks.groupBy("file").agg((F.sum("n") - len(TOKEN)).alias("file_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # a piece's record starts with the token before it; the first piece of a file has none
    at = slim.join(blocks, ["file", "block"]).withColumn("off", F.col("base") + F.col("local") - len(TOKEN)).where(F.col("off") >= 0).withColumn("next", F.col("off") + F.col("extent"))
    by = Window.partitionBy("file").orderBy("off")
    at = at.withColumn("run", F.sum(F.when(F.lag("next").over(by) == F.col("off"), 0).otherwise(1)).over(by))
    at = written(at, "runs")
    runs = at.groupBy("file", "run").agg(F.max_by("next", "off").alias("exit"), F.max("off").alias("last"), F.min("off").alias("first"))
    landing = at.select("file", F.col("run").alias("to_run"), F.col("off").alias("to_off"))
    jumps = written(runs.join(landing, (runs.file == landing.file) & (F.col("exit") == F.col("to_off"))).select(runs.file, "run", "to_run", "to_off"), "jumps")
    reached = reachable_runs(jumps, runs.where(F.col("first") == 0).select("file", "run", F.col("first").alias("entry")))
    return source, at, at.join(reached, ["file", "run"]).where((F.col("off") >= F.col("entry")) & F.col("kind").isNotNull()), sizes


def unreached(spark: SparkSession, path: str) -> DataFrame:
    """file, file_bytes, unreached_bytes: how much of each file is no record that can be read. 0 for a whole archive."""
    if spark.read.text(path).isEmpty():
        return spark.createDataFrame([], "file string, file_bytes bigint, unreached_bytes bigint")
    _, _, true, sizes = _chain(spark, path)
    read = true.join(sizes, "file").where(F.col("next") <= F.col("file_bytes")).groupBy("file").agg(F.sum("extent").alias("read"))
    return sizes.join(read, "file", "left").select("file", "file_bytes", (F.col("file_bytes") - F.coalesce("read", F.lit(0))).alias("unreached_bytes"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The fields OUT of each record; digest and bytes are of the payload itself where it is there, for revisits what they say. The payload is
    the HTTP body, or of records that hold no HTTP message the whole block."""
    out_ddl, made_ddl = (", ".join(f"{n} {TYPES[SLIM.field(n).type]}" for n in names) for names in (OUT, MADE))
    if spark.read.text(path).isEmpty():
        return spark.createDataFrame([], out_ddl)
    source, at, true, _ = _chain(spark, path)
    by = Window.partitionBy("file").orderBy("off")
    whole = true.where(F.col("found").isNotNull()).select(*MADE)
    torn = true.where(F.col("found").isNull()).select("file", F.col("off").alias("owner"), "extent")
    if not torn.isEmpty():
        # magic inside payloads: their pieces go back to the record that they stand in
        flags = at.select("file", "block", "local", "off").join(true.select("file", "off", F.lit(True).alias("is_record")), ["file", "off"], "left")
        owned = flags.withColumn("owner", F.last(F.when(F.col("is_record"), F.col("off")), ignorenulls=True).over(by))
        needed = owned.join(torn, ["file", "owner"]).select("file", "block", "local", "off", "owner", "extent")
        pieces = source.mapInArrow(_raw, "file string, block bigint, local bigint, piece binary").join(needed, ["file", "block", "local"])
        joined = pieces.groupBy("file", "owner", "extent").agg(F.array_sort(F.collect_list(F.struct("off", "piece"))).alias("pieces"))
        whole = whole.unionByName(joined.select("extent", F.col("pieces.piece").alias("pieces")).mapInArrow(_mended, made_ddl))
    said = F.col("kind") == "revisit"
    return whole.withColumns({"digest": F.when(said, F.col("digest")).otherwise(F.col("found")), "bytes": F.when(said, F.col("bytes")).otherwise(F.col("found_bytes"))}).select(*OUT)


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([SLIM.field(n) for n in MADE])
    for batch in batches:
        found = [parse(TOKEN.encode().join(p.as_py())) for p in batch.column(1)]
        yield pa.RecordBatch.from_pylist([{n: x[n] for n in MADE} for x in found if x and x["found"] is not None], schema)
