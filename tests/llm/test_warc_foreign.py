"""Archives that this package has not written."""

import base64
import gzip
import hashlib

import pytest

from millrace.llm import warc


def record(kind, block, version="1.0", content="application/http;msgtype=response", record_id="<urn:uuid:00000000-0000-4000-8000-000000000001>", **more):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"Content-Type: {content}", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body, head=b"HTTP/1.1 200 OK\r\nX: y"):
    return head + b"\r\n\r\n" + body


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


INSIDE = record("response", http(b"inner"), record_id="<urn:page:77>")
RECORDS = [
    record("warcinfo", b"software: some crawler\r\nformat: WARC File Format 1.0", content="application/warc-fields", record_id="<urn:uuid:info>"),
    record("request", http(b"", b"GET / HTTP/1.1"), content="application/http; msgtype=request", record_id="<urn:uuid:req>"),
    record("response", http(b"\x00\xff binary \r\n\r\n body"), record_id="<urn:uuid:resp>"),
    record("metadata", b"fetchTimeMs: 10", "1.1", content="application/warc-fields", record_id="<urn:uuid:meta>"),
    record("response", http(b"holds " + INSIDE + b" and WARC/1.1\r\n and WARC/1.0\r\n"), "1.1", record_id="<urn:page:5>"),
    record("resource", b"WARC/1.0\r\nWARC-Type: response\r\n", content="text/plain", record_id="urn:uuid:res"),
    record("revisit", http(b""), record_id="<urn:uuid:again>", WARC_Refers_To="<urn:uuid:resp>", WARC_Payload_Digest="sha1:ABC"),
    record("conversion", b"", "1.1", content="text/plain", record_id="<urn:page:x>"),
]
EXPECTED = [
    ("warcinfo", None, "urn:uuid:info", len(b"software: some crawler\r\nformat: WARC File Format 1.0")), ("request", None, "urn:uuid:req", 0), ("response", None, "urn:uuid:resp", len(b"\x00\xff binary \r\n\r\n body")),
    ("metadata", None, "urn:uuid:meta", 15), ("response", 5, "urn:page:5", len(b"holds " + INSIDE + b" and WARC/1.1\r\n and WARC/1.0\r\n")), ("resource", None, "urn:uuid:res", 31), ("revisit", None, "urn:uuid:again", None), ("conversion", None, "urn:page:x", 0),
]


def read(spark, path):
    return [r.asDict() for r in warc.read_archives(spark, f"file://{path}").collect()]


def left(spark, path):
    return {r["file"].rsplit("/", 1)[1]: (r["file_bytes"], r["unreached_bytes"]) for r in warc.unreached(spark, f"file://{path}").collect()}


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("split", ["128m", "300"])
def test_records_of_all_kinds(spark, tmp_path, zipped, split):
    data = b"".join(RECORDS)
    if zipped:  # each record a member of its own, as crawlers write them
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, RECORDS)))
    else:
        (tmp_path / "a.warc").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = read(spark, tmp_path)
        assert sorted(((r["kind"], r["id"], r["record_id"], r["bytes"]) for r in found), key=str) == sorted(EXPECTED, key=str)
        by = {r["record_id"]: r for r in found}
        assert by["urn:uuid:resp"]["digest"] == sha(b"\x00\xff binary \r\n\r\n body") and by["urn:uuid:meta"]["digest"] == sha(b"fetchTimeMs: 10")
        assert by["urn:uuid:again"]["refers_to_id"] == "urn:uuid:resp" and by["urn:uuid:again"]["digest"] == "ABC" and by["urn:uuid:again"]["refers_to"] is None
        assert list(left(spark, tmp_path).values()) == [(len(data), 0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_what_is_not_reached_is_reported(spark, tmp_path):
    whole = b"".join(RECORDS[:3])
    (tmp_path / "torn").write_bytes(whole + RECORDS[4][:-30])
    (tmp_path / "broken").write_bytes(RECORDS[0] + b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n" + RECORDS[2])
    (tmp_path / "late").write_bytes(b"garbage first" + RECORDS[0])
    (tmp_path / "other").write_bytes(RECORDS[0].replace(b"WARC/1.0", b"WARC/2.0", 1) + RECORDS[1])
    (tmp_path / "good").write_bytes(whole)
    assert left(spark, tmp_path) == {
        "torn": (len(whole) + len(RECORDS[4]) - 30, len(RECORDS[4]) - 30), "broken": (len(RECORDS[0]) + 46 + len(RECORDS[2]), 46 + len(RECORDS[2])), "late": (13 + len(RECORDS[0]),) * 2,
        "other": (len(RECORDS[0]) + len(RECORDS[1]),) * 2, "good": (len(whole), 0),
    }
    assert sorted(r["kind"] for r in read(spark, tmp_path)) == sorted(["warcinfo", "request", "response"] * 2 + ["warcinfo"])


def test_own_and_foreign_records_in_one_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i // 2}") for i in range(6)], "page_id bigint, url string, html string")
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/own")
    (own,) = [p for p in (tmp_path / "own").iterdir() if p.name.startswith("part-")]
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "x.warc").write_bytes(RECORDS[0] + own.read_bytes() + RECORDS[3])
    found = read(spark, tmp_path / "both")
    assert len(found) == 8 and sorted(r["id"] for r in found if r["id"] is not None) == list(range(6)) and left(spark, tmp_path / "both")["x.warc"][1] == 0
