"""Operator 7: WARC archives of pages, and a reader that salvages what it can of damaged ones.

Writing: of pages with equal payloads the one of the largest page_id is a response record; the others
revisit it. A record is a gzip member of its own, so a damaged byte costs one record. Tasks put members
together to files of FILE_BYTES, or of one larger record, and Spark's text sink writes them to whatever file
system the session has. The sink ends a file with a line separator of its choice: here the zero byte that
ends each member, as the last byte of its length, which is zero below 16 MB; a larger record has an empty
member behind it.

Reading: a file is read record by record, plain or as gzip members, in time that grows with its size. A
record stands when its version line, header of at most HEAD_BYTES, length, end mark and payload digest
check. After a failure the reader looks for the next member or version line at which a whole record checks,
goes on there, and logs the bytes between as a quarantined gap. A file is one value of binaryFile, so one of
2 GB or more can't be read, and a task holds the files it is at and their largest record.

Nulls: a null html is an empty payload; a null page_id is written as `none` and read as null; it is a
response only if all of its payload's ids are null. A null url is left out. Repeated rows give a record each, all
responses if theirs is the largest id. An empty table gives an empty archive and no rows. Very long payloads are
written and read whole. Columns other than page_id, url and html are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.shared import join_hot, map_arrow, shared_dir, stage

FILE_BYTES = 16 << 20
HEAD_BYTES = 1 << 20
#: Bytes that the reader inflates at once.
CHUNK = 1 << 16
LEVEL = 4
CRLF = "\r\n"
END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: A gzip member of nothing.
NOTHING = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digits: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in 40 hex digits: five of them make four characters."""

    def character(i: Column) -> Column:
        chunk = F.conv(F.substring(digits, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(ALPHABET), F.call_function("shiftright", chunk, F.lit(15) - i % 4 * 5).bitwiseAND(F.lit(31)) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), character), "")


def records(pages: DataFrame) -> DataFrame:
    """One row per page: the record's text with its end mark. Copies of one payload are dealt to many tasks."""
    rows = pages.select(F.col("page_id").cast("string").alias("id"), "page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    best = stage(rows.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n_pages")), "warc-digests")
    rows = join_hot(rows, best, "digest", "n_pages", F.struct("page_id", "url"))
    response = F.col("best").isNull() | F.col("page_id").eqNullSafe(F.col("best"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(response, F.col("payload")).otherwise(F.lit("")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), name(F.col("best")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)).alias("record"))


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends in a zero byte."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = deflate.compress(record) + deflate.flush()
    return out if out.endswith(b"\0") else out + NOTHING


def _files(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Whole files of about `most` bytes, each without its last byte."""
    parts, size = [], 0

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["file"])

    for batch in batches:
        for record in batch.column("record"):
            parts.append(member(record.as_py().encode()))
            size += len(parts[-1])
            if size >= most:
                yield whole()
                parts, size = [], 0
    if parts:
        yield whole()


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the archive files, each a row of the sink."""
    files = map_arrow(records(pages), lambda b: _files(b, file_bytes), "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str = field(default="")


class Damaged(ValueError):
    pass


def _record(data: bytes, at: int) -> Record:
    """The plain record that begins at `at`, or Damaged."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head = data.find(END, version.end() - 2, version.end() + HEAD_BYTES)
    if head < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[version.end() : head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise Damaged("header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size) or "warc-type" not in headers:
        raise Damaged("header without type or length")
    start, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != END:
        raise Damaged("no end mark after the block")
    record = Record(at, end + 4, headers, data[start:end])
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(payload(record.block)).digest()).decode():
        raise Damaged("payload digest differs")
    return record


def _one(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at `at`, plain or a gzip member, and where it ends in data."""
    if data[at : at + 3] != MEMBER:
        record = _record(data, at)
        return record, record.end
    inflate, plain, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and end < len(data):
            chunk = data[end : end + CHUNK]
            plain.append(inflate.decompress(chunk))
            end += len(chunk)
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not inflate.eof:
        raise Damaged("gzip member without end")
    end -= len(inflate.unused_data)
    plain = b"".join(plain)
    record = _record(plain, 0)
    if record.end != len(plain):
        raise Damaged("gzip member holds more than a record")
    while data.startswith(NOTHING, end):
        end += len(NOTHING)
    record.start, record.end = at, end
    return record, end


_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive file, in order; together they cover it."""
    at = 0
    while at < len(data):
        try:
            record, end = _one(data, at)
        except Damaged as e:
            start, reason, found = at, str(e), None
            for m in _NEXT.finditer(data, at + 1):
                try:
                    found = _one(data, m.start())
                except Damaged:
                    continue
                at = m.start()
                break
            else:
                at = len(data)
            yield Gap(start, at, reason)
            if not found:
                return
            record, end = found
        yield record
        at = end


def payload(block: bytes) -> bytes:
    return block.partition(END)[2]


def _payload_bytes(block: bytes) -> int:
    size = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", block.partition(END)[0] + b"\r\n")
    return int(size[1]) if size else len(payload(block))


def _id(value: str) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value)
    return None if not found or found[1] == "none" else found[1]


ROWS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = []
            for x in salvage(content.as_py()):
                if isinstance(x, Gap):
                    rows.append((path.as_py(), x.start, x.end, x.reason, None, None, None, None, None, None))
                    continue
                h = x.headers
                whole = h["warc-type"] == "response"
                body = payload(x.block)
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else h.get("warc-payload-digest", "").removeprefix("sha1:")
                rows.append((path.as_py(), x.start, x.end, None, _id(h.get("warc-record-id", "")), h.get("warc-target-uri"), len(body) if whole else _payload_bytes(x.block), digest, h["warc-type"], _id(h.get("warc-refers-to", ""))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ROWS, strict=True)] if rows else [pa.array([], t.type) for t in ROWS], schema=ROWS)


def read(spark, folder: str) -> DataFrame:
    """A row per record or gap of the archive files: path, start, end, gap (a reason, or null), and the record's fields."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return map_arrow(files, _read, "path string, start long, end long, gap string, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    kind = pages.schema["page_id"].dataType
    found = read(spark, folder).filter("gap is null")
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
b AS (SELECT d, max(page_id) AS best FROM p GROUP BY d),
c AS (SELECT unnest(range(32)) AS i)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(p.d, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS INT)) & 31) AS INT) + 1, 1), '' ORDER BY i) FROM c) AS payload_digest,
       CASE WHEN b.best IS NULL OR p.page_id = b.best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.best IS NULL OR p.page_id = b.best THEN NULL ELSE b.best END AS refers_to
FROM p JOIN b ON p.d = b.d
"""
