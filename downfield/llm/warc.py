"""WARC archives with an index that is written first and read by coalesced byte ranges.

Records of payloads that occur more than once become one response and revisits. Each
task writes its own archives (one gzip member a record) into the shared folder and
yields one index row a record: file, offset, length, URL and digest. The index is
committed as Parquet; files of lost attempts are in no index and are never read.
Reading sorts the selected index rows by file and offset, joins neighbours into one
byte range up to a size, and splits the bytes at the index's lengths.

A null payload is empty, a null URL has no WARC-Target-URI, a null key has the nil
UUID. If a group of equal payloads has keys and null keys, the null ones are
revisits; if it has null keys only, all are responses. Rows repeated with the largest
key are all responses. An empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from downfield.llm.common import join_skewed, scratch

_SPACE = 0x6466_7761_7263_4000 << 64 | 0x8000_0000_0000_0000  # upper half of record ids
_MASK = (1 << 64) - 1
_INDEX = "file string, offset long, length long, url string, digest string, key long, record_type string"
_READ = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI of the shared folder."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record_id(key: int | None) -> str:
    value = 0 if key is None else (_SPACE & ~_MASK) | (key & _MASK)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def key_of(name: str) -> int | None:
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    low = value & _MASK
    return None if value == 0 else low - (1 << 64) if low >> 63 else low


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names), HTTP head and payload of one record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """(key, url, payload, digest, refers_to): of equal payloads of least bytes or more, all but those with the largest key refer to it."""
    full = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    large = full.where(F.octet_length("payload") >= least).select("key", "digest")
    copies = large.groupBy("digest").agg(F.max("key").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest is not null")
    revisits = join_skewed(large, copies, "digest", "n").where("NOT key <=> largest").distinct()
    # Payloads move by key and digest: copies of one payload spread over all tasks.
    mine = revisits.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("largest").alias("refers_to"))
    return full.join(mine, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left").select("key", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str, max_bytes: int = 256 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of plan_records() to archives in the folder, then the index; returns the index as read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, name, at, rows = TaskContext.get(), None, "", 0, []
        fs, path = open_fs(folder)
        fs.create_dir(posixpath.join(path, "archives"), recursive=True)

        def index() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "length", "url", "digest", "key", "record_type"])

        for b in batches:
            for key, url, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"archives/{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(posixpath.join(path, name), compression=None), 0
                data = gzip.compress(record(key, url, payload, digest, refers, date), 5, mtime=0)
                out.write(data)
                rows.append((name, at, len(data), url, digest, key, "response" if refers is None else "revisit"))
                at += len(data)
                if at >= max_bytes:
                    out.close()
                    yield index()
                    out, rows = None, []
        if out is not None:
            out.close()
            yield index()

    records.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")
    return records.sparkSession.read.schema(_INDEX).parquet(f"{folder}/index")


def read_archives(selected: DataFrame, folder: str, gap: int = 64 << 10, span: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Reads the records of the selected index rows back, by sorted and coalesced byte ranges, and checks their digests."""
    spark = selected.sparkSession
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(max(1, -(-total // task_bytes), min(-(-total // (1 << 20)), 2 * spark.sparkContext.defaultParallelism)))
    sorted_ = selected.select("file", "offset", "length", "url").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)

        def fetch(part: list[tuple[str, int, int, str | None]]) -> pa.RecordBatch:
            first = part[0][1]
            with fs.open_input_file(posixpath.join(path, part[0][0])) as f:
                data = f.read_at(max(o + n for _, o, n, _ in part) - first, first)
            rows = []
            for _, o, n, url in part:
                r = parse(gzip.decompress(data[o - first : o - first + n]))
                h, kind = r["headers"], r["headers"]["warc-type"]
                digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind == "response" and hashlib.sha1(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
                size = len(r["payload"]) if kind == "response" else int(r["http"]["content-length"])
                rows.append((key_of(h["warc-record-id"]), size, digest, kind, key_of(h["warc-refers-to"]) if "warc-refers-to" in h else None, url))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

        part: list[tuple[str, int, int, str | None]] = []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length", "url")), strict=True):
                if part and (x[0] != part[0][0] or x[1] - (part[-1][1] + part[-1][2]) > gap or x[1] + x[2] - part[0][1] > span):
                    yield fetch(part)
                    part = []
                part.append(x)
        if part:
            yield fetch(part)

    return sorted_.mapInArrow(run, _READ)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages as WARC archives; the index and the folder."""
    folder = folder or scratch(pages.sparkSession, "warc")
    return write_archives(plan_records(pages, key, url, payload, least), folder), folder
