"""Deterministic sharded WARC writer, and its reader.

Records are range-sorted by page_id into shards, a shard's files are rolled by compressed size, headers and digests are
made anew, and every file is written under a temporary name and then moved. Readers trust the manifest alone, which Spark
commits after the last file: files of lost or repeated tasks are never read. Equal input gives equal files, byte by byte.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096  # resolution of the range sort's histogram: this many rows at most reach the driver
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562's namespace for URLs
MANIFEST = "file string, shard int, records long, bytes long, sha256 string, first_page long, last_page long"


def _records(pages: DataFrame, min_payload: int) -> DataFrame:
    """page_id, url, payload, content (the payload's sha256) of every row, and ahead of the rows that are revisits one marker
    per (page_id, content), with refers_to: the smallest page_id with an equal payload. Only markers pass the join by
    content; payloads move once, to their shard."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("content", F.sha2("payload", 256))
    keys = base.filter(F.length("payload") >= min_payload).select("page_id", "content")
    first = keys.groupBy("content").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.filter("copies > 1 and first is not null").select("content", "first")
    marks = keys.join(first, "content").filter(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy("page_id", "content").agg(F.min("first").alias("refers_to"))
    return base.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)


def _sharded(records: DataFrame, sizes: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Add the shard: consecutive ranges of page_id of about equal bytes; null ids come last. A range heavier than a shard
    (one id on very many rows) is cut further by content, so no shard holds more than its share."""
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    low, step = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    bucket = F.coalesce(F.floor((F.col("page_id") - low) / step).cast("int"), F.lit(BUCKETS))
    weights = sorted((r["b"], r["w"]) for r in sizes.groupBy(bucket.alias("b")).agg(F.sum(F.col("n") + 400).alias("w")).collect())
    plan, at, filled = [], 0, 0
    for b, w in weights:
        cuts = max(1, -(-w // (2 * shard_bytes)))
        if filled and filled + w / cuts > shard_bytes:
            at, filled = at + 1, 0
        plan.append((b, at, int(cuts)))
        at, filled = at + int(cuts) - 1, filled + w if cuts == 1 else w / cuts
    layout = records.sparkSession.createDataFrame(plan or [(0, 0, 1)], "b int, at int, cuts int")
    part = F.floor(F.conv(F.substring("content", 1, 7), 16, 10).cast("long") * F.col("cuts") / F.lit(1 << 28)).cast("int")
    return records.withColumn("b", bucket).join(layout, "b").withColumn("shard", F.col("at") + part).drop("b", "at", "cuts"), at + 1


def record_id(page_id: int | None, url: str | None, content: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {content}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, content: str, refers_to: int | None, date: str) -> bytes:
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url, content)), ("WARC-Date", date),
            ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()),
            ("X-Payload-Length", str(len(payload))), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


class _File:
    """One archive file: gzip members, one per record, under a temporary name until it is complete."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, part: int):
        self.store, self.name, self.shard = store, f"shard-{shard:06d}-{part:04d}.warc.gz", shard
        self.final, self.temp = posixpath.join(root, self.name), posixpath.join(root, "_temporary", f"{self.name}.{uuid.uuid4().hex}")
        store.create_dir(posixpath.dirname(self.temp), recursive=True)
        self.out, self.sha, self.size, self.records, self.first, self.last = store.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0, None, None

    def add(self, page_id: int | None, record: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records, self.last = self.size + len(member), self.records + 1, page_id
        self.first = page_id if self.records == 1 else self.first

    def close(self) -> dict:
        self.out.close()
        self.store.move(self.temp, self.final)
        return {"file": self.name, "shard": self.shard, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest(), "first_page": self.first, "last_page": self.last}


def write_archive(pages: DataFrame, folder: str, min_payload: int = 0, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20,
                  date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored) below ``folder``, which all
    executors share; return the committed manifest.

    Null html is an empty payload; a null url an empty URI. Of rows with equal payloads of at least ``min_payload`` bytes,
    those with the smallest page_id are responses and the rest revisits; rows without page_id come last and are revisits if
    any other row has the payload. Repeated rows (same page_id and payload) are all kept. Empty table: no file.
    """
    records = _records(pages, min_payload)
    sizes = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    records, shards = _sharded(records, sizes, shard_bytes)
    arrow = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()),
                       ("first_page", pa.int64()), ("last_page", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        file, part, mark = None, 0, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["refers_to"] is not None:
                    mark = r
                    continue
                refers_to = mark["refers_to"] if mark and (mark["page_id"], mark["content"]) == (r["page_id"], r["content"]) else None
                if file is not None and (file.shard != r["shard"] or file.size >= file_bytes):
                    part = part + 1 if file.shard == r["shard"] else 0
                    yield pa.RecordBatch.from_pylist([file.close()], schema=arrow)
                    file = None
                if file is None:
                    file = _File(store, root, r["shard"], part)
                file.add(r["page_id"], warc_record(r["page_id"], r["url"], r["payload"], r["content"], refers_to, date))
        if file is not None:
            yield pa.RecordBatch.from_pylist([file.close()], schema=arrow)

    ordered = records.repartition(shards, "shard").sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_last(), "content", F.col("refers_to").asc_nulls_last(), F.col("url").asc_nulls_last())
    made = ordered.select("shard", "page_id", "url", "payload", "content", "refers_to").mapInArrow(run, MANIFEST)
    made.write.json(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).json(f"{folder}/_manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line.strip():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := stream.readline()).strip():
                key, _, value = line.decode().partition(":")
                head[key.lower()] = value.strip()
            yield head, stream.read(int(head["content-length"]))


def read_archive(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's files; a response's
    payload is checked against its header."""
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows = []
                with store.open_input_stream(posixpath.join(root, name), compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse_records(stream):
                        sha = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(block).digest()).decode() != sha or len(block) != int(head["x-payload-length"])):
                            raise ValueError(f"digest of {head['warc-record-id']} differs")
                        refers = head.get("x-refers-to-page")
                        rows.append({"page_id": int(head["x-page-id"]) if head["x-page-id"] else None, "payload_bytes": int(head["x-payload-length"]),
                                     "payload_digest": sha, "record_type": head["warc-type"], "refers_to": int(refers) if refers else None})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # a file for each task, dealt out by name
    return manifest.select("file").repartition(F.col("file")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
