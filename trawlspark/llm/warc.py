"""WARC records as a table of chunks.

A page becomes one WARC/1.1 record. An archive is a Parquet table with a row for each chunk of at most
`chunk` bytes: record (unique in the archive), chunk_no, last, digest (SHA-1 of the record's payload up to and
with this chunk) and body. The bodies of a record in order of chunk_no are its bytes; those of records
one after the other are a WARC file. Chunks are slices of the Arrow buffer of a batch, so a payload is
never copied as a whole, and writing holds one chunk beside the batch.

Pages with equal payloads: the one with the largest page_id is the response, the others are revisit
records without a payload, which name the response and the payload's digest. Digests are made by the
JVM; the group of a digest is a maximum with map-side combination, and the join back on the digest is
one that AQE splits when a payload is very frequent.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship

CHUNK = 256 * 1024
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SCHEMA = "record string, chunk_no int, last boolean, digest string, body binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode("ascii")


def _field(text: str, marks: str = "") -> str:
    """A header value on one line: control characters, and those of marks, are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" and c not in marks else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _id_field(page: str) -> str:
    """An id in a header; _read_id gives it back."""
    return _field(page, "% <>")


def _read_id(value: str | None) -> str | None:
    return None if value is None else unquote(value, errors="surrogatepass")


def header(page: str | None, kind: str, uri: str | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """WARC header, and the HTTP header that belongs to the record's block."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_id_field(page or '')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_field(uri or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        lines.append(f"X-Page-ID: {_id_field(page)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{_id_field(refers_to or '')}>")
        lines.append("WARC-Truncated: length")
    lines.append(f"Content-Length: {len(_HTTP) + size}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + _HTTP


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with digest (hex), payload_bytes, kind and refers_to.

    A null html is an empty payload. Payloads below `least` bytes are all responses. Rows that repeat
    the winning page_id are responses too. A null page_id revisits any other page with its payload; if
    there is none, it is a response.
    """
    page = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "payload_bytes": F.octet_length("html").cast("long")})
    best = page.groupBy("digest").agg(F.max("page_id").alias("winner"))
    found = page.join(best, "digest")
    revisit = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return found.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("winner"))
    )


def write_archive(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write the records of pages as a chunk table to the folder `path`."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, written_before = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            ids, urls, digests, kinds, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i in range(batch.num_rows):
                record, written_before = f"{task}-{written_before}", written_before + 1
                payload = memoryview(batch.column(2)[i].as_buffer() or b"").cast("B")
                digest = base32(bytes.fromhex(digests[i]))
                size = 0 if kinds[i] == "revisit" else len(payload)
                lead = header(ids[i], kinds[i], urls[i], digest, size, refers[i])
                running, sent, number = hashlib.sha1(), 0, 0
                while True:
                    part = payload[sent : min(sent + chunk, size)]
                    running.update(part)
                    sent += len(part)
                    last = sent >= size
                    body = b"".join((lead if number == 0 else b"", part, b"\r\n\r\n" if last else b""))
                    rows.append((record, number, last, base32(running.digest()), body))
                    held += len(body)
                    number += 1
                    if held > 4 * 1024 * 1024:
                        yield _batch(rows)
                        rows, held = [], 0
                    if last:
                        break
            if rows:
                yield _batch(rows)

    page = records(pages, least).select(
        F.col("page_id").cast("string"), "url", "html", "digest", "kind", F.col("refers_to").cast("string")
    )
    page.mapInArrow(run, _SCHEMA).write.parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["record", "chunk_no", "last", "digest", "body"])


class _Reader:
    """One record, fed chunk by chunk: header fields, and size and digest of the payload so far."""

    def __init__(self) -> None:
        self.head = b""
        self.fields: dict[str, str] | None = None
        self.left = self.size = 0
        self.sha1 = hashlib.sha1()

    def feed(self, body: bytes) -> None:
        if self.fields is None:
            self.head += body
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            lines = self.head[:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            http = self.head.find(b"\r\n\r\n", end + 4)
            if http < 0:
                return
            self.fields, body = fields, self.head[http + 4 :]
            self.left = int(fields["Content-Length"]) - (http + 4 - (end + 4))
            self.head = b""
        part = body[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.sha1.update(part)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page, record_type, refers_to, payload_digest, payload_bytes) of the archive's records.

    Size and digest are made anew from the payload bytes; a response whose digest differs from its
    header's, or that is cut off, raises an error. Records of one chunk are read in place; only the
    chunks of longer ones are shuffled and sorted by record and number, and streamed.
    """
    table = ship(spark).read.schema(_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        expected = 0
        for batch in batches:
            out = []
            record, number, last, running = (batch.column(i).to_pylist() for i in range(4))
            for i in range(batch.num_rows):
                if number[i] != expected:
                    raise ValueError(f"record {record[i]}: chunk {expected} is missing")
                reader.feed(batch.column(4)[i].as_py())
                digest = base32(reader.sha1.digest())
                if digest != running[i]:
                    raise ValueError(f"record {record[i]}: chunk {number[i]} is damaged")
                expected += 1
                if last[i]:
                    fields = reader.fields or {}
                    kind, stated = fields.get("WARC-Type"), fields.get("WARC-Payload-Digest", "")[5:]
                    if reader.left or kind == "response" and digest != stated:
                        raise ValueError(f"record {record[i]} is damaged")
                    refers = fields.get("WARC-Refers-To")
                    out.append((_read_id(fields.get("X-Page-ID")), kind, _read_id(refers and refers[len("<urn:page:") : -1]), stated, reader.size))
                    reader, expected = _Reader(), 0
            names = ["page", "record_type", "refers_to", "payload_digest", "payload_bytes"]
            types = [pa.string()] * 4 + [pa.int64()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "page string, record_type string, refers_to string, payload_digest string, payload_bytes bigint"
    single = (F.col("chunk_no") == 0) & F.col("last")
    long = table.where(~single).repartition("record").sortWithinPartitions("record", "chunk_no")
    return table.where(single).mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))


def round_trip(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from written archives.

    A revisit's size is that of the responses with its digest: the page it refers to may have others.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    write_archive(pages, path, least, chunk)
    read = read_archive(pages.sparkSession, path)
    sizes = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    # only digests of revisits matter; those are few keys, however many pages have them
    again = read.where("record_type = 'revisit'").select("payload_digest").distinct()
    out = read.join(sizes.join(again, "payload_digest", "left_semi"), "payload_digest", "left")
    return out.select(
        F.col("page").cast(kind).alias("page_id"),
        F.coalesce("full", "payload_bytes").alias("payload_bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
