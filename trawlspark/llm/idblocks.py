"""Token ids as a binary file format: patched frame-of-reference blocks.

A segment holds the ids of some whole documents. Its bytes:

    4s magic, u32 ids, u32 blocks, u32 ids per block
    u32 start of each block after this index, and their end
    each block: u32 minimum, u8 width, u16 exceptions, u16 places..., u32 values..., packed bits

Ids are stored less the block's minimum, in `width` bits, little-endian. The width is that of the
block's PERCENTILE-th percentile; larger values go to the exception list. All integers are
little-endian. Segments are rows of a Parquet table, beside the documents they hold: Spark's commit
protocol then covers them, on any store, and a lost executor leaves no half-written file.

Documents are range-partitioned and sorted by doc_id; one partition is one shard. Reading needs no
shuffle: each segment is decoded by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship
from trawlspark.llm.tokens import encoder

BLOCK = 512
PERCENTILE = 95
SEGMENT = 128 * BLOCK
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIII")
_BLOCK = struct.Struct("<IBH")


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of unsigned 32-bit ids; empty ids give a segment without blocks."""
    n = len(ids)
    blocks = -(-n // block)
    full = np.zeros((blocks, block), dtype=np.uint32)
    full.reshape(-1)[:n] = ids
    if n % block:
        full[-1, n % block :] = ids[n - n % block :].min()  # padding adds no bits
    low = full.min(axis=1, initial=0xFFFFFFFF)
    less = full - low[:, None]
    at = min(block - 1, block * PERCENTILE // 100)
    limit = np.partition(less, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = ((less[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for r, line in zip(rows, body, strict=True):
                packed[r] = line.tobytes()
    above = less.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    counts, values = above.sum(axis=1), less[above].astype("<u4")
    places = np.nonzero(above)[1].astype("<u2")
    ends = np.cumsum(counts)
    out, index, at = [], [], 0
    for r in range(blocks):
        a, b = ends[r] - counts[r], ends[r]
        body = b"".join(
            (_BLOCK.pack(low[r], width[r], b - a), places[a:b].tobytes(), values[a:b].tobytes(), packed[r])
        )
        index.append(at)
        at += len(body)
        out.append(body)
    return b"".join((_HEAD.pack(MAGIC, n, blocks, block), np.array([*index, at], dtype="<u4").tobytes(), *out))


def decode_blocks(data: bytes | memoryview, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks first..last (all by default), found by the index of block starts."""
    magic, n, blocks, block = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of id blocks")
    index = np.frombuffer(data, dtype="<u4", count=blocks + 1, offset=_HEAD.size)
    base = _HEAD.size + 4 * (blocks + 1)
    last = blocks if last is None else min(last, blocks)
    if index[-1] + base != len(data):
        raise ValueError("segment is cut off")
    out = np.zeros((max(last - first, 0), block), dtype=np.uint32)
    by_width: dict[int, list[tuple[int, int]]] = {}
    patches = []
    for r in range(first, last):
        at = base + int(index[r])
        low, width, count = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        patches.append((low, count, at))
        by_width.setdefault(width, []).append((r - first, at + 6 * count))
    for width, found in by_width.items():
        if width:
            size = block * width // 8
            raw = np.stack([np.frombuffer(data, dtype=np.uint8, count=size, offset=at) for _, at in found])
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(found), block, width)
            value = np.zeros((len(found), block), dtype=np.uint32)
            for k in range(width):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[[r for r, _ in found]] = value
    for r, (low, count, at) in enumerate(patches):
        if count:
            places = np.frombuffer(data, dtype="<u2", count=count, offset=at)
            out[r, places] = np.frombuffer(data, dtype="<u4", count=count, offset=at + 2 * count)
        out[r] += np.uint32(low)
    return out.reshape(-1)[: max(min(n, last * block) - first * block, 0)]


def write_ids(docs: DataFrame, path: str, tokenizer: str, drops_space: bool, end_id: int) -> None:
    """Write the ids of docs (doc_id, text) to the folder `path`, documents in ascending doc_id order.

    A null text has only its end id. Equal doc_ids are ordered by their text's hash; null ids come
    first. Rows: shard, segment, start (ids of the shard before it), n_ids, docs (doc_id, n_tokens),
    body.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        library = encoder(tokenizer, drops_space)
        ids: list[bytes] = []
        counts: list[int] = []
        names: list[pa.Array] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, start, ids, counts, names
            body = np.frombuffer(b"".join(ids), dtype="<u4")
            docs = pa.StructArray.from_arrays(
                [pa.array(names, id_type), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
            )
            row = [
                pa.array([shard], pa.int64()), pa.array([segment], pa.int64()), pa.array([start], pa.int64()),
                pa.array([len(body)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), docs),
                pa.array([encode_blocks(body)], pa.binary()),
            ]
            segment, start, ids, counts, names = segment + 1, start + len(body), [], [], []
            return pa.RecordBatch.from_arrays(row, names=["shard", "segment", "start", "n_ids", "docs", "body"])

        size = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            texts = (t.as_py() for t in batch.column(1))
            for name, found in zip(batch.column(0).to_pylist(), library.encode(texts), strict=True):
                ids += (found, end)
                counts.append(len(found) // 4 + 1)
                names.append(name)
                size += counts[-1]
                if size >= SEGMENT:
                    yield close()
                    size = 0
        if counts:
            yield close()

    columns = docs.select("doc_id", "text", F.xxhash64("text").alias("__x"))
    ordered = columns.repartitionByRange("doc_id", "__x").sortWithinPartitions("doc_id", "__x").drop("__x")
    schema = (
        f"shard bigint, segment bigint, start bigint, n_ids bigint, "
        f"docs array<struct<doc_id:{kind},n_tokens:bigint>>, body binary"
    )
    ship(docs.sparkSession)
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files below `path`, decoded and cut at documents.

    start counts the ids of all documents before: the shard's (one row a shard is summed up) and the
    segment's.
    """
    table = ship(spark).read.parquet(path)
    kind = table.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                docs = batch.column(2)[i].values
                ids = decode_blocks(batch.column(3)[i].as_buffer()).astype("<u4")
                counts = docs.field(1).to_numpy()
                ends = np.cumsum(counts)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.field(0), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64()),
                        pa.array(np.full(len(ends), shard)),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    found = table.select("shard", "start", "docs", "body").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, shard bigint"
    )
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    found = found.join(shards.select("shard", before.alias("before")), "shard")
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
