"""Packing documents into sequences: order-preserving dynamic programming over cut places.

Documents, in ascending doc_id order, are one stream of ids. A sequence is a window of it of at most
`limit` ids. Windows end at document ends (free), at sentence ends (a small penalty), or, only where
a window is exactly full, inside a sentence (a larger penalty). Padding costs one for each id missing
to `limit`; a window whose length is a power of two is not padded.

With v(i) = cost(i) + i the best window ending at j starts at the smallest v among the cut places of
the last `limit` ids. A monotone queue keeps the candidates with increasing v, so a place is pushed
and popped once. When the queue's head is about to leave the window, the full window that starts
there becomes a cut place too. The stream's tail may be cut into powers of two instead of padded.

A task packs one range of documents, in runs of RUN ids that end with a document, so memory does not
grow with the partition.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship
from trawlspark.llm.tokens import encoder

LIMIT = 2048
SENTENCE_CUT = 1.0
INSIDE_CUT = 16.0
RUN = 1 << 20


def powers(limit: int) -> list[int]:
    return [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]


def plan_cuts(
    ends: np.ndarray, penalties: np.ndarray, limit: int = LIMIT, inside: float = INSIDE_CUT
) -> list[int]:
    """Ends of the windows, ascending. ends: cut places > 0 in ascending order, the last one the end of
    the stream; penalties: of a cut at each."""
    if not len(ends):
        return []
    total, never = int(ends[-1]), float("inf")
    # by place, those of place p at p + limit, so that no place before it is negative
    cost, parent = [never] * (total + limit + 1), [0] * (total + limit + 1)
    cost[limit] = 0.0
    values: deque[float] = deque([0.0])  # cost + place, increasing
    places: deque[int] = deque([0])
    steps = powers(limit)

    def push(at: int, value: float, of: int) -> None:
        cost[at + limit], parent[at + limit] = value, of
        v = value + at
        while values and values[-1] >= v:
            values.pop(), places.pop()
        values.append(v)
        places.append(at)

    for j, penalty in zip(ends.tolist(), penalties.tolist(), strict=True):
        while places[0] + limit < j:
            values.popleft()
            head = places.popleft()
            full = head + limit
            if cost[full + limit] == never:
                push(full, cost[full] + inside, head)
            elif not places:  # the place is known, only dominated: it must lead on
                values.append(cost[full + limit] + full)
                places.append(full)
        value, best, at = values[0] + limit - j, places[0], j + limit
        for step in steps:
            known = cost[at - step]
            if known < value:
                value, best = known, j - step
        if j < total:
            push(j, value + penalty, best)
    # the last window: padded, or cut into powers of two
    tail: list[int] = []
    for k in range(total - 1, max(total - limit, 0) - 1, -1):
        if cost[k + limit] == never:
            continue
        parts = [1 << b for b in range(limit.bit_length(), -1, -1) if (total - k) >> b & 1]
        other = cost[k + limit] + inside * (len(parts) - 1)
        if other < value:
            value, best, tail = other, k, parts[:-1]
    cuts = [total, *np.flip(best + np.cumsum(tail, dtype=np.int64)).tolist()]
    while best > 0:
        cuts.append(best)
        best = parent[best + limit]
    return cuts[::-1]


@cache
def _sentence_tables(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each id: does its text end a sentence, and does it begin with white space."""
    library = encoder(tokenizer, False).library
    size = library.get_vocab_size()
    closing, opening = np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=bool)
    for token, i in library.get_vocab().items():
        closing[i] = token.rstrip("\"')")[-1:] in (".", "!", "?") or token[-1:] == "Ċ"
        opening[i] = token[:1] in ("Ġ", "Ċ")
    return closing, opening


def _pack(ids: np.ndarray, counts: np.ndarray, tokenizer: str, limit: int) -> tuple[np.ndarray, ...]:
    """(document index, start in it, length, sequence, offset) of each piece of a run."""
    closing, opening = _sentence_tables(tokenizer)
    doc_ends = np.cumsum(counts)
    inner = np.flatnonzero(closing[ids[:-1]] & opening[ids[1:]]) + 1
    ends = np.union1d(inner, doc_ends)
    penalty = np.where(np.isin(ends, doc_ends, assume_unique=True), 0.0, SENTENCE_CUT)
    cuts = np.array(plan_cuts(ends, penalty, limit), dtype=np.int64)
    stops = np.union1d(cuts, doc_ends)
    starts = np.r_[0, stops[:-1]]
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    first = np.r_[0, cuts[:-1]]
    return doc, starts - (doc_ends - counts)[doc], stops - starts, sequence, starts - first[sequence], starts


_SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text has only its end id. Null doc_ids come first and each row is a document of its own;
    equal doc_ids are ordered by their text's hash. with_ids adds the piece's ids (array of int).
    sequence_id holds the partition and the sequence's number in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        library = encoder(tokenizer, False)
        parts: list[bytes] = []
        names: list = []
        counts: list[int] = []
        size = 0

        def close(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence
            data = b"".join(parts)
            ids = np.frombuffer(data, dtype="<u4")
            each = np.array(counts, dtype=np.int64)
            doc, start, length, number, offset, at = _pack(ids, each, tokenizer, limit)
            view = memoryview(data)
            sums = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [
                pa.array(names, id_type).take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array(sums, pa.int64()), pa.array(each[doc]), pa.array(sequence + number), pa.array(offset),
            ]
            if with_ids:
                ends = pa.array(np.r_[0, np.cumsum(length)].astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32))))
            sequence += int(number[-1]) + 1
            return pa.RecordBatch.from_arrays(columns, names=schema_names)

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for name, found in zip(batch.column(0).to_pylist(), library.encode(texts), strict=True):
                parts += (found, end)
                names.append(name)
                counts.append(len(found) // 4 + 1)
                size += counts[-1]
                if size >= RUN:
                    yield close(batch.schema.field(0).type)
                    parts.clear(), names.clear(), counts.clear()
                    size = 0
        if counts:
            yield close(batch.schema.field(0).type)

    ship(docs.sparkSession)
    schema = f"doc_id {kind}, {_SCHEMA}" + (", ids array<int>" if with_ids else "")
    schema_names = ["doc_id", *[c.split()[0] for c in _SCHEMA.split(", ")], *(["ids"] if with_ids else [])]
    columns = docs.select("doc_id", "text", F.xxhash64("text").alias("__x"))
    ordered = columns.repartitionByRange("doc_id", "__x").sortWithinPartitions("doc_id", "__x").drop("__x")
    return ordered.mapInArrow(run, schema)
