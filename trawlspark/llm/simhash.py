"""Near duplicates by SimHash fingerprints, joined on a grid of their segments' bit counts.

1. A text's fingerprint of 64 bits takes the majority of each bit over the hashes of its word shingles.
   Equal fingerprints are one vertex, so a group of copies costs one row for each task.
2. Embedding: SEGMENTS segments of two bits each, and of each segment the number of its set bits. The
   Manhattan distance of two embeddings is at most the number of differing bits.
3. Grid: the segments are dealt to BLOCKS blocks. Embeddings within DISTANCE = 3 of each other agree
   exactly in at least two of five blocks, so each of the ten choices of two blocks is a grid whose cells
   are the counts there, and each linked pair shares a cell of one of them. Within a cell the rows are
   sorted by the total of their counts; only totals within DISTANCE can be linked.
4. Rows are range-partitioned by cell and total and read as a stream; windows of a cell are compared
   exactly (bits that differ), and of the links found only a spanning forest is written.
5. The cells at both ends of a task, and cells of more than CELL rows, are compared afterwards: each total
   of such a cell is a band, dealt to blocks of about CELL rows, past which the rows of the band and of the
   next DISTANCE totals are streamed. No pair of a cell is left out; a cell costs the square of its
   different fingerprints.
6. Components come from the alternating steps of neardup.components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.neardup import components
from trawlspark.llm.stage import ship, written

WIDTH = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 32
BLOCKS = 5
#: Rows of a cell that one task compares with each other, and of a block of a larger cell's band.
CELL = 32_768
#: Rows handled at once in a task; linked pairs held before they are folded into components.
CHUNK = 200_000
PAIRS = 1_000_000
#: Bytes of text cut into words at once; shingles whose bits are counted at once.
PART = 4 << 20
_SLICE = 16_384
_TOTAL_BITS = 7
_SPACE = b" \t\n\r\x0b\x0c"


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in parts of bounded size."""
    start = 0
    while start < len(raw):
        stop = start + PART
        if stop < len(raw):
            cut = min((at for at in (raw.find(bytes([c]), stop) for c in _SPACE) if at >= 0), default=len(raw))
            stop = cut
        yield raw[start:stop].split()
        start = stop


def fingerprint(text: str | None) -> int:
    """64 bits: those set in over half of the hashes of the shingles, repeats included.

    A-Z count as a-z. Fewer words than WIDTH: the whole sequence is the one shingle. No word: 0.
    """
    counts, total, carried = np.zeros(64, dtype=np.int64), 0, []
    one = xxhash.xxh64_intdigest
    for part in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + part
        for i in range(0, len(words) - WIDTH + 1, _SLICE):
            some = words[i : i + _SLICE + WIDTH - 1]
            hashes = [one(b" ".join(s), SEED) for s in zip(*(some[k:] for k in range(WIDTH)), strict=False)]
            bits = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
        carried = words[max(len(words) - WIDTH + 1, 0) :]
    if not total and carried:
        return one(b" ".join(carried), SEED)
    if not total:
        return 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS): set bits of each segment of unsigned fingerprints."""
    width = 64 // SEGMENTS
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((fp[:, None] >> shifts) & np.uint64((1 << width) - 1))


def places(fp: np.ndarray) -> np.ndarray:
    """(n, choices): of each choice of two blocks the cell, and below it the total of all counts."""
    counts = segment_counts(fp).astype(np.int64)
    total = counts.sum(axis=1)
    blocks = [0] * BLOCKS
    for k, part in enumerate(np.array_split(np.arange(SEGMENTS), BLOCKS)):
        base = 64 // SEGMENTS + 1
        blocks[k] = counts[:, part] @ (base ** np.arange(len(part), dtype=np.int64)), base ** len(part)
    found = []
    for choice, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE)):
        (a, many), (b, more) = blocks[i], blocks[j]
        cell = (choice * many + a) * more + b
        # choices differ in size of their blocks; the choice is kept apart by its own high bits
        found.append(((np.int64(choice) << 40) | cell) << _TOTAL_BITS | total)
    return np.stack(found, axis=1)


class _Forest:
    """Components of values under links, in bounded memory."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.held = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        open_ = self.label[a] != self.label[b]
        if open_.any():
            self.a.append(a[open_])
            self.b.append(b[open_])
            self.held += int(open_.sum())
            if self.held > PAIRS:
                self.fold()

    def fold(self) -> np.ndarray:
        if self.held:
            a, b = np.concatenate(self.a), np.concatenate(self.b)
            while True:
                low = np.minimum(self.label[a], self.label[b])
                # the roots of both ends point to the lower one
                np.minimum.at(self.label, self.label[a], low)
                np.minimum.at(self.label, self.label[b], low)
                while (self.label[self.label] != self.label).any():
                    self.label = self.label[self.label]
                on = self.label[a] != self.label[b]
                if not on.any():
                    break
                a, b = a[on], b[on]
            self.a, self.b, self.held = [], [], 0
        return self.label


def spanning(place: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is linked within the cells of rows sorted by place."""
    value, at = np.unique(fp, return_inverse=True)
    end = np.searchsorted(place, place + DISTANCE, side="right")
    forest, row, step = _Forest(len(value)), np.arange(len(fp)), 0
    while True:
        step += 1
        row = row[end[row] > row + step]
        if not len(row):
            break
        on = np.bitwise_count(fp[row] ^ fp[row + step]) <= DISTANCE
        near = row[on]
        if len(near):
            forest.link(at[near], at[near + step])
    return _links(value, forest)


def _links(value: np.ndarray, forest: _Forest) -> tuple[np.ndarray, np.ndarray]:
    label = forest.fold()
    on = np.flatnonzero(label != np.arange(len(label)))
    return value[label[on]].view(np.int64), value[on].view(np.int64)


def _out(a, b, place, fp) -> pa.RecordBatch:
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())]
    if place is not None:
        columns = [pa.nulls(len(place), pa.int64())] * 2 + [pa.array(place), pa.array(fp.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "place", "fp"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted rows (place, fp); the rows of cells left for later as (place, fp)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, first, large = 0, None, None  # the task's first cell; a cell too large to hold

    def split(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, first, large
        place, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cell = place >> _TOTAL_BITS
        if first is None:
            first = cell[0]
        later = (cell == first) | (cell == large)
        tail = cell == cell[-1]
        if last or tail.sum() > CELL:
            later |= tail
            large, tail = cell[-1], np.zeros(len(cell), dtype=bool)
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        length = np.diff(np.r_[start, len(cell)])
        later |= np.repeat(length, length) > CELL
        now = ~(later | tail)
        tail &= ~later
        yield _out(*spanning(place[now], fp[now]), None, None)
        yield _out([], [], place[later], fp[later])
        held, size = [(place[tail], fp[tail])], int(tail.sum())

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            size += batch.num_rows
        if size >= CHUNK:
            yield from split(last=False)
    if size:
        yield from split(last=True)


def _bands(later: DataFrame) -> DataFrame:
    """Links of the cells that tasks left for later, (place, fp): each band's blocks against the band
    itself and the next totals."""
    later = later.withColumn("cell", F.shiftright("place", _TOTAL_BITS))
    counts = later.groupBy("place").agg(F.count("*").alias("c"))
    blocks = counts.select(F.col("place").alias("band"), F.ceil(F.col("c") / CELL).cast("int").alias("k"))
    met = later.select("fp", "place", F.explode(F.sequence(F.lit(0), F.lit(DISTANCE))).alias("up"))
    met = met.select("fp", (F.col("place") - F.col("up")).alias("band"), F.col("up")).join(blocks, "band")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    others = met.select("band", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(1).alias("side"), "fp")
    rows = met.where("up = 0").select("band", own.alias("block"), F.lit(0).alias("side"), "fp").unionByName(others)
    rows = rows.repartition("band", "block").sortWithinPartitions("band", "block", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            band, block, side, fp = (c.to_numpy() for c in batch.columns)
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1]), True])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if (band[i], block[i]) != key:
                    key, mine = (band[i], block[i]), np.zeros(0, dtype=np.uint64)
                if not side[i]:
                    mine = np.r_[mine, fp[i:j]]
                elif len(mine):
                    yield _out(*_meet(mine, fp[i:j]), None, None)

    return rows.select("band", "block", "side", "fp").mapInArrow(run, _LINK).select("a", "b")


def _meet(mine: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked between two sets of fingerprints."""
    value, at = np.unique(np.r_[mine, others], return_inverse=True)
    own, far = at[: len(mine)], at[len(mine) :]
    forest = _Forest(len(value))
    step = max(1, PAIRS // max(len(mine), 1))
    for i in range(0, len(others), step):
        x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ others[None, i : i + step]) <= DISTANCE)
        forest.link(own[x], far[i + y])
    return _links(value, forest)


_LINK = "a bigint, b bigint, place bigint, fp bigint"


def links(fps: DataFrame) -> DataFrame:
    """(a, b) that connect the distinct fingerprints fps (fp) differing in at most DISTANCE bits."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            cells = places(fp.view(np.uint64))
            for k in range(cells.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cells[:, k])), pa.array(fp)], names=["place", "fp"])

    rows = fps.select("fp").mapInArrow(embed, "place bigint, fp bigint")
    ranged = rows.repartitionByRange("place", "fp").sortWithinPartitions("place", "fp")
    found = written(ranged.mapInArrow(_scan, _LINK), "grid")
    more = _bands(found.where("place is not null").select("place", "fp"))
    return found.where("a is not null").select("a", "b").unionByName(more)


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept), one row for each row of docs (doc_id, text).

    component_id: smallest doc_id of all documents reachable over links of at most DISTANCE differing
    bits; kept: it is the row's own. A null text, or one without words, has fingerprint 0 and is linked
    like any other. Rows with a null doc_id take part, but give no component_id unless no other can.
    Repeated rows get the same answer.
    """
    ship(docs.sparkSession)
    found = written(fingerprints(docs), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    label = components(written(links(classes), "links"))
    named = classes.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = written(named, "named")
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    own = named.select("fp", "label").join(lowest, "label").select("fp", "component_id")
    out = found.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
