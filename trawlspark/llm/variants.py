"""Spelling variants: generated edits are probed against Bloom filters of the vocabulary.

1. Words are counted by task and then by word (sums of partial counts).
2. The vocabulary goes into blocked Bloom filters, one for each word length (lengths from LONG on share
   one): BITS bits a word, blocks of 64 bits, so that a probe reads one number. They are built by tasks,
   chunk by chunk, and broadcast in parts of at most FILTER_BYTES; a vocabulary whose filters are larger is
   probed part by part.
3. Each word's edits are probed by their hashes only, which follow from the word's own by a few sums. Being
   near is symmetric: of two words that differ by a replacement the one with the smaller code point there
   finds the other, and of two lengths the longer word finds the shorter one. So insertions are not
   generated, and each pair is found once.
4. Only edits that pass the filter are written out and shuffled, to a join with the vocabulary that removes
   false positives. A filter has no false negatives.
5. A word has at most (2 * length + 1) * alphabet near words, so no group is unbounded. Forms are followed
   to their roots by doubling; counts grow tenfold with each step, so few rounds are needed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship, written

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is at least so many times as frequent as its variant.
TIMES = 10
LONG = 64
BITS = 16
FILTER_BYTES = 64 << 20
#: Numbers of a chunk of a filter, which one task builds.
CHUNK = 1024
#: Different words counted by a task before it passes the counts on.
COUNTED = 200_000
#: Code points handled at once: of texts, and of words whose edits are generated.
PART = 4_000_000
CELLS = 500_000
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _values(codes: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    return _mix(codes.astype(np.uint64) + np.uint64(_BASE))


def _powers(start: int, count: int) -> np.ndarray:
    out = np.full(count, _BASE, dtype=np.uint64)
    if count:
        out[0] = pow(_BASE, start, 1 << 64)
    return np.multiply.accumulate(out)


def _runs(text: str) -> Iterator[list[str]]:
    if len(text) <= PART:
        yield _RUN.findall(text)
        return
    found = _RUN.finditer(text)
    while some := [m.group() for m in islice(found, 100_000)]:
        yield some


def changed(doc: bytes, run: str) -> str:
    """A run of letters as a word: of one in 31 runs of documents one code point is deleted."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc + b":"))
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points and MIN_COUNT occurrences in docs (doc_id, text).

    Runs shorter than MIN_LENGTH give no such word. A null doc_id counts as an empty string in the hash.
    """
    ship(docs.sparkSession)

    def batch_of(counts: dict[str, int]) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc, lowered = (doc or "").encode(), (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for runs in _runs(lowered):
                    for word, n in Counter(runs).items():
                        word = changed(doc, word)
                        if len(word) >= MIN_LENGTH:
                            counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield batch_of(counts)
                    counts = {}
        yield batch_of(counts)

    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def shard(length: int) -> int:
    return min(length, LONG) - MIN_LENGTH


@dataclass
class Layout:
    """Numbers of 64 bits of each shard, and where they start."""

    blocks: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, words: dict[int, int]) -> Layout:
        """words: number of words by shard. Few words still get a thousand numbers: a false positive of a
        very long word is long."""
        blocks = np.array([max(CHUNK, -(-words.get(s, 0) * BITS // 64)) if words.get(s) else 0 for s in range(LONG - MIN_LENGTH + 1)])
        return cls(blocks.astype(np.uint64), np.r_[0, np.cumsum(blocks)[:-1]].astype(np.int64))

    @property
    def total(self) -> int:
        return int(self.blocks.sum())

    def probes(self, shard: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and bits of hashes in a shard's filter."""
        g = _mix(hashes)
        place = ((g >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32)).astype(np.int64) + self.start[shard]
        bits = np.zeros(g.shape, dtype=np.uint64)
        for k in range(5):
            bits |= np.uint64(1) << (g >> np.uint64(6 * k) & np.uint64(63))
        return place, bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, indexes, code points) of words of one length, in groups of at most CELLS code points."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, CELLS // int(length))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            codes = np.frombuffer("".join([words[k] for k in some]).encode("utf-32-le"), dtype="<u4").reshape(len(some), length)
            yield int(length), some, codes


def _slices(length: int) -> Iterator[tuple[int, int]]:
    for i in range(0, length, CELLS):
        yield i, min(length, i + CELLS)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Of words of one length: the sum of the code points' numbers times a power of their place."""
    out = np.zeros(len(codes), dtype=np.uint64)
    for i, j in _slices(codes.shape[1]):
        out += (_values(codes[:, i:j]) * _powers(i, j - i)).sum(axis=1, dtype=np.uint64)
    return out


def _filters(words: DataFrame, layout: Layout, first: int, last: int) -> np.ndarray:
    """The numbers from first to last of all filters, built by tasks in chunks."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(batch.column(0).to_pylist()):
                at, bits = layout.probes(shard(length), hashes(codes))
                on = (at >= first) & (at < last)
                at = at[on] - first
                yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK), pa.array(at % CHUNK), pa.array(bits[on].view(np.int64))], names=["chunk", "at", "bits"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, at, bits = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if chunk[i] not in made:
                    if made:
                        yield done(made)
                    made = {chunk[i]: np.zeros(CHUNK, dtype=np.int64)}
                np.bitwise_or.at(made[chunk[i]], at[i:j], bits[i:j])
        if made:
            yield done(made)

    def done(made: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["chunk", "bits"])

    placed = words.select("word").mapInArrow(place, "chunk bigint, at bigint, bits bigint")
    chunks = placed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(build, "chunk bigint, bits binary")
    out = np.zeros(-(-(last - first) // CHUNK) * CHUNK, dtype=np.uint64)
    for r in chunks.collect():  # last - first numbers in all
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def _alphabet(words: DataFrame) -> list[int]:
    """Code points of the vocabulary: some of the 90 that words are made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in seen], pa.int32())], names=["c"])

    return sorted(r["c"] for r in words.select("word").mapInArrow(run, "c int").distinct().collect())


def _edits(words: list[str], layout: Layout, filters: np.ndarray, first: int, last: int, alphabet: list[int]) -> Iterator[tuple[int, str]]:
    """(index, edited word) of the edits of words that the filters let through."""
    value_of = dict(zip(alphabet, _values(np.array(alphabet)), strict=True))

    def passing(shard_: int, found: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, column = np.nonzero(on)
        place, bits = layout.probes(shard_, found[row, column])
        here = (place >= first) & (place < last)
        if not here.all():
            row, column, place, bits = row[here], column[here], place[here], bits[here]
        hit = filters[place - first] & bits == bits
        return row[hit], column[hit]

    for length, index, codes in _by_length(words):
        whole, before = hashes(codes), np.zeros(len(codes), dtype=np.uint64)
        for i, j in _slices(length):
            part, power = codes[:, i:j], _powers(i, j - i)
            value = _values(part)
            term = value * power
            if length > MIN_LENGTH and layout.blocks[shard(length - 1)]:
                left = np.cumsum(term, axis=1, dtype=np.uint64) - term + before[:, None]
                found = left + (whole[:, None] - left - term) * _INVERSE
                # of equal code points in a row one deletion is enough
                before_it = codes[:, i - 1 : j - 1] if i else np.c_[np.zeros(len(codes), dtype=codes.dtype), part[:, :-1]]
                for r, c in zip(*passing(shard(length - 1), found, part != before_it), strict=True):
                    word = words[index[r]]
                    yield index[r], word[: i + c] + word[i + c + 1 :]
            for code in alphabet:
                on = part < code
                if on.any():
                    found = whole[:, None] + (value_of[code] - value) * power
                    for r, c in zip(*passing(shard(length), found, on), strict=True):
                        word = words[index[r]]
                        yield index[r], word[: i + c] + chr(code) + word[i + c + 1 :]
            before += term.sum(axis=1, dtype=np.uint64)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m) of each pair of near words of a vocabulary (word, n), once."""
    spark = ship(words.sparkSession)
    sizes = words.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("length")).count()
    layout = Layout.of({shard(r["length"]): r["count"] for r in sizes.collect()})
    alphabet = _alphabet(words)
    others = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    found = None
    step = FILTER_BYTES // 8
    for first in range(0, max(layout.total, 1), step):
        last = min(first + step, layout.total)
        shared = spark.sparkContext.broadcast(_filters(words, layout, first, last))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                listed, n, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy(), []
                size = 0
                for row in _edits(listed, layout, shared.value, first, last, alphabet):
                    rows.append(row)
                    size += len(row[1])
                    if size > PART:
                        yield out(listed, n, rows)
                        rows, size = [], 0
                if rows:
                    yield out(listed, n, rows)

        def out(listed: list[str], n: np.ndarray, rows: list[tuple[int, str]]) -> pa.RecordBatch:
            at = [i for i, _ in rows]
            columns = [pa.array([listed[i] for i in at]), pa.array(n[at]), pa.array([e for _, e in rows])]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", "other"])

        passed = words.select("word", "n").mapInArrow(probe, "word string, n bigint, other string")
        pairs = written(passed.join(others, "other").select("word", "n", "other", "m"), "near")
        shared.unpersist()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): each round doubles the steps; most: the largest count."""
    longest = int(math.log(max(most / MIN_COUNT, 1)) / math.log(TIMES) + 1e-9)
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(longest - 1, 0).bit_length()):
        next_ = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(found.join(next_, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found


def grouped(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of docs (doc_id, text).

    Two words are near if they differ by one inserted, deleted or replaced code point. form: the near word
    of largest n (ties: smallest) if that n is at least TIMES the word's; root: the last of the forms that
    follow, or the word itself. A null or empty text has no words; repeated rows count as often as they are.
    """
    words = written(vocabulary(docs), "vocabulary")
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best: Column = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    )
    found = written(found, "forms")
    most = found.agg(F.max("n")).first()[0] or 0
    roots = _roots(found.where("form is not null"), most)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
