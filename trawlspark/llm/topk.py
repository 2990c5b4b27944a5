"""Exact top-k inner products: columnar branch-and-bound over blocks of vectors.

Vectors become integers and are stored in blocks, dimension by dimension (vertical layout), with the
dimensions of most mass first. A block of queries meets a block of candidates in one row; blocks are
paired, never rows. Scores are accumulated a slice of dimensions at a time. After each slice a pair's
score can grow by no more than the product of the masses (norms) that both vectors have left, so pairs
that cannot reach the query's k-th best score are dropped; once few are left, the survivors are
compacted into a list and only they are carried on.

The k-th best score among a bounded sample of candidates is each query's first bound; it is a true
lower bound, so the result does not depend on the sample. All arithmetic is exact: 32- or 64-bit
floats while norms prove that every sum is a whole number they can hold, else Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship, written

CANDIDATES = 4096
QUERIES = 512
SLICE = 16
SAMPLE = 4096
#: Survivors are compacted when this share of the pairs, or less, is left.
COMPACT = 0.05
#: Block pairs handed to Python at once.
PAIRS = 4
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _kind(x: np.ndarray) -> str:
    most = np.abs(x).max(initial=0)
    return "i1" if most <= 127 else "<i2" if most <= 32767 else "<f8"


def _blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """(dim, block, ids, kind, columns) of vectors (vec_id, embedding): columns holds one dimension
    after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            number += 1
            kind = _kind(x)
            row = [[dim], [task + number], [ids.astype("<i8").tobytes()], [kind], [x.T.astype(kind).tobytes()]]
            types = [pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["dim", "block", "ids", "kind", "columns"]
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                x = np.floor(scale * flat[starts[own][:, None] + np.arange(dim)[None, :]])
                for at in range(0, len(own), rows):
                    part = held.setdefault(int(dim), [])
                    part.append((ids[own[at : at + rows]], x[at : at + rows]))
                    if sum(len(p[0]) for p in part) >= rows:
                        yield close(int(dim))
        for dim in list(held):
            yield close(dim)

    return vectors.mapInArrow(run, "dim int, block bigint, ids binary, kind string, columns binary")


def _open(ids: bytes, kind: str, columns: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, dtype="<i8")
    return found, np.frombuffer(columns, dtype=kind).reshape(dim, len(found))


def best(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of at least the k best candidates of each query that
    reach its floor. queries and vectors are dimension x row; a candidate with the query's id is left
    out."""
    q, c = queries.astype(np.float64), vectors.astype(np.float64)
    most = np.sqrt((q**2).sum(axis=0).max(initial=0) * (c**2).sum(axis=0).max(initial=0))
    if most >= 1 << 52:
        return _plain(query_ids, q, ids, c, k)
    order = np.argsort(-(c**2).sum(axis=1), kind="stable")
    kind = np.float32 if most < 1 << 23 else np.float64
    q, c = q[order], c[order]
    left_q, left_c = (np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1]) * (1 + 1e-9) for x in (q, c))
    q, c = q.astype(kind), c.astype(kind)
    dim = len(q)
    score = np.zeros((q.shape[1], c.shape[1]), dtype=kind)
    score[query_ids[:, None] == ids[None, :]] = -np.inf
    floor = floor.astype(np.float64)
    pairs = None
    for at in range(0, dim, SLICE):
        end = min(at + SLICE, dim)
        if pairs is None:
            score += q[at:end].T @ c[at:end]
        else:
            a, b, s = pairs
            s = s + np.einsum("dn,dn->n", q[at:end, a], c[at:end, b])
            pairs = a, b, s
        if end == dim:
            break
        if pairs is None:
            if 2 * end < dim:
                continue
            alive = score + left_q[end][:, None] * left_c[end][None, :] >= floor[:, None]
            if alive.mean() <= COMPACT:
                a, b = np.nonzero(alive)
                pairs = a, b, score[a, b]
        else:
            keep = s + left_q[end, a] * left_c[end, b] >= floor[a]
            pairs = a[keep], b[keep], s[keep]
    if pairs is None:
        a, b = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        pairs = a, b, score[a, b]
    a, b, s = pairs
    keep = (s >= floor[a]) & (s > -np.inf)
    return _first(a[keep], b[keep], s[keep].astype(np.int64), ids, k)


def _first(a: np.ndarray, b: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int):
    order = np.lexsort((ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=int)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    return a[place < k], b[place < k], s[place < k]


def _plain(query_ids, q, ids, c, k):
    """With whole Python numbers; scores beyond a long are the nearest long."""
    exact = [[int(v) for v in col] for col in c.T]
    a, b, s = [], [], []
    for i in range(q.shape[1]):
        own = [int(v) for v in q[:, i]]
        for j, col in enumerate(exact):
            if query_ids[i] != ids[j]:
                a.append(i)
                b.append(j)
                s.append(min(max(sum(x * y for x, y in zip(own, col, strict=True)), _MIN + 1), _MAX))
    return _first(np.array(a, dtype=int), np.array(b, dtype=int), np.array(s, dtype=np.int64), ids, k)


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by exact inner product of
    floor(scale * x); ties go to the smaller vec_id, and fewer candidates give fewer rows.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows of equal dimension
    with another vec_id (a vec_id names one vector: a repeated query row is answered once, by any of its
    rows; repeated candidate rows each count). Rows with a null id, or not `usable`, take no part.
    """
    spark = ship(vectors.sparkSession)
    fine = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = written(_blocks(fine, CANDIDATES, scale), "candidates")
    chosen = fine.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    queries = written(_blocks(chosen, QUERIES, scale), "queries")
    sample: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in _blocks(fine.limit(SAMPLE), SAMPLE, scale).collect():
        sample.setdefault(r["dim"], []).append(_open(r["ids"], r["kind"], r["columns"], r["dim"]))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for r in batch.to_pylist():
                qid, q = _open(r["ids"], r["kind"], r["columns"], r["dim"])
                floor = np.full(len(qid), -np.inf)
                for ids, x in sample.get(r["dim"], []):
                    a, _, s = best(qid, q, ids, x, k, floor)
                    found = np.bincount(a, minlength=len(qid))
                    last = np.cumsum(found) - 1
                    enough = found >= k
                    floor[enough] = np.maximum(floor[enough], s[last[enough]])
                floors.append(floor.tobytes())
            yield batch.append_column("floor", pa.array(floors, pa.binary()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                qid, q = _open(r["ids"], r["kind"], r["columns"], r["dim"])
                ids, x = _open(r["cids"], r["ckind"], r["ccolumns"], r["dim"])
                a, b, s = best(qid, q, ids, x, k, np.frombuffer(r["floor"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[a]), pa.array(ids[b]), pa.array(s)], names=["query_id", "vec_id", "score"]
                )

    schema = "dim int, block bigint, ids binary, kind string, columns binary, floor binary"
    bounded = written(queries.mapInArrow(first_bounds, schema), "bounded")
    numbers = rows.select("dim", F.col("block").alias("cblock"))
    pairs = bounded.join(numbers, "dim").join(
        rows.select(
            "dim", F.col("block").alias("cblock"), F.col("ids").alias("cids"), F.col("kind").alias("ckind"),
            F.col("columns").alias("ccolumns"),
        ),
        ["dim", "cblock"],
    )
    # rows are wide: few of them at a time go to Python while the scores are written
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(PAIRS))
    try:
        scores = written(pairs.mapInArrow(meet, "query_id bigint, vec_id bigint, score bigint"), "scores")
    finally:
        spark.conf.set(setting, before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
