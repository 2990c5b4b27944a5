"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full sets.

1. Each document becomes the set of its hashed word shingles. Documents with equal sets are one class
   (a hash aggregate, so thousands of copies cost one row for each task).
2. The forest: TREES sorted orders of the classes' signatures, each led by DEPTH minhashes of its own
   (the region) and continued by further ones. Rows are range-partitioned and sorted, so also a region
   with a third of all rows is spread over tasks. In a region of up to REGION rows all pairs are
   candidates. In a denser one each row is first compared with its neighbours in sorted order and with
   the region's pivots: its smallest row, and the first of the longest run with one prefix (near the
   centre of a group of mutated copies).
3. The first FIRST trees are read alone. Their pairs with a pivot are confirmed first; what these connect
   needs no further comparison, so of the other candidates only those between different components are
   confirmed, on the full sets. The rows of the other trees carry the components found so far, and only
   pairs of rows in different ones leave the scan. So a large group of near copies costs the pairs of
   FIRST orders, not of all.
4. In dense regions the best-connected documents (hubs) are then compared with every row of the region
   in another component, until a round finds few links. Like neighbours and pivots, hubs only leave less
   to the next step.
5. The rest of a dense region is compared whole: all pairs of its rows in different components, tile by
   tile, on sketches of SKETCH bits (one of each of as many minhashes); pairs that the sketch does not
   rule out are confirmed in the tile, on the full sets that its rows bring along. So no pair of a region
   is left out, and only links leave a tile: pairs are never rows of a table. The work in the tiles grows
   with the square of the rows of a dense region that are linked with nothing.
6. Components come from alternating large-star and small-star steps, cut by written tables; up to
   FEW_LINKS links are followed in one task, without shuffles.

At the similarity bound itself a pair shares no region with probability
(1 - 0.8^DEPTH)^TREES = 6e-7, above it with less. A sketch rules it out with about 1e-7 (SIGMAS).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawlspark.llm.stage import Scratch, ship, written

#: Writes a table of a name and gives it back.
Put = Callable[[DataFrame, str], DataFrame]

DEPTH = 5
TREES = 36
FIRST = 4
REGION = 24
NEIGHBOURS = 3
#: Bits of a sketch; standard deviations below its expectation at which a pair is ruled out.
SKETCH = 2048
SIGMAS = 5.5
#: Rows of each side of a tile, and the sizes of their sets together, about.
TILE = 1024
TILE_ITEMS = 4_000_000
#: Links that one task follows.
FEW_LINKS = 30_000
#: Links of a round of hubs below which no other follows.
FEW_HUB_LINKS = 100
#: Rows of sorted order handled at once in a task.
CHUNK = 100_000
_SLICE = 4096
_RNG = np.random.default_rng(20240607)
_FACTORS = _RNG.integers(1, 1 << 63, DEPTH * TREES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_FACTORS = _RNG.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Minhashes that continue each tree's order after its own: one of each of the next four trees.
_LATER = (np.arange(TREES)[:, None] + np.arange(1, 5)[None, :]) % TREES * DEPTH
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; A-Z count as a-z.

    Fewer words than width: the whole sequence is the one shingle. No word: empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = _mix(out * _K3 + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """DEPTH * TREES minhashes of 32 bits."""
    best = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), _SLICE):
        np.minimum(best, (_FACTORS[:, None] * items[None, i : i + _SLICE]).min(axis=1), out=best)
    return (best >> np.uint64(16)).astype(np.uint32)


def sketch(items: np.ndarray) -> bytes:
    """One bit of each of SKETCH further minhashes."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), _SLICE // 16):
        np.minimum(best, (_BIT_FACTORS[:, None] * items[None, i : i + _SLICE // 16]).min(axis=1), out=best)
    return np.packbits((_mix(best) >> np.uint64(63)).astype(np.uint8)).tobytes()


def orders(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tree: its region (64 bits, different between trees) and what follows in its order."""
    key = np.arange(TREES, dtype=np.uint64) + np.uint64(1)
    for column in sig.reshape(TREES, DEPTH).T:
        key = _mix(key * _K1 + column)
    later = (sig[_LATER] >> np.uint32(16)).astype(np.uint64)
    deep = (later[:, 0] << np.uint64(48)) | (later[:, 1] << np.uint64(32)) | (later[:, 2] << np.uint64(16)) | later[:, 3]
    return key.view(np.int64), deep.view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, n, k1, k2, regions, deeper): the text's hash, set size, set key in two halves, the
    orders of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2 = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            regions, deeper, ends = [], [], np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(batch.column(1)):
                items = shingles(text.as_py(), width)
                n[i] = len(items)
                if len(items):
                    both = xxhash.xxh3_128_digest(items.tobytes())
                    k1[i], k2[i] = np.frombuffer(both, dtype=np.int64)
                    key, deep = orders(signature(items))
                    regions.append(key)
                    deeper.append(deep)
                ends[i + 1] = ends[i] + (TREES if len(items) else 0)
            flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (regions, deeper)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(k1), pa.array(k2), *lists],
                names=["doc_id", "th", "n", "k1", "k2", "regions", "deeper"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {kind}, th bigint, n bigint, k1 bigint, k2 bigint, regions array<bigint>, deeper array<bigint>"
    )


_PAIRS = "a bigint, b bigint, pivot boolean, region bigint, v bigint, n bigint, l bigint"


def _scan(percent: int):
    """Candidates of sorted rows (region, deep, v, n, l), of which none has one component l on both sides.
    Rows at both ends of a task, whose region may go on in another task, come out once more as
    (region, v, n, l); all rows of dense regions and of these come out as (region, v, pivot)."""

    def pairs(region: np.ndarray, deep: np.ndarray, v: np.ndarray, n: np.ndarray, l: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        length = np.diff(np.r_[start, len(region)])
        size, first = np.repeat(length, length), np.repeat(start, length)
        a, b, kind = [], [], []
        lowest = np.minimum.reduceat(v, start)
        at = np.repeat(start, length)
        # index of the smallest v of each region
        order = np.lexsort((v, at))
        pivot = np.repeat(order[start], length)
        assert len(lowest) == len(start)
        pivots = [pivot]
        dense = np.flatnonzero(length > REGION)
        if len(dense):
            centre = pivot.copy()
            for r in dense:
                part = deep[start[r] : start[r] + length[r]]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                centre[start[r] : start[r] + length[r]] = start[r] + cut[np.argmax(np.diff(cut))]
            pivots.append(centre)
        here = np.arange(len(region))
        for p in pivots:
            on = (size > 1) & (p != here)
            a.append(p[on])
            b.append(here[on])
            kind.append(np.ones(on.sum(), dtype=bool))
        for step in range(1, REGION):
            on = (here - step >= first) & ((size <= REGION) | (step <= NEIGHBOURS))
            if not on.any():
                break
            b.append(here[on])
            a.append(here[on] - step)
            kind.append(np.zeros(on.sum(), dtype=bool))
        a, b, kind = np.concatenate(a), np.concatenate(b), np.concatenate(kind)
        on = (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent) & (l[a] != l[b])
        return out(v[a[on]], v[b[on]], kind[on], None)

    def out(a, b, kind, edge, dense=False) -> pa.RecordBatch:
        m = len(a)
        if edge is None:
            rest = [pa.nulls(m, pa.int64())] * 4
            low, high = np.minimum(a, b), np.maximum(a, b)
            lead = [pa.array(low), pa.array(high), pa.array(kind)]
        else:
            m = len(edge[0])
            marks = pa.array(np.ones(m, dtype=bool)) if dense else pa.nulls(m, pa.bool_())
            lead = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), marks]
            rest = [pa.array(x) for x in edge]
        return pa.RecordBatch.from_arrays([*lead, *rest], names=["a", "b", "pivot", "region", "v", "n", "l"])

    def ends(rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
        """The rows of the first or last region; of a dense one its first and last rows."""
        region = rows[0]
        on = np.flatnonzero(region == region[-1 if last else 0])
        if len(on) > REGION:
            low = on[np.argmin(rows[2][on])]
            on = np.unique(np.r_[on[:NEIGHBOURS], low, on[-NEIGHBOURS:]])
        return out([], [], [], (region[on], rows[2][on], rows[3][on], rows[4][on]))

    def crowded(rows: list[np.ndarray]) -> pa.RecordBatch:
        region = rows[0]
        start = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
        length = np.diff(np.r_[start, len(region)])
        many = (np.repeat(length, length) > REGION) | (region == region[0]) | (region == region[-1])
        return out([], [], [], (region[many], rows[2][many], rows[3][many], rows[4][many]), dense=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        first = True

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) < CHUNK:
                continue
            rows = joined()
            if first:
                yield ends(rows, last=False)
                first = False
            yield pairs(*rows)
            yield crowded(rows)
            # the last region goes on: all its rows if few, else its pivot and nearest rows
            on = np.flatnonzero(rows[0] == rows[0][-1])
            if len(on) > REGION:
                on = np.unique(np.r_[on[np.argmin(rows[2][on])], on[-REGION:]])
            held = [[x[on] for x in rows]]
        if held:
            rows = joined()
            if first:
                yield ends(rows, last=False)
            yield ends(rows, last=True)
            yield pairs(*rows)
            yield crowded(rows)

    return run


def _across(edges: DataFrame, percent: int) -> DataFrame:
    """Candidates between rows of one region in different tasks: all pairs of up to REGION rows, else
    neighbours in order and the smallest row; at most 2 * REGION rows came from each task."""
    edges = edges.dropDuplicates(["region", "v"]).repartition("region").sortWithinPartitions("region", "v")
    run = _scan(percent)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.filter(batch.column(0).is_valid())

    return edges.select("region", F.col("v").alias("deep"), "v", "n", "l").mapInArrow(go, _PAIRS).select("a", "b", "pivot")


def candidates(
    classes: DataFrame, percent: int, first: int = 0, last: int = TREES, put: Put = written
) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b, pivot), a < b, of classes (v, n, l, regions, deeper) with different components l in the
    trees from first to last, and the (region, v, n) of dense regions; written once."""
    some = [F.slice(c, first + 1, last - first).alias(c) for c in ("regions", "deeper")]
    trees = classes.select("v", "n", "l", *some).select("v", "n", "l", F.inline(F.arrays_zip("regions", "deeper"))).select(
        F.col("regions").alias("region"), F.col("deeper").alias("deep"), "v", "n", "l"
    )
    ordered = trees.repartitionByRange("region", "deep", "v").sortWithinPartitions("region", "deep", "v")
    found = put(ordered.mapInArrow(_scan(percent), _PAIRS), "forest")
    own = found.where("a is not null").select("a", "b", "pivot")
    pairs = own.unionByName(_across(found.where("region is not null and pivot is null").select("region", "v", "n", "l"), percent))
    dense = found.where("region is not null and pivot").select("region", "v", "n").distinct()
    # only regions of several rows matter
    several = dense.groupBy("region").count().where("count > 1").select("region")
    return put(pairs.groupBy("a", "b").agg(F.max("pivot").alias("pivot")), "pairs"), put(
        dense.join(several, "region"), "dense"
    )


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets reach the similarity; texts: (v, text), one row a class."""
    far = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    both = far.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            a = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, own = a[i], shingles(batch.column(2)[i].as_py(), width)
                other = shingles(batch.column(3)[i].as_py(), width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _hub_pairs(dense: DataFrame, links: DataFrame, label: DataFrame, put: Put) -> DataFrame:
    """Pairs of each dense region's rows with its two hubs: the vertex with most links, and the one
    with most links in another component; only rows of other components."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v"))
    rows = dense.join(label, "v", "left").join(ends.groupBy("v").agg(F.count("*").alias("d")), "v", "left")
    rows = put(rows.select("region", "v", F.coalesce("label", "v").alias("l"), F.coalesce("d", F.lit(0)).alias("d")), "rows")
    best = rows.groupBy("region", "l").agg(F.max(F.struct("d", "v")).alias("hub"))
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("hub"), "l"))
    first, second = F.col("place") == 1, F.col("place") == 2
    hubs = best.withColumn("place", place).where("place <= 2").groupBy("region").agg(
        F.max(F.when(first, F.col("hub.v"))).alias("h1"), F.max(F.when(first, F.col("l"))).alias("l1"),
        F.max(F.when(second, F.col("hub.v"))).alias("h2"), F.max(F.when(second, F.col("l"))).alias("l2"),
    ).where("h2 is not null")
    apart = rows.join(hubs, "region").where("l <> l1").select("v", F.explode(F.array("h1", F.when(F.col("l") != F.col("l2"), F.col("h2")))).alias("h"))
    return apart.where("h is not null").select(F.least("v", "h").alias("a"), F.greatest("v", "h").alias("b")).distinct()


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(v, n, bits, items) of (v, text); items: the set's sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(text.as_py(), width) for text in batch.column(1)]
            n = pa.array([len(x) for x in items], pa.int64())
            bits = pa.array([sketch(x) for x in items], pa.binary())
            whole = pa.array([x.tobytes() for x in items], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, bits, whole], names=["v", "n", "bits", "items"])

    return texts.select("v", "text").mapInArrow(run, "v bigint, n bigint, bits binary, items binary")


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others, none of them empty."""
    flat = np.concatenate(others)
    at = own.searchsorted(flat)
    at[at == len(own)] = 0
    starts = np.cumsum([0, *[len(x) for x in others[:-1]]])
    return np.add.reduceat((own[at] == flat).astype(np.int64), starts)


def _rest(dense: DataFrame, texts: DataFrame, label: DataFrame, width: int, percent: int, put: Put) -> DataFrame:
    """The links (a, b) among all pairs of rows of one dense region in different components.

    The rows of a region are dealt to blocks of about TILE rows, and TILE_ITEMS shingles, those of a
    component of TILE rows or more to blocks of their own; a tile is two blocks, other than two of one
    large component.
    """
    rows = dense.join(label, "v", "left").select("region", "v", "n", F.coalesce("label", "v").alias("l"))
    counts = rows.groupBy("region", "l").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    large = F.col("c") >= TILE
    needed = F.greatest(F.col("c") / TILE, F.col("items") / TILE_ITEMS)
    counts = put(counts.withColumn("blocks", needed), "counts")
    mixed = counts.groupBy("region").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), *[F.sum(F.when(~large, F.col(x))).alias(f"few_{x}") for x in ("c", "items")])
    few = F.greatest(F.col("few_c") / TILE, F.col("few_items") / TILE_ITEMS)
    mixed = mixed.where("lo <> hi").select("region", F.coalesce(few, F.lit(0.0)).alias("few"))
    dealt = rows.join(counts.join(mixed, "region"), ["region", "l"]).select(
        "region", "v", "l", F.when(large, F.col("l")).otherwise(-1).alias("g"),
        F.pmod(F.xxhash64("v"), F.ceil(F.when(large, F.col("blocks")).otherwise(F.col("few")))).alias("k"),
    )
    dealt = put(dealt, "dealt")
    blocks = put(dealt.select("region", "g", "k").distinct(), "blocks")
    other = blocks.select("region", F.col("g").alias("g2"), F.col("k").alias("k2"))
    tiles = blocks.join(other, "region").where("(g, k) <= (g2, k2) AND (g <> g2 OR g < 0)")
    tiles = tiles.withColumns({"t": F.xxhash64("region", "g", "k", "g2", "k2"), "one": F.expr("(g, k) = (g2, k2)")})
    tiles = put(tiles, "tiles")
    sides = tiles.select("region", "g", "k", "t", "one", F.lit(0).alias("side")).unionByName(
        tiles.select("region", F.col("g2").alias("g"), F.col("k2").alias("k"), "t", "one", F.lit(1).alias("side"))
    )
    # a row's dense regions, at most one of each tree: a pair counts in the first that it shares
    shared = dealt.groupBy("v").agg(F.collect_set("region").alias("regions"))
    bits = put(_sketches(texts.join(shared.select("v"), "v"), width).join(shared, "v"), "sketches")
    put = dealt.join(sides, ["region", "g", "k"]).select("t", "one", "side", "v", "l", "region").join(bits, "v")
    put = put.select("t", "one", "side", "v", "l", "region", "n", "bits", "regions", "items").repartition("t").sortWithinPartitions("t")
    share = (100 + percent) / 200
    limit = SKETCH * (1 - share) + SIGMAS * (SKETCH * share * (1 - share)) ** 0.5

    def near(one, side, v, l, region, n, words, regions, items) -> pa.RecordBatch:
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(x), 256):
            at = x[i : i + 256]
            far = np.zeros((len(at), len(y)), dtype=np.int16)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[at, w][:, None] ^ words[y, w][None, :])
            p, q = np.nonzero((far <= limit) & (l[at][:, None] != l[y][None, :]))
            p, q = at[p], y[q]
            on = (np.minimum(n[p], n[q]) * 100 >= np.maximum(n[p], n[q]) * percent) & (~one[p] | (v[p] < v[q]))
            on[on] = [min(regions[i] & regions[j]) == r for i, j, r in zip(p[on], q[on], region[p[on]], strict=True)]
            p, q = p[on], q[on]
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]) if len(p) else []
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                i, js = p[start], q[start:end]
                common = _shared(np.frombuffer(items[i], dtype=np.uint64), [np.frombuffer(items[j], dtype=np.uint64) for j in js])
                js = js[100 * common >= percent * (n[i] + n[js] - common)]
                a.append(np.minimum(v[i], v[js]))
                b.append(np.maximum(v[i], v[js]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            return near(*[np.concatenate(x) for x in list(zip(*held, strict=True))[1:]])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            raw = b"".join(batch.column(7).to_pylist())
            columns.append(np.frombuffer(raw, dtype=np.uint64).reshape(batch.num_rows, SKETCH // 64))
            columns.append(np.fromiter(map(frozenset, batch.column(8).to_pylist()), dtype=object, count=batch.num_rows))
            columns.append(np.fromiter(batch.column(9).to_pylist(), dtype=object, count=batch.num_rows))
            t = columns[0]
            cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
            for start, end in zip(cut[:-1], cut[1:], strict=True):
                if held and held[-1][0][0] != t[start]:
                    yield whole()
                    held = []
                held.append([x[start:end] for x in columns])
        if held:
            yield whole()

    return put.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, put: Put = written) -> DataFrame:
    """(v, label): the smallest vertex reachable, for all vertices of links (a, b) but the smallest themselves.

    Every round points vertices nearer to their minimum by two aggregates with map-side minima and
    joins that AQE can split; rounds grow with the logarithm of the longest path.
    """
    edges = links.select("a", "b").where("a <> b")
    few = edges.limit(FEW_LINKS + 1).count() <= FEW_LINKS

    def held(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if few else rows

    def least(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    with Scratch(links.sparkSession, "rounds") as rounds:
        while True:
            both = held(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
            large = both.join(least(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = rounds.written(large.where("a <> b").distinct(), "large")
            turned = held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
            low = turned.groupBy("a").agg(F.min("b").alias("m"))
            near = turned.join(least(low), "a")
            small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b"))
            )
            edges = rounds.written(held(small.where("a <> b")).distinct(), "small")
            # done when all are stars: a vertex has one smaller neighbour, or is the smallest of its own
            ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
                edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
            )
            if held(ends).groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
                return put(edges.select(F.col("a").alias("v"), F.col("b").alias("label")), "label")


def extended(label: DataFrame, links: DataFrame, put: Put = written) -> DataFrame:
    """(v, label) of components with further links (a, b). Only these are followed, as links between the
    components that they connect; what is connected already costs no more rounds."""
    both = _labelled(_labelled(links, label, "a", "la"), label, "b", "lb").where("la <> lb")
    new = put(both.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "between")
    if new.isEmpty():
        return label
    above = components(new, put)
    up = above.select(F.col("v").alias("label"), F.col("label").alias("top"))
    known = label.join(up, "label", "left").select("v", F.coalesce("top", "label").alias("label"))
    return put(known.unionByName(above), "label")


def _labelled(rows: DataFrame, label: DataFrame, vertex: str, name: str) -> DataFrame:
    """rows with the component of a vertex; one without links is its own."""
    own = label.select(F.col("v").alias(vertex), F.col("label").alias(name))
    return rows.join(own, vertex, "left").withColumn(name, F.coalesce(name, vertex))


def deduplicate(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs (doc_id, text).

    component_id: smallest doc_id of all documents reachable over links with a similarity of percent
    or more; kept: it is the row's own. A null text, or one without words, has no shingles and is
    linked with nothing. Rows with a null doc_id take part; their own id never is a component_id
    unless no other is in the component. Repeated rows get the same answer.
    """
    return _classified(docs, width, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _classified(docs: DataFrame, width: int, percent: int, put: Put = written) -> DataFrame:
    """What deduplicate returns, with the text's hash th and the component's label (-1 without words)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = put(_sets(docs, width), "sets")
    keys = ["k1", "k2"]
    with Scratch(docs.sparkSession, "neardup") as tables:
        # equal sets have equal sizes and orders
        classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "regions", "deeper")])
        classes = tables.written(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
        label = _linked(docs, classes, width, percent, tables.written)
        own = F.coalesce("label", "v")
        named = tables.written(classes.join(label, "v", "left").select("k1", "k2", "rep", own.alias("label")), "labelled")
        lowest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        named = put(named.join(lowest, "label").select("k1", "k2", "label", "component_id"), "named")
    full = sets.select("doc_id", "th", "n", "k1", "k2")
    size = F.col("n").alias("n_shingles")
    out = full.where("n > 0").join(named, keys).select("doc_id", "th", size, "label", "component_id")
    empty = full.where("n = 0").select("doc_id", "th", size, F.lit(-1).cast("bigint").alias("label"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, forest: DataFrame, width: int, percent: int, put: Put) -> DataFrame:
    """(v, label) of the components of the classes in forest (v, n, rep, k1, k2, regions, deeper)."""
    links = label = None
    dense = None
    for first, last in ((0, FIRST), (FIRST, TREES)):
        rows = forest.select("v", "n", "rep", "k1", "k2", "regions", "deeper")
        rows = rows.withColumn("l", F.col("v")) if label is None else _labelled(rows, label, "v", "l")
        pairs, some = candidates(rows.select("v", "n", "l", "regions", "deeper"), percent, first, last, put)
        dense = some if dense is None else dense.unionByName(some)
        wanted = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).unionByName(some.select("v")).distinct()
        needed = forest.join(wanted, "v").select("v", "rep", "k1", "k2")
        texts = docs.join(needed, docs["doc_id"].eqNullSafe(needed["rep"])).select("v", "k1", "k2", "text")
        texts = put(_of_class(texts, width).dropDuplicates(["v"]), "texts")
        if label is None:
            links = put(confirm(pairs.where("pivot").select("a", "b"), texts, width, percent), "stars")
            label = components(links, put)
            others = pairs.where(~F.col("pivot"))
            for side in ("a", "b"):
                others = _labelled(others, label, side, f"l{side}")
            others = others.where("la <> lb")
        else:
            others = pairs  # all of them between what the first trees left apart
        found = put(confirm(others.select("a", "b"), texts, width, percent), "confirmed")
        links = links.unionByName(found)
        label = extended(label, found, put)
        every = texts if first == 0 else every.unionByName(texts)
    dense = put(dense, "dense")
    texts = put(every.join(dense.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"]), "texts")
    while True:
        more = put(confirm(_hub_pairs(dense, links, label, put), texts, width, percent), "hubs")
        label = extended(label, more, put)
        if more.count() < FEW_HUB_LINKS:
            break
        links = links.unionByName(more)
    return extended(label, put(_rest(dense, texts, label, width, percent, put), "hidden"), put)


def _of_class(texts: DataFrame, width: int) -> DataFrame:
    """(v, text) of the rows whose text has the set of the class; a repeated doc_id may have others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k1, text in zip(batch.column(1), batch.column(3), strict=True):
                both = xxhash.xxh3_128_digest(shingles(text.as_py(), width).tobytes())
                keep.append(np.frombuffer(both, dtype=np.int64)[0] == k1.as_py())
            yield batch.select(["v", "text"]).filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(run, "v bigint, text string")


def distinct(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept: one row of each component.

    It has the component's smallest doc_id; of several such rows those with the smallest hash of the text,
    and of these one. So repeated rows and copies under one doc_id leave one row, and a doc_id whose rows
    lie in several components a row in each where it is the smallest. A row without a word is kept, once
    for its doc_id.
    """
    with Scratch(docs.sparkSession, "distinct") as tables:
        kept = _classified(docs, width, percent, tables.written).where("kept")
        keys = kept.groupBy("doc_id", "label").agg(F.count("*").alias("c"), F.min("th").alias("th"))
        keys = written(keys.select(F.col("doc_id").alias("__id"), F.col("label").alias("__l"), F.col("th").alias("__th"), "c"), "kept")

    def rows(some: DataFrame, kind: str) -> DataFrame:
        return docs.join(some, docs["doc_id"].eqNullSafe(some["__id"]) & (F.xxhash64(docs["text"]) == some["__th"]), kind)

    out = rows(keys.where("c = 1"), "left_semi")
    several = keys.where("c > 1")
    if several.isEmpty():
        return out
    return out.unionByName(rows(several, "inner").dropDuplicates(["__id", "__l"]).select(*[docs[c] for c in docs.columns]))
