"""SimHash near duplicates against a plain version and all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlspark.llm import simhash

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xxh64(data, seed=42):
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    m = (1 << 64) - 1

    def left(x, n):
        return ((x << n) | (x >> (64 - n))) & m

    def one(acc, lane):
        return left((acc + lane * p2) & m, 31) * p1 & m

    i, n = 0, len(data)
    if n >= 32:
        v = [(seed + p1 + p2) & m, (seed + p2) & m, seed, (seed - p1) & m]
        while i + 32 <= n:
            for k in range(4):
                v[k] = one(v[k], int.from_bytes(data[i + 8 * k : i + 8 * k + 8], "little"))
            i += 32
        h = (left(v[0], 1) + left(v[1], 7) + left(v[2], 12) + left(v[3], 18)) & m
        for x in v:
            h = ((h ^ one(0, x)) * p1 + p4) & m
    else:
        h = (seed + p5) & m
    h = (h + n) & m
    while i + 8 <= n:
        h = (left(h ^ one(0, int.from_bytes(data[i : i + 8], "little")), 27) * p1 + p4) & m
        i += 8
    if i + 4 <= n:
        h = (left(h ^ (int.from_bytes(data[i : i + 4], "little") * p1 & m), 23) * p2 + p3) & m
        i += 4
    for b in data[i:]:
        h = left(h ^ (b * p5 & m), 11) * p1 & m
    h = (h ^ (h >> 33)) * p2 & m
    h = (h ^ (h >> 29)) * p3 & m
    return h ^ (h >> 32)


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxh64(s.encode()) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_of(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in values}


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = components_of(fps)
    least = {}
    for (doc, _), f in zip(rows, fps, strict=True):
        if doc is not None:
            least[comp[f]] = min(doc, least.get(comp[f], doc))
    return sorted(((d, f"{f:016x}", least.get(comp[f])) for (d, _), f in zip(rows, fps, strict=True)), key=str)


def check(spark, rows):
    got = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == brute(rows)


def test_texts(spark):
    rng = random.Random(2)
    rows = []
    for size in (1, 1, 2, 5, 30, 60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((5, 80, 300)))]
        for _ in range(size):
            words = [f"X{rng.randrange(99)}" if rng.random() < 0.01 else w for w in base]
            rows.append((len(rows) * 7 % 101 + 1000 * size, " ".join(words)))
    check(spark, rows)


def test_edges(spark, monkeypatch):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One\ttwo\n"), (None, "one two"), (None, "alone here"),
        (8, "É a"), (9, "é a"), (10, "a b " * 3000), (11, "b a " * 3000), (12, "a b c"), (12, "a b c"), (12, "c d e"), (13, "x\x0by\x0cz\x1cq\u2003r s"),
    ]
    check(spark, rows)
    monkeypatch.setattr(simhash, "PART", 50)
    monkeypatch.setattr(simhash, "_SLICE", 7)
    for _, text in rows:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, 5), (2, "a b", 4, 6)], SCHEMA + ", fp int, place int")
    assert [r["component_id"] for r in simhash.deduplicate(clash).collect()] == [1, 1]


def family(rng, centre, n, flips):
    return {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(n)}


@pytest.mark.parametrize("small", [False, True])
def test_all_links_of_dense_families(spark, monkeypatch, small):
    """Chains, dense families, far values; small: cells spread over chunks, tasks and bands."""
    rng = random.Random(9)
    fps = family(rng, rng.getrandbits(64), 300, 4) | family(rng, rng.getrandbits(64), 200, 8) | family(rng, 0, 100, 3)
    fps |= {rng.getrandbits(64) for _ in range(300)} | {(1 << 64) - 1, ((1 << 64) - 1) ^ 7}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= sum(1 << k for k in rng.sample(range(64), 3))
        fps.add(chain)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(7)
    if small:
        for name, value in (("CELL", 8), ("CHUNK", 64), ("PAIRS", 50)):
            # workers read the values of a plain function's globals
            monkeypatch.setattr(simhash, name, value)
        rows = np.array([simhash.places(np.array([f], dtype=np.uint64))[0] for f in sorted(fps)])
        got = []
        for k in range(rows.shape[1]):
            order = np.lexsort((np.array(sorted(fps), dtype=np.uint64), rows[:, k]))
            place, fp = rows[order, k], np.array(sorted(fps), dtype=np.uint64)[order]
            import pyarrow as pa

            size = 23
            batches = [
                pa.RecordBatch.from_arrays([pa.array(place[i : i + size]), pa.array(fp[i : i + size].view(np.int64))], names=["place", "fp"])
                for i in range(0, len(fp), size)
            ]
            found = [r for b in simhash._scan(iter(batches)) for r in b.to_pylist()]
            got += [(r["a"], r["b"]) for r in found if r["a"] is not None]
            later = [(r["place"], r["fp"]) for r in found if r["place"] is not None]
            assert later and len(set(later)) == len(later)
            by = {}
            for p, f in later:
                by.setdefault(p, []).append(f)
            for p, own in by.items():
                far = [f for up in range(4) for f in by.get(p + up, [])]
                a, b = simhash._meet(np.array(own).view(np.uint64), np.array(far).view(np.uint64))
                got += list(zip(a.tolist(), b.tolist(), strict=True))
            if k == 0:
                bands = simhash._bands(spark.createDataFrame(later, "place bigint, fp bigint"))
                assert components_of_links(signed, [tuple(r) for r in bands.collect()]) == components_of_links(
                    signed, [x for p, own in by.items() for x in pairs(own, [f for up in range(4) for f in by.get(p + up, [])])]
                )
    else:
        got = [tuple(r) for r in simhash.links(frame).collect()]
        assert all(((a ^ b) & ((1 << 64) - 1)) for a, b in got)
    want = components_of([f & ((1 << 64) - 1) for f in signed])
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    made = {}
    for f, c in components_of_links(signed, got).items():
        made.setdefault(c, set()).add(f & ((1 << 64) - 1))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, made.values()))


def pairs(own, far):
    return [(a, b) for a in own for b in far if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]


def components_of_links(values, links):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_hash_is_that_of_spark(spark):
    texts = ["", "a", "one two three", "é\u4e00 b c", "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] & ((1 << 64) - 1) for r in got] == [xxh64(t.encode()) for t in texts]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()][:60]
    check(spark, rows)
