"""Exact top-k against brute force."""

import math
import random

import numpy as np
import pytest

from trawlspark.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    fine = []
    for vec_id, x, _ in rows:
        if vec_id is not None and x and all(v is not None and math.isfinite(v) for v in x):
            fine.append((vec_id, [math.floor(64 * float(np.float32(v))) for v in x]))
    out = []
    for q, x in fine:
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), c) for c, y in fine if c != q and len(y) == len(x)]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "large", "few"])
def test_equals_brute_force(spark, case):
    rng = random.Random(case)
    n = 9 if case == "few" else 350
    size = {"plain": 0.3, "ties": 0.02, "large": 3e5, "few": 1.0}[case]
    rows = [(i, [rng.gauss(0, size) for _ in range(40)], 0) for i in range(n)]
    rows += [(1000, None, 0), (1020, [1.0, None], 0), (1040, [float("nan")] * 40, 0), (1060, [float("inf")] + [0.0] * 39, 0)]
    rows += [(1080, [0.5, -0.5], 0), (1081, [1.0, 1.0], 0), (None, [1.0] * 40, 0), (1100, [], 0), (1120, [0.0] * 40, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS score", "2 AS dim")
    got = sorted(tuple(r) for r in topk.search(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows)


def test_bound_never_loses_a_candidate():
    rng = np.random.default_rng(4)
    for compact in (0.05, 1.0):
        topk.COMPACT, before = compact, topk.COMPACT
        q, c = rng.integers(-30, 30, (64, 11)), rng.integers(-30, 30, (64, 500))
        c[20:] //= 8
        full = q.T @ c
        floor = np.sort(full, axis=1)[:, -5].astype(float)
        a, b, s = topk.best(np.arange(-11, 0), q, np.arange(500), c, 5, floor)
        for i in range(11):
            want = sorted((-full[i, j], j) for j in range(500))[:5]
            assert [(-v, j) for v, j in zip(s[a == i], b[a == i])] == want
        topk.COMPACT = before


def test_huge_numbers_and_empty_table(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 0.0], 0), (2, [-1e30, 5.0], 0)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2] and got[0]["score"] == 2**63 - 1
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0
