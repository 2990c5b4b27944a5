"""The prefix trie against a plain version, with many shards and with one."""

import hashlib
import random
import zlib

import pytest

from trawlspark.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, path in sorted(rebuilt.items()):
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ids = ",".join(map(str, ends.get(p, [])))
        out.append((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs),
            sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    found = prefixtrie.nodes(prefixtrie.regrafted(spark.createDataFrame(rows, SCHEMA)))
    assert found.columns == prefixtrie.RESULT
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("parts", ["1", "23"])
def test_hot_prefixes_and_copies(spark, monkeypatch, parts):
    """A third of the conversations is equal, a third shares its first turns; runs of two members."""
    rng = random.Random(4)
    rows = []
    for c in range(-40, 260):
        n = rng.randrange(1, 12)
        kind = rng.random()
        for t in range(n if kind > 0.3 else 7):
            text = f"same {t}" if kind < 0.3 or (kind < 0.6 and t < 4) else rng.choice(["", "é\u4e00", "b", "longer text"])
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rng.shuffle(rows)
    monkeypatch.setattr(prefixtrie, "BLOCK_BITS", 1)
    monkeypatch.setattr(prefixtrie, "SAMPLES", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    """Nulls, ties, repeated rows, absent first conversations, turnless results, one very long conversation."""
    rows = [
        (None, 0, "user", "x"), (3, None, None, None), (3, None, None, None), (3, 1, "a", "b"), (3, 1, "b", "a"), (5, 0, "u", ""),
        (7, 0, "u", None), (7, 0, "u", ""), (-3, 2, "u", "x"), (-3, 1, "u", "y"), (9, 0, "ua", "b"), (14, 0, "u", "ab"), (2**62, 0, "u", "ab"),
    ]
    check(spark, rows)
    check(spark, [(c, 0, "u", "only") for c in range(1, 200, 5)])
    check(spark, [(10, t, "u", str(t)) for t in range(60)] + [(20, t, "u", str(t)) for t in range(59)])
    check(spark, [])


def test_extra_columns(spark):
    rows = [(1, 0, "u", "a", 1, "p"), (2, 0, "u", "a", 2, "q")]
    df = spark.createDataFrame(rows, SCHEMA + ", token int, path string")
    assert sorted((tuple(r) for r in prefixtrie.nodes(prefixtrie.regrafted(df)).collect()), key=str) == plain([r[:4] for r in rows])


def test_skeleton_is_made_of_proper_prefixes():
    def path(*turns):
        return b"".join(t.encode().ljust(16, b".") + (1).to_bytes(8, "big") for t in turns)

    sample = [path("a", "b", "c"), path("a", "b", "d"), path("a", "b", "d", "e"), path("b"), path("c", "x" * 9)]
    cuts = prefixtrie.splitters(sample, 5)
    assert cuts == sorted(cuts) and path("a", "b", "d") in cuts
    made = prefixtrie.Skeleton(cuts)
    assert len(made.parent) == len({c[:i] for c in cuts for i in range(0, len(c), prefixtrie.TOKEN)})
    assert [made.shard(p) for p in sample] == sorted(made.shard(p) for p in sample)
