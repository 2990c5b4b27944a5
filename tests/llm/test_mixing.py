"""Source mixing: targets, words taken, reruns."""

import re
from collections import defaultdict

import pytest

from trawlspark.llm import mixing

SCHEMA = "doc_id bigint, source string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def rows_of(spark):
    rows = [(i, f"s{i % 13}" if i % 11 else None, "w " * (1 + i * 7919 % 57)) for i in range(600)]
    rows += [(1000 + i, "hot", "h " * (i % 9)) for i in range(500)]
    rows += [(2000, "Ω", "one two three"), (2001, "😀", "x " * 5000), (2002, "zero", ""), (2003, "zero", None), (None, "s1", "a b"), (5, "s5", "again")]
    return rows


def test_words_taken(spark):
    rows = rows_of(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.shares(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    goal = plain_targets(dict(sizes))
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():
        assert abs(words - goal[source]) <= 1
    again = mixing.shares(docs.repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    made = mixing.materialise(docs).select("source", mixing.size_of().alias("n")).groupBy("source").sum("n").collect()
    assert {r[0]: r[1] for r in made} == {s: n for s, n in taken.items() if n}


def test_at_most_one_document_of_a_source_is_cut(spark):
    rows = [(i, "abc"[i % 3], "w " * 10) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(8, 1, 1)).collect()
    for source in "abc":
        own = [r["taken"] for r in got if r["source"] == source]
        assert sum(t % 10 > 0 for t in own) <= 1
        assert max(own) - min(own) <= 10 or source == "a"


def test_tilt_changes_documents_not_words(spark):
    rows = [(i, "ab"[i % 2], "w " * 10, 50.0 if i % 4 == 1 else 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA + ", likes double")
    even, tilted = mixing.mix(docs, share=1.2), mixing.mix(docs, share=1.2, tilt="likes")
    words = [r.groupBy("source").sum("taken").orderBy("source").collect() for r in (even, tilted)]
    assert words[0] == words[1]
    liked = [r.where("doc_id % 4 = 1 and source = 'b'").selectExpr("sum(taken)").first()[0] for r in (even, tilted)]
    assert liked[1] > liked[0]


def test_empty_and_extra_columns(spark):
    assert mixing.shares(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a", "x y", 9, 8)], SCHEMA + ", size int, target int")
    assert mixing.shares(clash).first()["size"] == 2
    assert mixing.materialise(clash).columns == clash.columns
