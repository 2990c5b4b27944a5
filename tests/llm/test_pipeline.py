"""The pipeline stage by stage, against plain versions of each stage's decision."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from trawlspark.llm import langid, mixing, quality
from trawlspark.llm.stage import written
from trawlspark.llm.tokens import encoder, vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns


def test_filters(stages):
    start, good, known, unique, mixed, _ = stages
    kept = {r["doc_id"] for r in quality.assess(start).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    model = langid.learn(good.select("doc_id", "text", "lang"))
    sure = {r["doc_id"] for r in langid.identify(good, model).where("not ambiguous").collect()}
    assert {r["doc_id"] for r in known.collect()} == sure and len(sure) > 0.95 * len(kept)


def test_one_document_of_each_group_stays(stages):
    rows = [tuple(r) for r in stages[2].select("doc_id", "text").collect()]

    def shingles(text):
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in text.encode().decode().split()]
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}

    sets = {doc: shingles(text) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert {r["doc_id"] for r in stages[3].collect()} == {find(doc) for doc in sets}


def test_mix_and_packing(stages):
    unique, mixed, packed = stages[3:]
    taken = {r[0]: r[1] for r in mixing.shares(unique).groupBy("source").sum("taken").collect()}
    words = mixed.groupBy("source").agg(F.sum(mixing.size_of())).collect()
    assert {r[0]: r[1] for r in words} == {s: n for s, n in taken.items() if n}
    library = encoder(vocabulary_path("byte_bpe_50k.json"), False).library
    want = sorted(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    pieces = packed.collect()
    assert sum(r["length"] for r in pieces) == sum(want)
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in pieces)


def test_run_is_the_stages(spark, stages):
    got = pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, stages[-1].select(key).collect()))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
