"""Packing: exact round trips, and cuts against an exhaustive search."""

import gc
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlspark.llm import packing, tokens
from trawlspark.llm.tokens import Encoder, encoder, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


def pad(n, limit):
    return 0 if n & (n - 1) == 0 else limit - n


def cost(cuts, penalties, limit, inside):
    total, before = 0.0, 0
    for cut in cuts:
        assert 0 < cut - before <= limit
        total += pad(cut - before, limit) + penalties.get(cut, inside) * (cut != cuts[-1])
        before = cut
    return total


def best_at_boundaries(ends, penalties, limit):
    found = {0: 0.0}
    for j in ends:
        options = [found[i] + pad(j - i, limit) for i in found if 0 < j - i <= limit]
        if options:
            found[j] = min(options) + (penalties[j] if j != ends[-1] else 0)
    return found.get(ends[-1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.booleans()), min_size=1, max_size=30), st.sampled_from([8, 16, 64]))
def test_cuts_are_no_worse_than_the_best_boundaries(steps, limit):
    ends = np.cumsum([n for n, _ in steps])
    weights = [0.0 if doc else 1.0 for _, doc in steps]
    penalties = dict(zip(ends.tolist(), weights, strict=True))
    cuts = packing.plan_cuts(ends, np.array(weights), limit, inside=5.0)
    assert cuts[-1] == ends[-1] and cuts == sorted(set(cuts))
    ours = cost(cuts, penalties, limit, 5.0)
    best = best_at_boundaries(ends.tolist(), penalties, limit)
    assert best is None or ours <= best + 1e-9


def test_every_id_once_and_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, "word. " * 30_000), (5, "again"), (None, "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    rows = packing.pack(docs, PATH, 1, with_ids=True).collect()
    library = encoder(PATH, False).library
    want = sorted(
        zlib.crc32(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
        for r in docs.collect()
    )
    # documents are whole when their pieces are put together in order
    got, open_doc = [], b""
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.array(r["ids"], dtype="<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert len(open_doc) == 4 * r["start"]
        open_doc += ids.tobytes()
        if r["start"] + r["length"] == r["doc_tokens"]:
            got.append(zlib.crc32(open_doc))
            open_doc = b""
    assert open_doc == b"" and sorted(got) == want
    lengths, before = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(lengths.values()) <= 2048
    assert sum(pad(n, 2048) for n in lengths.values()) < 0.01 * sum(lengths.values())
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])) if r["doc_id"] is not None]
    assert ordered == sorted(ordered)


def test_empty_and_clashing_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH, 1).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3)], "doc_id bigint, text string, offset int").withColumn("length", F.lit(1))
    row = packing.pack(clash, PATH, 1).collect()
    assert [(r["doc_id"], r["start"], r["length"]) for r in row] == [(1, 0, 2), (1, 2, 1)] or row[0]["length"] == 3


def test_cached_words_take_little_memory():
    own = Encoder(PATH, False)
    texts = [" ".join(f"word{i}" for i in range(k, k + 1000)) for k in range(0, 60_000, 1000)]
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for _ in own.encode(texts):
            pass
        gc.collect()
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 80 * 60_000


def test_ids_do_not_depend_on_the_cache(monkeypatch):
    """Known words, new ones, and a cache that is emptied between and within groups of texts."""
    own = Encoder(PATH, False)
    texts = ["one two. three", "two three, four\none", "four", "five six seven. eight nine ten", "one two. three"]
    want = [np.array(own.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for most in (1000, 8, 3):
        monkeypatch.setattr(tokens, "CACHE_WORDS", most)
        assert [next(own.encode([t])) for t in texts] == want and list(own.encode(texts)) == want
