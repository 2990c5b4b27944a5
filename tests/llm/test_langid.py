"""Language identification: held-out accuracy, and defined results at the edges."""

import numpy as np
from pyspark.sql import functions as F

from trawlspark.llm import langid, queries

SCHEMA = "doc_id bigint, text string, lang string"


def test_held_out_accuracy_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op1_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = out.join(truth, "doc_id").where("held_out and n > 40").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.985
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_label_and_source_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    a = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    other = docs.withColumn("lang", F.lit("zz"))
    b = {r["doc_id"]: r["lang_pred"] for r in langid.identify(other, model).collect()}
    assert a == b and "zz" not in b.values()


def test_edges(spark):
    rows = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    odd = [(1, None, "en"), (2, "", None), (3, "12 !? 🙂", "en"), (None, "the dog and the cat", None), (5, "the " * 500_000, "de")]
    odd += [(6, "der hund", "en"), (6, "der hund", "en")]
    extra = spark.createDataFrame([(*r, 0.5, "x") for r in odd], SCHEMA + ", score double, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(extra, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (6, "de"), (6, "de")]
    nobody = langid.identify(docs, langid.learn(docs.where("false")))
    assert {r["lang_pred"] for r in nobody.collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_even(spark):
    rows = [(i, "text a", "en") for i in range(900)] + [(i, "text b", "de") for i in range(1000, 1100)]
    got = langid.sample(spark.createDataFrame(rows, SCHEMA), 60).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 30, "de": 30}


def test_codewords_correct_errors():
    code = langid.codewords(4)
    assert code.shape == (4, 7)
    wide = langid.codewords(20)
    apart = [(a != b).sum() for i, a in enumerate(wide) for b in wide[:i]]
    assert min(apart) >= wide.shape[1] // 4
    model = langid.Model(list("abcd"), code, np.eye(7, dtype=np.float32), np.zeros(7, np.float32), np.ones(7, np.float32))
    for i, word in enumerate(code):
        broken = 4 * word.copy()
        broken[i] *= -1
        best, score, unsure = model.decode(broken[None])
        assert best[0] == i and score[0] > 0.5
    assert model.decode(np.zeros((1, 7), np.float32))[2][0]
