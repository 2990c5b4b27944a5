"""Quality rules against plain Python over whole texts."""

import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawlspark.llm import quality

SCHEMA = "doc_id bigint, lang string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(spark, texts):
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality.assess(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_counts(spark):
    line = "a b c d e f g h i j k l m\n"
    texts = [None, "", " \n\t", "one", line * 3, "x y " * 50, "ä#é **\x0b|b<\n \nä#é **\x0b|b<\n", "w " * 4, "w " * 5, "w " * 6]
    texts += [" ".join(str(i % k) for i in range(400)) for k in (7, 90, 399)]
    texts += [" ".join(f"{i}" for i in range(300)) + " " + " ".join(f"{i}" for i in range(40, 120))]
    texts += [" wide space\x85 other \x1c sep", "🙂 " * 30]
    check(spark, texts)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n\t#é")), max_size=120), min_size=30, max_size=30))
def test_counts_of_random_texts(spark, texts):
    check(spark, texts)


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = [3, 0, 5, 2], [0.1, 0.4, 0.5, 0.0]

    def entropy(x):
        return -sum(v * math.log2(v) for v in x if v)

    share = [v / 10 for v in p]
    middle = [(a + b) / 2 for a, b in zip(share, q)]
    want = math.sqrt(entropy(middle) - (entropy(share) + entropy(q)) / 2)
    row = spark.range(1).select(quality.distance([F.lit(v) for v in p], F.lit(10), q).alias("d")).first()
    assert row["d"] == pytest.approx(want, abs=1e-9)


def test_verdict_and_edges(spark):
    clean = "The cat sat on the mat and the dog was with it for the day as they are in the house. " 
    words = [f"{clean} {i} that is {i * 7} to be of {i * 3} by " for i in range(6)]
    junk = " ".join(f"%%{i}**|#{i}&&" for i in range(120))
    rows = [(i, "en", "".join(words[i % 5 :]).replace("cat", f"cat{i}")) for i in range(40)]
    one = "the of and to in is that it for was on with as by at be this are have not "
    rows = [(i, "en", " ".join(f"{w} thing{i}{k}" for k, w in enumerate(one.split() * 3))) for i in range(40)]
    rows += [(100, "en", junk), (101, None, rows[3][2]), (None, "en", rows[4][2]), (102, "en", None), (7, "en", rows[7][2])]
    out = quality.assess(spark.createDataFrame(rows, SCHEMA))
    kept = {(r["doc_id"], r["kept"]) for r in out.collect()}
    assert (100, False) in kept and (102, False) in kept
    assert {(i, True) for i in range(40)} | {(101, True), (None, True)} <= kept
    assert len(out.collect()) == len(rows)
    empty = quality.assess(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    unlabelled = quality.assess(spark.createDataFrame([(1, None, rows[0][2])], SCHEMA)).first()
    assert unlabelled["kept"] and unlabelled["class_distance"] is None
    clash = spark.createDataFrame([(1, "en", rows[0][2], 5, "x")], SCHEMA + ", n_words int, kept string")
    assert quality.assess(clash).first()["n_words"] > 50


def test_rare_language_has_its_own_reference(spark):
    """A language far below MIN_REFERENCE_SHARE, in another script."""
    rows = [(i, "en", " ".join(f"the word{i}x{k} of" for k in range(2000))) for i in range(60)]
    rare = " ".join("абвгдежз"[k % 8] * (1 + k % 5) + "клмнопрст"[k % 9] * 4 + "уфхцч"[k // 9 % 5] for k in range(60))
    rows += [(100, "xx", rare), (101, None, rare)]
    out = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 62 and out[100]["kept"] and out[100]["class_distance"] < 1e-6
    assert not out[100]["base_failed"] and out[101]["class_distance"] > quality.MAX_CLASS_DISTANCE
