"""Spelling variants against a plain version; hashes of edits against hashes of edited words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trawlspark.llm import variants

SCHEMA = "doc_id bigint, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, out = {}, []
    found = {w: [o for o in words if o != w and near(w, o)] for w in words}
    for w, others in found.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 10 * words[w] else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, n, len(found[w]), forms[w], words.get(forms[w]), root))
    return sorted(out, key=str)


def check(spark, rows):
    found = variants.grouped(spark.createDataFrame(rows, SCHEMA))
    got = found.select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    return got


def texts(rng):
    base = ["reading", "cartographer", "éàèöüßÿ", "aaaaaaaa", "x" * 70, "y" * 63, "naïveté×÷À", "wordless"]
    rows = []
    for doc in range(60):
        words = []
        for w in base:
            words += [w] * rng.choice((1, 1, 1, 40))
            for _ in range(4):
                at, c = rng.randrange(len(w)), rng.choice("abé÷")
                words.append(rng.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :])))
        # chains of forms: 1 -> 10 -> 100 times as frequent
        words += ["chainaa"] * 120 + ["chainab"] * 9 + ["chainbb"] * (doc % 2)
        rng.shuffle(words)
        rows.append((doc if doc % 9 else None, rng.choice((" ", "-", "1")).join(words).upper() if doc % 5 == 0 else " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_version(spark, monkeypatch, small):
    """small: filters in many parts, words in slices, counts passed on early."""
    if small:
        monkeypatch.setattr(variants, "FILTER_BYTES", 8 * 5000)
        monkeypatch.setattr(variants, "CHUNK", 64)
    got = check(spark, texts(random.Random(6)))
    assert any(r["root"] != r["word"] and r["root"] != r["form"] for r in got)


def test_edges(spark, monkeypatch):
    rows = [
        (1, None), (2, ""), (None, "Reading reading READING"), (3, "short short"), (3, "twice-only twiceonly twiceonly"), (3, "twiceonly"),
        (4, "a" * 3000 + " " + "a" * 3000), (5, "a" * 2999 + "b " + "a" * 2999 + "b " + "a" * 2999), (5, "a" * 2999),
        (6, "Ｆullwidth ĀĀĀĀĀĀĀĀ æøåÆØÅð æøåÆØÅð"), (6, "1234567 1234567"),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])
    clash = spark.createDataFrame([(1, "reading reading", 2, "w")], SCHEMA + ", n int, word string")
    assert [tuple(r)[:2] for r in variants.vocabulary(clash).collect()] == [("reading", 2)]


def test_slices_of_long_words_and_texts(monkeypatch):
    words = ["abcabcabc" * 5, "aabbccddee", "é" * 11 + "z", "abcdefg", "abcdefgh"]
    layout = variants.Layout.of({variants.shard(n): 40 for n in (7, 8, 9, 10, 11, 12, 44, 45)})
    every = np.full(layout.total, (1 << 64) - 1, dtype=np.uint64)
    letters = [ord(c) for c in "abcé"]
    want = set()
    for k, w in enumerate(words):
        for i, c in enumerate(w):
            if len(w) > 7:
                want.add((k, w[:i] + w[i + 1 :]))
            want |= {(k, w[:i] + chr(o) + w[i + 1 :]) for o in letters if o > ord(c)}
    for cells in (500_000, 7):
        monkeypatch.setattr(variants, "CELLS", cells)
        found = [(int(i), e) for i, e in variants._edits(words, layout, every, 0, layout.total, letters)]
        assert len(found) == len(set(found)) and {f for f in found if f[0] != 0} == {w for w in want if w[0] != 0}
        assert {f for f in found if f[0] == 0} == {w for w in want if w[0] == 0}
    # what an edit hashes to is what the edited word hashes to: a filter with the edited words lets all through
    only = np.zeros(layout.total, dtype=np.uint64)
    for _, e in want:
        place, bits = layout.probes(variants.shard(len(e)), variants.hashes(np.array([[ord(c) for c in e]], dtype="<u4")))
        only[place] |= bits
    found = {(int(i), e) for i, e in variants._edits(words, layout, only, 0, layout.total, letters)}
    assert found >= want and len(found) < 2 * len(want)
    monkeypatch.setattr(variants, "PART", 10)
    assert [w for part in variants._runs("one seventh eleventh-letters") for w in part] == ["seventh", "eleventh", "letters"]
