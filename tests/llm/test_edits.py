"""Edited token counts equal those of encoding the edited text anew."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trawlspark.llm import edits, tokens
from trawlspark.llm.tokens import Encoder, encoder, vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


def full(text):
    return len(encoder(PATH, False).library.encode(text, add_special_tokens=False).ids)


def replaced(text, start, length, insert):
    start = min(max(start, 0), len(text))
    return text[:start] + insert + text[start + max(length, 0) :]


TEXT = st.text(alphabet=st.sampled_from(list("ab'sé. \n\t1\xa0\x1c🙂")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 70), st.integers(-1, 20), TEXT), max_size=6))
def test_tree_equals_full_encoding(text, changes):
    tree = edits.TokenTree(text, encoder(PATH, False))
    assert tree.tokens == full(text)
    for start, length, insert in changes:
        tree.edit(start, length, insert)
        text = replaced(text, start, length, insert)
        assert (tree.text, tree.chars, tree.tokens) == (text, len(text), full(text))


def test_small_edit_of_long_text_encodes_little():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(20_000))
    tree = edits.TokenTree(text, encoder(PATH, False))
    for _ in range(200):
        at = rng.randrange(len(text))
        tree.edit(at, 5, "new words ")
        text = replaced(text, at, 5, "new words ")
    assert tree.text == text and tree.tokens == full(text)
    assert tree.encoded < 200 * 100


def test_plain_texts_are_counted_in_arrow_columns():
    library = Encoder(PATH, False)
    text = " ".join(f"w{a}x{b}, next.\nLine" for a in range(30) for b in range(30))
    tree = edits.TokenTree(text, library)
    assert tree.tokens == full(text) and not library.words and len(library.marked[0]) > 900
    tree.edit(100, 3, "zz")
    assert tree.tokens == full(replaced(text, 100, 3, "zz")) and len(library.words) < 10
    known = len(library.marked[0])  # one short text does not look through all of them
    assert edits.TokenTree("few words.", library).tokens == full("few words.") and len(library.marked[0]) == known


PLAIN = st.text(alphabet=st.sampled_from(list("aé1.,* \n")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, PLAIN, st.lists(st.sampled_from(["ab", "é.", "x,", "7", "b*\nÀ"])).map(" ".join)), max_size=8))
def test_pieces_of_texts_have_their_sizes(texts):
    library = encoder(PATH, False)
    for text, (chars, ids) in zip(texts, library.sizes(texts), strict=True):
        pieces = library.pieces(text)
        assert chars.tolist() == [len(p) for p in pieces] and ids.tolist() == [full(p) for p in pieces]


def test_long_texts_and_a_full_cache_change_no_counts(monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé.,", k=rng.randint(1, 9))) for _ in range(600)]
    texts = ["  ".join(words), " ".join(words), " ".join(f"{w.strip('.,')}a." for w in words), "", "a\x1cb " * 50, "x. y"]
    for batch, room in ((400_000, 50), (100, 50), (100, 1_000_000)):
        monkeypatch.setattr(tokens, "BATCH", batch)
        monkeypatch.setattr(tokens, "CACHE_WORDS", room)
        library = Encoder(PATH, False)
        for text, (chars, ids) in zip(texts, library.sizes(texts), strict=True):
            assert chars.tolist() == [len(p) for p in library.pieces(text)] and ids.sum() == full(text)
        for text in texts:
            tree = edits.TokenTree(text, library)
            for at in (0, 7, 300, 5000):
                tree.edit(at, 4, "new, word")
                text = replaced(text, at, 4, "new, word")
            assert (tree.text, tree.tokens) == (text, full(text))


def test_rows_of_several_batches(spark):
    """Copies of one document, documents without edits and texts counted together, cut at any batch."""
    docs = [(i // 3, f"some text, number {i % 2}.\nEnd of {i // 3}") for i in range(40)]
    log = [(i, k, 3 * k, 2, "in, s") for i in range(0, 14, 2) for k in range(5)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    found = []
    for rows in ("10000", "3"):
        spark.conf.set(size, rows)
        try:
            got = edits.edited_counts(
                spark.createDataFrame(docs, "doc_id bigint, text string"),
                spark.createDataFrame(log, "doc_id bigint, seq int, start int, length int, insert string"),
                PATH,
            ).collect()
        finally:
            spark.conf.set(size, before)
        found.append(sorted(tuple(r)[:5] for r in got))
    want = []
    for doc, text in docs:
        after, n = text, 0
        for _, _, start, length, insert in (e for e in log if e[0] == doc):
            after, n = replaced(after, start, length, insert), n + 1
        want.append((doc, n, full(text), full(after), len(after)))
    assert found == [sorted(want)] * 2


def test_query_over_rows(spark):
    docs = [(1, "one two three"), (2, None), (3, ""), (None, "free text"), (4, "same"), (4, "same"), (4, "other one"), (5, "word " * 3000)]
    log = [
        (1, 0, 4, 3, "2"), (1, 1, 0, 0, "zero "), (2, 0, 0, 5, "begin"), (3, None, None, None, None), (4, 1, 2, 1, "\n"),
        (9, 0, 0, 0, "nobody"), (None, 0, 0, 0, "null"), (5, 2, 9, 9, "z" * 9000),
    ]
    got = edits.edited_counts(
        spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS seq", "'x' AS insert"),
        spark.createDataFrame(log, "doc_id bigint, seq int, start int, length int, insert string"),
        PATH,
    ).collect()
    want = []
    for doc, text in docs:
        after, n = text or "", 0
        for _, _, start, length, insert in sorted((e for e in log if e[0] is not None and e[0] == doc), key=lambda e: e[1] or -1):
            after, n = replaced(after, start or 0, length or 0, insert or ""), n + 1
        want.append((doc, n, full(text or ""), full(after), len(after)))
    key = lambda r: str(r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert edits.edited_counts(empty, spark.createDataFrame(log, "doc_id bigint, seq int, start int, length int, insert string"), PATH).count() == 0
