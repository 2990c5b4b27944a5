"""Blocks of token ids: exact round trips."""

import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawlspark.llm import idblocks, tokens
from trawlspark.llm.tokens import Encoder, vocabulary_path
from trawlspark.session import work_folder

PATH = vocabulary_path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([8, 64, 512]))
def test_segment_round_trip(values, block):
    ids = np.array(values, dtype=np.uint32)
    data = idblocks.encode_blocks(ids, block)
    assert (idblocks.decode_blocks(data) == ids).all()
    assert (idblocks.decode_blocks(data, 1, 2) == ids[block : 2 * block]).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(512, 7, dtype=np.uint32)
    ids[5::100] = 4_000_000_000
    assert len(idblocks.encode_blocks(ids)) < 100
    assert (idblocks.decode_blocks(idblocks.encode_blocks(ids)) == ids).all()


def test_damage_is_found():
    data = idblocks.encode_blocks(np.arange(1000, dtype=np.uint32))
    with pytest.raises(ValueError):
        idblocks.decode_blocks(data[:-1])
    with pytest.raises(ValueError):
        idblocks.decode_blocks(b"XXXX" + data[4:])


@pytest.mark.parametrize("drops_space, name", [(True, "word_bpe_49k.json"), (False, "byte_bpe_50k.json")])
def test_cached_words_equal_whole_texts(drops_space, name):
    library = Encoder(vocabulary_path(name), drops_space)
    rng = np.random.default_rng(0)
    parts = ["a", "Word", " and", "'s", ".", ",\n", "\n\n", "  ", "12", "é", "İ", "\xa0", "\x1c", "漢", "🙂", "²", "<|endoftext|>", "\t"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)]
    for text, found in zip(texts, library.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.library.encode(text, add_special_tokens=False).ids


def test_written_and_read(spark):
    docs = [(5, "Hello there"), (2, None), (9, ""), (7, "long text here. " * 20_000), (None, "no id"), (2, "again"), (3, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS shard")
    path = work_folder(spark, f"ids-{uuid.uuid4().hex}")
    idblocks.write_ids(df, path, PATH, True, 2)
    library = Encoder(PATH, True).library
    got = idblocks.read_ids(spark, path).collect()
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 2, 3, 5, 7, 9]
    want = {}
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(doc, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    empty = work_folder(spark, f"ids-{uuid.uuid4().hex}")
    idblocks.write_ids(df.where("false"), empty, PATH, True, 2)
    assert idblocks.read_ids(spark, empty).count() == 0


def test_words_of_letters_and_signs_need_the_model_only():
    enc = Encoder(vocabulary_path("byte_bpe_50k.json"), False)
    words = [" und", "Word", " grüße", "ñandú***", " ab%%%", " x$", " ĳssel-", " a(b", " 12", " don't", " Σ", "&&&"]
    found, rest = enc._modelled(words)
    assert rest == words[7:]
    for word, ids in found.items():
        assert np.frombuffer(ids, "<u4").tolist() == enc.library.encode(word, add_special_tokens=False).ids
    texts = ["und Word, so. Grüße\nneu***", "", "a  b\n\n", "und so"] * 3
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


def test_plain_words_of_the_word_vocabulary_need_the_model_only(monkeypatch):
    enc = Encoder(PATH, True)
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0x250)) if chr(c).isalpha() and c != 0x130]
    words = ["und", "Word", "GRÜSSE", "Ñandú***", "ab%%%", "x$", "Ĳssel-", "a(b", "12", "don't", "Σ", "&&&", "e\u0301", ""]
    found, rest = enc._modelled([*words, *letters, *["a" + x + "B" for x in letters]])
    assert rest == words[7:]
    for word, ids in found.items():
        assert np.frombuffer(ids, "<u4").tolist() == enc.library.encode(word, add_special_tokens=False).ids
    texts = ["Und  Word, so. Grüße\n\tneu***", "", " \n", "a  b\n\n", "und so\r\n", "Z_. x", "H\u0331. \u1e96 E\u0301 ok"] * 3
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    monkeypatch.setattr(Encoder, "_letters", lambda self, word: asked.append(word))
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    # known words are Arrow columns, and the library is asked for the others alone
    assert not enc.words and len(enc.marked[0]) == len(set(enc.marked[0].to_pylist()))
    assert asked and not any(w.isascii() and w.isalpha() for w in asked)


@pytest.mark.parametrize("drops_space, name", [(True, "word_bpe_49k.json"), (False, "byte_bpe_50k.json")])
def test_slices_groups_and_a_full_cache_change_no_ids(drops_space, name, monkeypatch):
    for limit, value in (("BATCH", 40), ("GROUP", 400), ("CACHE_WORDS", 25), ("LEARNED", 7)):
        monkeypatch.setattr(tokens, limit, value)
    enc = Encoder(vocabulary_path(name), drops_space)
    rng = np.random.default_rng(1)
    parts = ["ein", "Wort", "\xe9", "\xc9", "e\u0301", "H\u0331", " ", "  ", "\n", "\t", ". ", ", ", "'s", "***", "_", "7", "\u03a3", "\u6f22", "<|endoftext|>", "?", "\u017f"]
    texts = ["".join(rng.choice(parts, rng.integers(0, n))) for n in (*[40] * 300, *[600] * 20)] + ["n" * 900, None]
    texts += ["".join(rng.choice(["\xa0", "a", " "], 30)) for _ in range(20)]
    for text, found in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == enc.library.encode(text or "", add_special_tokens=False).ids
