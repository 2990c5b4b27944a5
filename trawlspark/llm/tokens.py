"""Token ids of whole texts, with a bounded cache of what single words encode to.

Both vocabularies here split a text before merging, and never across the place where a word ends and
white space begins. So a text's ids are those of its words, each with the white space before it, one
after the other; the library encodes only words that are not in the cache. Texts with white space
outside ASCII, with control characters that the splitters read differently, or with the one letter
(U+0130) whose small form ends in a mark, are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in a worker's cache; it is emptied when full.
CACHE_WORDS = 1_400_000
#: Code points of a slice of a long text, and of texts that are encoded together: as Python strings, as an Arrow column.
BATCH = 400_000
GROUP = 10_000_000
#: New words that are Python objects at once, on their way to the Arrow columns.
LEARNED = 100_000
_SPACED = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$")
# Both vocabularies also split between a letter or digit and a stop.
_STOP = re.compile(r"(?<=[^\W_])(?=[.,;:!?])")
_STOPS = ".,;:!?"
# Letters, then signs: a byte vocabulary's splitter makes these one part each. These letters are as old as Unicode.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
# Plain searches for single characters are several times faster than a class of them.
_ODD = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u0130\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _stops_stand_alone(text: str, spaces: bool) -> bool:
    """Is there a letter or digit before each stop (or white space, or the text's start)? Elsewhere a split
    before it would change the pre-tokens."""
    for stop in _STOPS:
        if stop in text:
            before = [part[-1:] for part in text.split(stop)[:-1]]
            if spaces and not before[0]:
                before[0] = " "
            if not all([c.isalnum() or spaces and c.isspace() for c in before]):
                return False
    return True


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. drops_space: the vocabulary drops white space."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(True)
        self.bytes_of = [i.to_bytes(4, "little") for i in range(size)]
        # ids whose token ends a word, or in a byte vocabulary begins with a space
        mark = str.endswith if drops_space else str.startswith
        self.border = np.zeros(size, dtype=bool)
        for token, i in self.library.get_vocab(True).items():
            self.border[i] = mark(token, "</w>" if drops_space else "\u0120")
        self.words: dict[str, bytes] = {}
        # marked words and their ids, as Arrow columns: a tenth of the memory of Python objects
        self.marked = (pa.array([], pa.string()), pa.array([], pa.binary()))
        self.drops_space = drops_space

    def whole(self, text: str) -> bool:
        """Must the text be encoded as a whole?"""
        return any(c in text for c in (_ODD[:4] if text.isascii() else _ODD))

    def pieces(self, text: str) -> list[str]:
        """Parts that can be encoded one by one; they make up the text unless white space is dropped."""
        if self.whole(text):
            return [text]
        if self.drops_space:
            return text.split()  # white space here is that of ASCII
        return _SPACED.findall(text)

    def _split(self, text: str) -> tuple[list[str] | str, bool]:
        """Parts of a text, and whether they are marked; marked ones are one string, with spaces between.

        Where all stops stand behind letters or digits they are parts of their own. If white space is
        dropped, any of it may stand between marked parts. A byte vocabulary's text whose white space is
        single spaces and line ends is cut at the spaces: a part then has one before it, or begins with
        the mark U+001E (texts that hold it are encoded whole).
        """
        if self.whole(text):
            return [text], False
        if self.drops_space:
            if _stops_stand_alone(text, spaces=True):
                for stop in _STOPS:
                    text = text.replace(stop, " " + stop)
            return text, True
        uneven = not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNEVEN)
        if uneven or not _stops_stand_alone(text, spaces=False):
            return _SPACED.findall(text), False
        for stop in _STOPS:
            text = text.replace(stop, " \x1e" + stop)
        return "\x1e" + text.replace("\n", " \x1e\n \x1e"), True

    def _letters(self, word: str) -> bool:
        """Is the word letters, one pre-token? In a byte vocabulary with the one space before them."""
        if self.drops_space:
            return word.isalpha() and "\u0130" not in word
        return word[:1] == " " and word[1:].isalpha() and "\u0130" not in word

    def _learn(self, words: Iterable[str]) -> bool:
        """Put words in the cache, and the parts of a word that end before a stop. Was it full and emptied?"""
        new = list(words)
        emptied = self._room(len(new))
        made, split, parts_of = self.words, [], {}
        for word in new:
            parts = [word] if self._letters(word) or self.whole(word) else _STOP.split(word)
            if len(parts) > 1:
                split.append((word, parts))
            for part in parts:
                if part not in made:
                    parts_of[part] = None
        made.update(self._encoded(list(parts_of)))
        for word, parts in split:
            made[word] = b"".join([made[p] for p in parts])
        return emptied

    def _marked_ids(self, words: pa.StringArray) -> pa.BinaryArray:
        """Ids of different marked words; new ones are put in the cache."""
        at = pc.index_in(words, value_set=self.marked[0])
        unknown = at.is_null().to_numpy(zero_copy_only=False)
        if unknown.any():
            if self._room(int(unknown.sum())):  # the cache was emptied
                unknown[:] = True
            at = at.fill_null(0).to_numpy().copy()
            new = words.filter(pa.array(unknown))
            at[unknown] = len(self.marked[0]) + np.arange(len(new))
            columns = [self.marked]
            for start in range(0, len(new), LEARNED):
                some = new.slice(start, LEARNED)
                keys = some.to_pylist()
                named = keys if self.drops_space else [key[1:] if key[0] == "\x1e" else " " + key for key in keys]
                found = self._encoded(list(dict.fromkeys(named)))
                columns.append((some, pa.array([found[part] for part in named], pa.binary())))
            self.marked = tuple(map(pa.concat_arrays, zip(*columns, strict=True)))
        return self.marked[1].take(pa.array(at))

    def _room(self, new: int) -> bool:
        if len(self.words) + len(self.marked[0]) + new <= CACHE_WORDS:
            return False
        self.words.clear()
        self.marked = tuple(column[:0] for column in self.marked)
        return True

    def _modelled(self, parts: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the words of common letters, each by the model alone, and the other parts."""
        out, rest, ids, signs = {}, [], self.bytes_of, {"": b""}
        tokenize, letter = self.library.model.tokenize, _byte_letters().__getitem__
        for part in parts:
            found = _WORD.fullmatch(part)
            if not found:
                rest.append(part)
                continue
            word, sign = found.groups()
            if self.drops_space:  # this vocabulary is of small letters
                word = word.lower()
            if word.isascii():
                word = "\u0120" + word[1:] if word[0] == " " else word
            else:
                word = "".join(map(letter, word.encode()))
            if sign not in signs:
                signs[sign] = b"".join([ids[t.id] for t in tokenize(sign)])
            out[part] = b"".join([ids[t.id] for t in tokenize(word)]) + signs[sign]
        return out, rest

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part. Many plain words are encoded as one text; a word's ids end, or begin, where
        the vocabulary marks it."""
        out, parts = self._modelled(parts)
        letters = [p for p in parts if self._letters(p)]
        rest = [p for p in parts if not self._letters(p)]
        for start in range(0, len(letters), 4000):
            some = letters[start : start + 4000]
            text = (" " if self.drops_space else "").join(some)
            found = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype="<u4")
            borders = np.flatnonzero(self.border[ids])
            if len(borders) != len(some):  # a word is not one pre-token after all
                rest += some
                continue
            ends = borders + 1 if self.drops_space else np.r_[borders[1:], len(ids)]
            data, last = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                out[word] = data[last:end]
                last = end
        for start in range(0, len(rest), 2000):
            some = rest[start : start + 2000]
            for part, found in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                out[part] = b"".join([self.bytes_of[i] for i in found.ids])
        return out

    def sizes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Code points, and number of ids, of each of the pieces of each text, in order. Long texts are read
        in slices that begin with white space."""
        marked, lists, size = [], [], 0
        # Arrow reads all known words for each group, so a few texts go without it
        plain = self.drops_space or sum(map(len, texts)) < len(self.marked[0])
        out: list[tuple[np.ndarray, np.ndarray]] = [_NONE] * len(texts)
        for i, text in enumerate(texts):
            if len(text) > 4 * BATCH and not self.whole(text):
                parts = map(self.pieces, _slices(text, BATCH))
                out[i] = tuple(map(np.concatenate, zip(*(_sized(p, self.counts(p)) for p in parts), strict=True)))
                continue
            words, is_marked = (self.pieces(text), False) if plain else self._split(text)
            if is_marked:
                marked.append((i, words))
                continue
            lists.append((i, words))
            size += len(text)
            if size > BATCH:
                self._size_lists(lists, out)
                lists, size = [], 0
        self._size_lists(lists, out)
        for (k, _), found in zip(marked, self._marked_sizes([words for _, words in marked]), strict=True):
            out[k] = found
        yield from out

    def _size_lists(self, lists: list[tuple[int, list[str]]], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        missing = {p for _, pieces in lists for p in pieces if p not in self.words}
        if missing:
            self._learn(missing)
        for k, pieces in lists:
            out[k] = _sized(pieces, self.counts(pieces))

    def _marked_sizes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """sizes() of a byte vocabulary's marked texts. A piece begins with a part that has a space before it,
        or is a line end; other parts belong to the piece before."""
        if not texts:
            return
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        known, at = coded.dictionary, coded.indices.to_numpy()
        inside = pc.starts_with(known, "\x1e").to_numpy(zero_copy_only=False)
        chars = pc.utf8_length(known).to_numpy() + np.where(inside, -1, 1)
        ids = pc.binary_length(self._marked_ids(known)).to_numpy() >> 2
        first = (~inside | pc.equal(known, "\x1e\n").to_numpy(zero_copy_only=False))[at]
        offsets = words.offsets.to_numpy()
        first[offsets[:-1]] = True
        begin = np.flatnonzero(first)
        chars, ids = (np.add.reduceat(column[at], begin, dtype=np.int64) for column in (chars, ids))
        cuts = np.searchsorted(begin, offsets).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield chars[a:b], ids[a:b]

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of ids of each of some pieces."""
        missing = {p for p in pieces if p not in self.words}
        if missing and self._learn(missing):  # the cache was emptied
            self._learn(set(pieces))
        return [len(self.words[p]) >> 2 for p in pieces]

    def counts_of_runs(self, runs: list[str]) -> list[int]:
        """Number of ids of texts that each are some pieces."""
        return [sum(self.counts(self.pieces(r))) for r in runs]

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        lists, columns, size = ([], []), ([], []), 0  # numbers of texts, and their words
        for i, text in enumerate(texts):
            words, marked = self._split(text)
            (columns if marked else lists)[0].append(i)
            (columns if marked else lists)[1].append(words)
            size += 0 if marked else len(text)
            if size > BATCH or i == len(texts) - 1:
                for k, ids in zip(lists[0], self._listed(lists[1]), strict=True):
                    out[k] = ids
                lists, size = ([], []), 0
        for k, ids in zip(columns[0], self._marked_group(columns[1]), strict=True):
            out[k] = ids
        return out

    def _listed(self, lists: list[list[str]]) -> list[bytes]:
        missing = {w for words in lists for w in words if w not in self.words}
        if missing and self._learn(missing):  # the cache was emptied
            self._learn(set().union(*lists).difference(self.words))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in lists]

    def _marked_group(self, texts: list[str]) -> list[bytes]:
        """Ids of marked texts. Their words are numbered, and the ids put in their places, by Arrow."""
        if not texts:
            return []
        column = pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(column) if self.drops_space else pc.split_pattern(column, " ")
        coded = words.flatten().dictionary_encode()
        ids = self._marked_ids(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[words.offsets.to_numpy()].tolist()
        view = memoryview(data)
        return [bytes(view[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; null is empty. Texts are encoded in groups of bounded size, and
        long ones in slices that begin with white space."""
        group, size = [], 0
        step, long = (GROUP, GROUP) if self.drops_space else (BATCH, 4 * BATCH)
        for text in texts:
            text = text or ""
            if len(text) > long and not self.whole(text):
                yield from self._group(group)
                group, size = [], 0
                yield b"".join(self._group([part])[0] for part in _slices(text, step))
                continue
            group.append(text)
            size += len(text)
            if size > GROUP or len(group) >= GROUP // 400:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


_NONE = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def _sized(pieces: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(p) for p in pieces], dtype=np.int64), np.array(counts, dtype=np.int64)


def _slices(text: str, step: int) -> Iterator[str]:
    """Parts of `step` characters or more that end where a word ends."""
    start = 0
    ends = re.compile(r"(?<=[^ \t\n\r\x0b\x0c])[ \t\n\r\x0b\x0c]")
    while start < len(text):
        found = ends.search(text, start + step)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


@cache
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@cache
def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder a worker and vocabulary, so that its cache serves all tasks."""
    return Encoder(path, drops_space)


@cache
def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
