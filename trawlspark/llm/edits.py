"""Token counts under edits: a segment tree over the pre-tokens of each document.

The tree's leaves are the pre-tokens of the text (white space and the word after it); inner nodes sum
characters and tokens. An edit finds its leaves by characters, takes one more leaf on either side as
context, encodes only this region anew and updates the sums above it. Beyond the context nothing
changes, because a pre-token begins where a word ends and white space begins, and the characters at
those two places are not part of the edit.

Documents and their edits are brought together by doc_id and sorted, so a document comes first and its
edits follow one by one: also a document with very many edits is only streamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship
from trawlspark.llm.tokens import GROUP, Encoder, encoder

#: A leaf with more characters makes its tree grow leaves anew.
LEAF = 4096


class TokenTree:
    """Counts of one text. tokens and chars are those of the present text, encoded the characters that
    edits have encoded anew."""

    def __init__(self, text: str, library: Encoder, sizes: tuple[np.ndarray, np.ndarray] | None = None):
        """sizes: those of the text's pieces, if known."""
        self.library = library
        self.encoded = 0
        self._build(text, sizes)

    def _build(self, text: str, sizes: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        found = sizes or next(self.library.sizes([text]))
        n, size = len(found[0]), 1
        while size < max(n, 1):
            size *= 2
        # a leaf is a part of the built text, until an edit changes it
        self.size, self.built, self.changed = size, text, {}
        self.begin = np.full(size + 1, len(text))
        self.begin[0] = 0
        np.cumsum(found[0], out=self.begin[1 : n + 1])
        self.sums = np.zeros((2, 2 * size), dtype=np.int64)
        self.sums[:, size : size + n] = found
        level = size
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level : 2] + self.sums[:, level + 1 : 2 * level : 2]
            level //= 2

    def _leaves(self, first: int, stop: int) -> list[str]:
        ends = self.begin[first : stop + 1].tolist()
        found = [self.built[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if self.changed:
            found = [self.changed.get(first + k, leaf) for k, leaf in enumerate(found)]
        return found

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self._leaves(0, self.size)) if self.changed else self.built

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character `at`, and the characters before that leaf."""
        node, before, chars = 1, 0, self.sums[0]
        while node < self.size:
            node *= 2
            left = int(chars[node])
            if at - before >= left:
                before += left
                node += 1
        return node - self.size, before

    def edit(self, start: int, length: int, insert: str) -> None:
        """Replace `length` characters from `start` by `insert`; what lies outside the text is cut."""
        start = min(max(start, 0), self.chars)
        stop = min(start + max(length, 0), self.chars)
        if not self.chars:
            self._build(insert)
            self.encoded += len(insert)
            return
        first, before = self._find(max(start - 1, 0))
        if before > 0:
            first, before = self._find(before - 1)
        last, at = self._find(min(stop, self.chars - 1))
        after = at + int(self.sums[0, self.size + last])
        if after < self.chars:
            last, _ = self._find(after)
        old = self._leaves(first, last + 1)
        region = "".join(old)
        region = region[: start - before] + insert + region[stop - before :]
        pieces = self.library.pieces(region)
        self.encoded += len(region)
        room = last + 1 - first
        if len(pieces) > room:
            pieces = [*pieces[: room - 1], "".join(pieces[room - 1 :])]
        if self.library.whole(region) or len(pieces[-1] if pieces else "") > LEAF:
            self._build("".join([*self._leaves(0, first), region, *self._leaves(last + 1, self.size)]))
            return
        leaves = slice(self.size + first, self.size + last + 1)
        known = dict(zip(old, self.sums[1, leaves].tolist(), strict=True))  # most leaves of the context stay
        new = [p for p in pieces if p not in known]
        known.update(zip(new, self.library.counts_of_runs(new), strict=True))
        pieces += [""] * (room - len(pieces))
        self.changed.update(enumerate(pieces, first))
        self.sums[:, leaves] = [[len(p) for p in pieces], [known[p] if p else 0 for p in pieces]]
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            span = slice(low, high + 1)
            self.sums[:, span] = self.sums[:, 2 * low : 2 * high + 2 : 2] + self.sums[:, 2 * low + 1 : 2 * high + 2 : 2]
            low, high = low // 2, high // 2


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in groups of GROUP bytes or a little more, so that enough words are counted at once."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield pa.Table.from_batches(group)
            group, size = [], 0
    if group:
        yield pa.Table.from_batches(group)


_OUT = "n_edits bigint, tokens_before bigint, tokens_after bigint, chars_after bigint, encoded_chars bigint"


def edited_counts(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_edits, tokens_before, tokens_after, chars_after, encoded_chars of each row of docs
    (doc_id, text), after all edits (doc_id, seq, start, length, insert) of its doc_id, in order of seq
    (then of start, length and insert).

    Positions are code points of the text as earlier edits left it; parts outside of it are cut off.
    Null text or insert is empty, null seq comes first, null start or length is 0. Rows with the same
    doc_id each get all its edits. Edits of other ids, or of a null id, are left out; a document with a
    null id is counted and not edited.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer, False)
        names = ["doc_id", *(c.split()[0] for c in _OUT.split(", "))]
        current, trees, done = None, [], []  # trees: [tree, rows with this text, tokens before, edits]

        def close() -> None:
            for tree, times, before, n in trees:
                done.extend([(current, n, before, tree.tokens, tree.chars, tree.encoded)] * times)

        def flush() -> pa.RecordBatch:
            types = [id_type] + [pa.int64()] * 5
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in _grouped(batches):
            id_type = batch.schema.field(0).type
            ids, is_edit, texts, start, length = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4))
            ahead, sizes = 0, iter(())
            for i in range(batch.num_rows):
                if not is_edit[i]:
                    if i >= ahead:  # pieces of the texts to come, counted together
                        ahead, size = i, 0
                        while ahead < batch.num_rows and size < GROUP:
                            size += 0 if is_edit[ahead] else len(texts[ahead] or "")
                            ahead += 1
                        sizes = library.sizes([texts[k] or "" for k in range(i, ahead) if not is_edit[k]])
                    if trees and (ids[i] != current or ids[i] is None):
                        close()
                        trees = []
                    current, text, found = ids[i], texts[i] or "", next(sizes)
                    same = next((t for t in trees if t[0].text == text), None)
                    if same:
                        same[1] += 1
                    else:
                        tree = TokenTree(text, library, found)
                        trees.append([tree, 1, tree.tokens, 0])
                elif trees and ids[i] == current:
                    for t in trees:
                        t[0].edit(start[i] or 0, length[i] or 0, texts[i] or "")
                        t[3] += 1
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    def rows(df: DataFrame, is_edit: bool, *columns) -> DataFrame:
        return df.select("doc_id", F.lit(is_edit).alias("is_edit"), *columns)

    none = F.lit(None).cast("long")
    base = rows(docs, False, "text", none.alias("start"), none.alias("length"), none.alias("seq"))
    more = rows(
        edits.where(F.col("doc_id").isNotNull()), True, F.col("insert").alias("text"),
        F.col("start").cast("long"), F.col("length").cast("long"), F.col("seq").cast("long"),
    )
    keyed = base.where(F.col("doc_id").isNotNull()).unionByName(more)
    order = ["doc_id", "is_edit", "seq", "start", "length", "text"]
    keyed = keyed.repartition("doc_id").sortWithinPartitions(*order)
    columns = ["doc_id", "is_edit", "text", "start", "length"]
    free = base.where(F.col("doc_id").isNull())
    out = f"doc_id {kind}, {_OUT}"
    return keyed.select(columns).mapInArrow(run, out).unionByName(free.select(columns).mapInArrow(run, out))


def derived_edits(docs: DataFrame) -> DataFrame:
    """An edit log over docs (doc_id, n_chars, source): a replaced word, a deleted span and an inserted
    phrase in each document, at places that follow from its id."""
    place = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest("n_chars", F.lit(1))) for k in range(3)]
    name = F.coalesce("source", F.lit("none"))
    each = [
        F.struct(F.lit(0).alias("seq"), place[0].alias("start"), F.lit(7).alias("length"), F.concat(name, F.lit("s")).alias("insert")),
        F.struct(F.lit(1).alias("seq"), place[1].alias("start"), F.lit(40).alias("length"), F.lit("").alias("insert")),
        F.struct(F.lit(2).alias("seq"), place[2].alias("start"), F.lit(0).alias("length"), F.concat(F.lit(" as seen in "), name, F.lit(".\n")).alias("insert")),
    ]
    return docs.select("doc_id", F.inline(F.array(*each)))
