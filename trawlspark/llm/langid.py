"""Language identification by error-correcting output codes over character n-grams.

Each learned language has a codeword of +1/-1 bits. For each bit a binary logistic classifier over
hashed 1- to 3-grams of letters predicts its sign. Decoding adds up the logistic loss of every bit
against a codeword, weighted by how reliable the bit's classifier is on labelled rows, and takes the
nearest codeword. A small gap to the second-nearest flags the document as ambiguous.

Fitting uses a bounded sample (see `sample`) and numpy on the driver; prediction is one pass over the
whole texts in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlspark.llm.stage import ship

BUCKETS = 4096
#: Most labelled rows the classifiers are fitted on, over all languages together.
SAMPLE_ROWS = 1200
MAX_LANGUAGES = 200
#: Code points handled at once; longer texts are added up slice by slice.
SLICE = 1 << 20
#: Share of the summed loss that must lie between the nearest and second codeword.
AMBIGUOUS_GAP = 0.15
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def vector(text: str) -> np.ndarray | None:
    """Unit vector of the square roots of hashed n-gram counts; None without a letter."""
    total, carry = None, np.zeros(0, dtype=np.uint32)
    for i in range(0, len(text), SLICE):
        part = text[i : i + SLICE].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        if not letter.any() and total is None:
            continue
        codes = np.where(letter, codes, np.uint32(32))
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = letter[1:] | letter[:-1]  # one space for each run of others
        codes = codes[keep]
        pad = np.concatenate([carry if total is not None else np.array([32], dtype=np.uint32), codes])
        carry = pad[-2:]
        one = codes * np.uint32(2654435761)
        two = (pad[:-1] * np.uint32(2246822519)) ^ (pad[1:] * np.uint32(3266489917))
        three = two[:-1] ^ (pad[2:] * np.uint32(668265263))
        three ^= three >> np.uint32(15)
        grams = np.concatenate([one, two * np.uint32(374761393), three * np.uint32(2654435761)])
        found = np.bincount(grams >> np.uint32(20), minlength=BUCKETS)
        total = found if total is None else total + found
    if total is None:
        return None
    x = np.sqrt(total.astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(n: int) -> np.ndarray:
    """n codewords: all splits for up to 5 languages, else the best-spread of some random codes."""
    if n <= 5:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(max(2 ** (n - 1) - 1, 1))]
        return np.array(columns, dtype=np.float32).T
    rng, best = np.random.default_rng(0), (-1, None)
    for _ in range(40):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        agree = code @ code.T - 2 * code.shape[1] * np.eye(n)
        if -agree.max() > best[0] or best[1] is None:
            best = (-agree.max(), code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding, mean 1

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, score and ambiguity of each row of x."""
        z = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -z * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        order = np.sort(loss, axis=1)
        share = np.exp(order[:, :1] - loss)
        score = 1 / share.sum(axis=1)
        if loss.shape[1] == 1:
            return np.zeros(len(x), dtype=int), score, np.zeros(len(x), dtype=bool)
        gap = (order[:, 1] - order[:, 0]) / np.maximum(order[:, 1], 1e-9)
        return loss.argmin(axis=1), score, gap < AMBIGUOUS_GAP


def fit(x: np.ndarray, y: list[str], rounds: int = 100, decay: float = 1e-4) -> Model | None:
    """Logistic classifiers of all bits at once, by accelerated gradient steps; None without rows."""
    if not len(x):
        return None
    languages = sorted(set(y))
    code = codewords(len(languages))
    index = np.array([languages.index(v) for v in y])
    rows_of = np.bincount(index).astype(np.float32)
    weight = (1 / rows_of[index] / len(languages))[:, None].astype(np.float32)  # languages count alike
    target = code[index]
    w, v = (np.zeros((x.shape[1], code.shape[1]), dtype=np.float32) for _ in range(2))
    b, vb = (np.zeros(code.shape[1], dtype=np.float32) for _ in range(2))
    step = 4.0
    for k in range(rounds):
        mix = k / (k + 3)
        at, at_b = w + mix * v, b + mix * vb
        pull = -target * weight / (1 + np.exp(np.clip(target * (x @ at + at_b), -30, 30)))
        v = at - step * (x.T @ pull + decay * at) - w
        vb = at_b - step * pull.sum(axis=0) - b
        w, b = w + v, b + vb
    wrong = ((target * (x @ w + b) <= 0) * weight).sum(axis=0)
    trust = np.maximum(1 - 2 * wrong, 0.05)
    return Model(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, lang) of at most `rows` labelled rows, the same number for each language.

    Languages are the MAX_LANGUAGES most frequent labels. Within one, rows with the smallest hash of
    their id are taken: a hash threshold from the label's count keeps about twice the quota, a window
    over those few rows the quota itself.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    found = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return usable.select("text", "lang").limit(0)
    quota = max(rows // len(found), 1)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.lit(-1)
    for r in found:
        bound = F.when(F.col("lang") == r["lang"], int(min(1.0, (2 * quota + 20) / r["count"]) * (1 << 30))).otherwise(
            bound
        )
    near = usable.where((place < bound) & F.col("text").isNotNull()).select("text", "lang", "doc_id")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return near.withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= quota).select("text", "lang")


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Model of the labels of docs (doc_id, text, lang); None if there is no usable row."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(vector(t), lang) for t, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [(x, lang) for x, lang in found if x is not None]
            packed = [np.flatnonzero(x).astype(np.uint16).tobytes() for x, _ in found]
            values = [x[x > 0].astype(np.float16).tobytes() for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed, pa.binary()), pa.array(values, pa.binary()), pa.array([v for _, v in found], pa.string())],
                names=["places", "shares", "lang"],
            )

    ship(docs.sparkSession)
    got = sample(docs, rows).mapInArrow(vectors, "places binary, shares binary, lang string").collect()
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["places"], dtype=np.uint16)] = np.frombuffer(r["shares"], dtype=np.float16)
    order = sorted(range(len(got)), key=lambda i: (got[i]["lang"], bytes(got[i]["places"]), bytes(got[i]["shares"])))
    return fit(x[order], [got[i]["lang"] for i in order])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous; columns of these names are replaced.

    A null text, or one without a letter, is `und` with score 0 and ambiguous, like every row if there
    is no model. Only the text is read for a prediction, so repeated rows get equal results.
    """
    added = ("lang_pred", "score", "ambiguous")
    ship(docs.sparkSession)
    docs = docs.drop(*added)
    at = docs.columns.index(text)
    schema = T.StructType(docs.schema.fields[:])
    for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = [UNDETERMINED] * n, np.zeros(n), np.ones(n, dtype=bool)
            for start in range(0, n if model else 0, 256):
                xs, rows = [], []
                for i, value in enumerate(batch.column(at).slice(start, 256)):
                    x = vector(value.as_py() or "")
                    if x is not None:
                        xs.append(x)
                        rows.append(start + i)
                if rows:
                    best, score[rows], unsure[rows] = model.decode(np.stack(xs))
                    for i, k in zip(rows, best, strict=True):
                        lang[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)],
                names=[*batch.schema.names, *added],
            )

    return docs.mapInArrow(predict, schema)
