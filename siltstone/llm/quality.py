"""Quality scores by nearest-neighbour voting on latent-semantic vectors.

A text's terms are of two groups. One is what it says: its words, pairs of words
and three-byte strings, lower-cased and hashed to ``GRAMS`` slots. The other is what
its words look like: the marks that hang on a word (letters taken off), plain
words, shares of capitals, of words that repeat the one before and of words seen
already, hashed to ``SURFACE`` slots. Each group, weighted by inverse document
frequency and brought to length 1, is reduced to half of the ``RANK`` latent
dimensions by a singular value decomposition over the labelled sample, so neither
takes the other's dimensions. Each document is compared
with every labelled vector by blocked matrix products (exact cosines) and its
``NEIGHBOURS`` nearest, with all that are as near as the last of them, vote with
their similarity as weight.

The sample is bounded: ``TRAIN_ROWS`` labelled documents at most, those with the
smallest hash of their id. So what is broadcast is ``TRAIN_ROWS * RANK`` numbers,
whatever the size of the corpus. Every document is scored on its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each, table

TRAIN_ROWS = 4000
SURFACE = 512
GRAMS = 2048
TERMS = SURFACE + GRAMS
RANK = 64
NEIGHBOURS = 15
#: Votes weigh similarity to this power, so near neighbours count far more.
SHARPNESS = 8
THRESHOLD = 0.3
FOLDS = 5
#: Documents of one matrix product.
BLOCK = 256

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = bytes(range(0x61, 0x7B)) + _UPPER + bytes(range(0x80, 0x100))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_DIGITS = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def terms(text: str | None) -> dict[bytes, float]:
    """Rate of each term in a text, 0 to 1; nothing for a text without words."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    n = len(words)
    if not n:
        return {}
    marks = Counter(raw.translate(_DIGITS, _LETTERS).split())
    rates = {b"mark " + k: v / n for k, v in marks.items()}
    rates[b"plain"] = (n - sum(marks.values())) / n
    rates[b"capitals"] = len(raw.translate(None, _NOT_UPPER)) / len(raw)
    rates[b"again"] = sum(map(bytes.__eq__, words, words[1:])) / n
    rates[b"seen"] = 1 - len(set(words)) / n
    rates[b"few"] = 1.0 if n < 8 else 0.0
    return rates


def grams(text: str | None) -> np.ndarray:
    """Square roots of the rates of words and word pairs, and of three-byte strings, in ``GRAMS`` slots."""
    raw = (text or "").lower().encode("utf-8")
    words = raw.split()
    counts = np.zeros((2, GRAMS))
    if words:
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        counts[0] = np.bincount(_slots(h), minlength=GRAMS) + np.bincount(_slots(h[:-1] * np.uint64(31) + h[1:] + np.uint64(1)), minlength=GRAMS)
        joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        for a in range(0, len(joined) - 2, 1 << 17):
            part = joined[a : a + (1 << 17) + 2].astype(np.uint64)
            counts[1] += np.bincount(_slots(part[:-2] << np.uint64(16) | part[1:-1] << np.uint64(8) | part[2:]), minlength=GRAMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).sum(axis=0)


def _slots(h: np.ndarray) -> np.ndarray:
    """The upper bits of a multiplicative hash."""
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAMS


def vector(text: str | None) -> np.ndarray:
    out = np.zeros(TERMS, np.float32)
    for term, rate in terms(text).items():
        out[zlib.crc32(term) % SURFACE] += np.log1p(100 * rate)
    out[SURFACE:] = grams(text)
    return out


@dataclass
class Model:
    weights: np.ndarray  # by term
    axes: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # labelled documents by dimensions, of length 1
    labels: np.ndarray
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        return _unit(_parts(rows * self.weights) @ self.axes)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """For each row of term weights, the weighted vote of its neighbours for label 1."""
        out = np.full(len(rows), self.prior)
        some = np.flatnonzero(rows.any(axis=1))
        if len(self.labels):
            for a in range(0, len(some), BLOCK):
                at = some[a : a + BLOCK]
                near = self.project(rows[at]) @ self.vectors.T
                k = near.shape[1] - min(NEIGHBOURS, near.shape[1])
                # Neighbours as near as the last one vote as well, so ties need no order.
                row, voter = np.nonzero(near >= np.partition(near, k, axis=1)[:, k : k + 1])
                weight = np.maximum(near[row, voter], 0).astype(np.float64) ** SHARPNESS
                total = np.bincount(row, weight, len(at))
                out[at] = np.where(total > 0, np.bincount(row, weight * self.labels[voter], len(at)) / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0.0, 1.0)


def _parts(rows: np.ndarray) -> np.ndarray:
    """Both groups of terms brought to the same length."""
    return np.concatenate([_unit(rows[:, :SURFACE]), _unit(rows[:, SURFACE:])], axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled documents outside the held-out fold.

    Labels of one id are taken together (the largest counts), as are its texts (the
    smallest); null ids and labels are left out, and so are labels without a
    document. Ties in the hash go by id.
    """

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([zlib.compress(vector(t).tobytes(), 1) for t in texts])

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    there = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    got = rows.select("doc_id", "quality", vectors("text").alias("v")).toPandas().sort_values("doc_id")
    if got.empty:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0), 0.5)
    # The driver holds the sample once; all else is done in blocks of rows.
    seen = np.empty((len(got), TERMS), np.float32)
    for k, v in enumerate(got.pop("v")):
        seen[k] = np.frombuffer(zlib.decompress(v), np.float32)
    blocks = [seen[a : a + BLOCK] for a in range(0, len(seen), BLOCK)]
    weights = (np.log((1 + len(seen)) / (1 + sum((block > 0).sum(axis=0) for block in blocks))) + 1).astype(np.float32)
    axes = np.zeros((TERMS, RANK), np.float32)
    for a, b, k in ((0, SURFACE, 0), (SURFACE, TERMS, RANK // 2)):
        products = np.zeros((b - a, b - a))
        for block in blocks:
            part = _parts(block * weights)[:, a:b].astype(np.float64)
            products += part.T @ part
        _, found = np.linalg.eigh(products)
        axes[a:b, k : k + RANK // 2] = found[:, ::-1][:, : RANK // 2]
    label = got["quality"].to_numpy(np.float64)
    model = Model(weights, axes, np.zeros((0, RANK), np.float32), label, float(label.mean()))
    model.vectors = np.concatenate([model.project(block) for block in blocks]).astype(np.float32)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: 0 to 1, higher where label 1 is likelier.

    A null or empty text, and any without a word, gets the share of label 1 in the
    sample (0.5 without labels). Very long texts are read whole. Every row keeps its
    columns, repeated rows each get the same score; a column of that name is
    replaced. An empty table gives an empty one. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows = np.zeros((BLOCK, TERMS), np.float32)
        for texts in parts:
            out = np.zeros(len(texts))
            for a in range(0, len(texts), BLOCK):
                block = texts.slice(a, BLOCK)
                for k, t in enumerate(each(block)):
                    rows[k] = vector(t)
                out[a : a + len(block)] = sent.value.scores(rows[: len(block)])
            yield pa.array(out)

    return docs.withColumn(score_col, score(F.col(text_col)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
