"""Quality classifier (operator 4): logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrel.llm.shared import map_arrow, stored
from xrel.llm.words import BETWEEN_SPACES, LOWER, Words, mix, scan, shingles, text_slices

BITS = 18
# Labelled rows that the model is fitted on, chosen by a hash of the id; all held back rows stay out.
TRAIN_ROWS = 12_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-2
FOLDS, HELD_OUT = 4, 2
# One of a few kinds per byte, for the forms of words: small letters, capitals, digits, beyond ASCII, others apart.
_KIND = np.array(
    [1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 + b for b in range(256)], np.uint64
)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no label is ever learned from; a null id is not among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def ngrams(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the n-grams of every row: words and word pairs; forms of words, up to three in a row;
    and whether a run of three words was there before in the text. Values are shares within a row and family."""
    words = scan(data, offsets, BETWEEN_SPACES)
    rows = len(offsets) - 1
    n = np.maximum(np.diff(words.first), 1).astype(float)
    low = Words(data.translate(LOWER), words.start, words.end, words.row, words.first).hashes()
    raw = np.frombuffer(data, np.uint8)
    s, e, row = words.start, words.end, words.row
    if not len(s):
        return np.arange(rows), np.zeros(rows, np.int64), np.ones(rows)
    length = np.minimum(np.log2(e - s).astype(np.uint64), 6)
    same = np.zeros(len(s), np.uint64)
    same[1:] = (low[1:] == low[:-1]) & (row[1:] == row[:-1])
    form = mix(
        _KIND[raw[s]] * np.uint64(1 << 40) + _KIND[raw[np.minimum(s + 1, e - 1)]] * np.uint64(1 << 28)
        + _KIND[raw[e - 1]] * np.uint64(1 << 16) + length * np.uint64(16) + same + np.uint64(7)
    )
    where, hashed, value = [np.arange(rows)], [np.zeros(rows, np.uint64)], [np.ones(rows)]

    def add(at: np.ndarray, h: np.ndarray, family: int, scale: float) -> None:
        where.append(row[at])
        hashed.append(mix(h + np.uint64(family)))
        value.append(scale / n[row[at]])

    everywhere = np.arange(len(s))
    add(everywhere, low, 1, 1.0)
    add(*shingles(low, row, 2), 2, 1.0)
    add(everywhere, form, 3, 4.0)
    add(*shingles(form, row, 2), 4, 4.0)
    add(*shingles(form, row, 3), 5, 4.0)
    at, triples = shingles(low, row, 3)
    own = mix(triples + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    again = np.ones(len(at), bool)
    again[first] = False
    add(at, again.astype(np.uint64), 6, 4.0)
    # The first feature is the constant.
    feature = 1 + (np.concatenate(hashed) >> np.uint64(64 - BITS)).astype(np.int64)
    feature[:rows] = 0
    return np.concatenate(where), feature, np.concatenate(value)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of labelled texts: equal features of a row added up."""
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            row, feature, value = ngrams(data, offsets)
            key, at = np.unique(row * (1 << (BITS + 1)) + feature, return_inverse=True)
            total = np.bincount(at, weights=value)
            bounds = np.searchsorted(key >> (BITS + 1), np.arange(hi - lo + 1)).astype(np.int32)
            index = pa.array((key & ((1 << (BITS + 1)) - 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(pa.array(bounds), x) for x in (index, pa.array(total.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(1)[lo:hi], *lists], names=["turn", "label", "features", "values"]
            )


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after EPOCHS passes over (label, features, values), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, f, x in rows:
            w = weights(z[f], n[f])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
            z[f] += g - sigma * w
            n[f] += g * g
    return weights(z, n)


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for i in range(len(batch)):
            f, x = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
            rows.append((batch.column(1)[i].as_py(), f, x.astype(np.float64)))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(rows).astype("<f4").tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from labels (doc_id, quality) of rows that are not held out; at most TRAIN_ROWS of them.

    Without any labelled rows all weights are 0. Null ids and labels are ignored.
    """
    known = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("bigint").alias("_id"), F.col("quality").cast("int").alias("label"), F.xxhash64("doc_id").alias("turn")
    )
    chosen = stored(known.where(~held_out("_id")).orderBy("turn", "_id", "label").limit(TRAIN_ROWS), "labelled-sample")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # At most TRAIN_ROWS ids.
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("turn", "label", F.coalesce("text", F.lit("")).alias("text"))
    vectors = map_arrow(rows, _vectors, "turn bigint, label int, features array<int>, values array<float>")
    # The updates go through the bounded sample one by one, in an order of their own.
    ordered = stored(vectors, "vectors").repartition(1).sortWithinPartitions("turn", "label", F.xxhash64("features", "values"))
    fitted = map_arrow(ordered, _fit_sample, "weights binary").first()
    return np.frombuffer(fitted[0], "<f4").astype(np.float64) if fitted else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts score by the constant alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                row, feature, value = ngrams(data, offsets)
                total = np.bincount(row, weights=w[feature] * value, minlength=hi - lo)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(p)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, apply, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Only the text makes a score; repeated rows score alike."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
