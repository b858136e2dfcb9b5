"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features of a text are the hashed runs of one and two words and of one to three word shapes (a shape keeps
punctuation and writes a run of capitals, small letters or digits as one sign), each with its share
of the text's words as value. Training visits a bounded sample of ``FIT_ROWS`` labelled rows for each class,
row after row, with per-coordinate follow-the-regularised-leader updates; only its features reach the driver.
Scoring gathers the weights of a batch's features and sums them by text, a sparse dot product.

Defined cases: a null or empty text has no feature and gets the bias alone; without rows of both classes every score is the
share of label 1 (0.5 without any); repeated rows are one row of the sample; rows with a null id are scored, and
learnt from when labelled; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lesionlens.llm import kernels

BITS = 18
FIT_ROWS = 3_000
EPOCHS = 4
SCALE = 4.0  # of feature values
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01

SHAPES = np.arange(256, dtype=np.uint8)  # a byte's sign: punctuation stands for itself
SHAPES[48:58], SHAPES[65:91], SHAPES[97:123], SHAPES[128:] = 1, 2, 3, 3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, text of each, words of each text)."""
    data, offsets = kernels.utf8(column)
    starts, ends, first = kernels.words(data, offsets)
    word = kernels.hashes(data, starts, ends)
    sign = SHAPES[data]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[starts] = True
    rank = np.concatenate([[0], np.cumsum(keep)])
    shape = kernels.hashes(sign[keep], rank[starts], rank[ends])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    got = [kernels.runs(word, first, 1), kernels.runs(word, first, 2)] + [kernels.runs(shape, first, k) for k in (1, 2, 3)]
    ids = [kernels.mix(h + np.uint64(k)) >> np.uint64(64 - bits) for k, (h, _) in enumerate(got)]
    return np.concatenate(ids).astype(np.int32), np.concatenate([owner[w] for _, w in got]), np.diff(first)


def train(sample: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Fit on a bounded sample (label, place, text), in the order of ``place``."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            ids, owner, n = features(batch.column("text"), bits)
            key, count = np.unique(owner.astype(np.int64) << bits | ids, return_counts=True)
            at = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1)).astype(np.int32)
            value = count * SCALE / np.maximum(n, 1)[key >> bits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array((key & ((1 << bits) - 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(value.astype(np.float32)))], names=["place", "label", "ids", "x"],
            )

    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))])
    rows = sample.select("place", "label", "text").mapInArrow(extract, schema).toArrow()
    rows = rows.take(np.argsort(rows.column("place").to_numpy(), kind="stable"))
    label = rows.column("label").to_numpy().astype(float)
    weights, bias = np.zeros(1 << bits), 0.0
    if len(set(label)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return Model(weights, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    parts = [(np.asarray(i.values, np.int64), np.asarray(x.values, float)) for i, x in zip(rows.column("ids"), rows.column("x"))]
    z, n = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)  # the last coordinate is the bias
    share = label.mean()
    for _ in range(epochs):
        for (ids, x), y in zip(parts, label):
            at, v = np.append(ids, len(weights)), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (p - y) * v * (0.5 / share if y else 0.5 / (1 - share))
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1], float(w[-1]))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = len(model.weights).bit_length() - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in kernels.pieces(batches):
            ids, owner, n = features(batch.column("text"), bits)
            dots = np.bincount(owner, m.weights[ids], batch.num_rows) * SCALE / np.maximum(n, 1) + m.bias
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(dots, -700, 700))))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
