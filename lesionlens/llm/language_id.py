"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled row, whatever their number: a task keeps one count vector per
language, Spark sums them, and the driver gets ``2**bits`` numbers for each language, never documents. The
matrix of log probabilities is broadcast; its size is fixed by ``bits``, ``MAX_LANGUAGES`` and nothing else. A
batch is scored in numpy by gathering the matrix rows of its n-grams and summing them by text.

Texts are lower-cased; digits, punctuation and white space count as one kind of character.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a row without a label or an id
is not learnt from when the label is null; empty training data makes everything ``und``; ties go to the first language in
code-point order; repeated rows are learnt from as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lesionlens.llm.columns import held_out, unpacked, whole_row
from lesionlens.llm.kernels import pieces

BITS = 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd multipliers, one for each place


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets: log probability of a bucket
    prior: np.ndarray


def _features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, text by text; n + 1 offsets)."""
    texts = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_letter = (code >= 97) & (code <= 122)
    code[~ascii_letter & (code < 0xAA)] = 32
    ends = np.cumsum(sizes)
    out = np.empty((len(code), len(ORDERS)), np.uint32)
    left = np.repeat(ends, sizes) - np.arange(len(code))  # characters up to the end of the text
    total = np.zeros(len(code), np.uint32)
    for k, n in enumerate(ORDERS):
        total[: len(code) - n + 1] += code[n - 1 :] * FACTORS[n - 1]
        mixed = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        out[:, k] = np.where(left >= n, mixed >> np.uint32(32 - bits), np.uint32(1 << bits))
    return out.reshape(-1), np.concatenate([[0], ends]) * len(ORDERS)


def train(docs: DataFrame, text: str = "text", label: str = "lang", bits: int = BITS) -> Model:
    """Fit on all rows of ``docs`` that have a text and a label."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in pieces(batches):
            labels = batch.column("label").to_pylist()
            ids, at = _features(batch.column("text").to_pylist(), bits)
            for name in set(labels):
                mine = [ids[at[i] : at[i + 1]] for i, x in enumerate(labels) if x == name]
                got = np.bincount(np.concatenate(mine), minlength=size + 1)[:size]
                sums[name] = sums[name] + got if name in sums else got
                rows[name] = rows.get(name, 0) + len(mine)
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(got[at], rows[name]).astype(np.int64))], names=["label", "bucket", "n"],
            )

    labelled = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).dropna()
    counts = labelled.mapInArrow(count, "label string, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    languages = [r[0] for r in counts.select("label").distinct().orderBy("label").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = counts.toArrow()  # languages x 2**bits rows at most
    counts.unpersist()
    row = {name: i for i, name in enumerate(languages)}
    matrix, prior = np.zeros((len(languages), size)), np.zeros(len(languages))
    which = np.array([row[x] for x in got.column("label").to_pylist()], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    inside = bucket >= 0
    matrix[which[inside], bucket[inside]] = n[inside]
    prior[which[~inside]] = n[~inside]
    matrix = matrix + 0.5
    return Model(languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)), np.log(prior / max(prior.sum(), 1)))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, [keep...,] lang_pred, score): the likeliest language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = int(model.weights.shape[1]).bit_length() - 1
    keep = keep or []
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"keep_{c}") for c in keep], F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        padded = np.concatenate([m.weights, np.zeros((len(m.languages), 1))], axis=1)  # past the end of a text
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts)) & bool(m.languages)
            best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if known.any():
                ids, at = _features(texts, bits)
                sums = np.stack([np.add.reduceat(w[ids], at[:-1]) for w in padded], axis=1) + m.prior
                best = sums.argmax(axis=1)
                sure = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(names, pa.string()), pa.array(np.where(known, sure, 0.0))],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(score, schema)
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep})


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with probability ``least``, with the columns of ``docs``.

    The model learns from the labelled rows of ``docs`` outside the held-out fold; ``und`` is rejected.
    """
    model = train(docs.where(~held_out(doc_id)), text, label)
    rows = docs.select(whole_row(docs).alias("row"), F.col(text).alias("text"))
    out = predict(rows, model, "row", "text")
    return unpacked(out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), "doc_id", docs.columns)
