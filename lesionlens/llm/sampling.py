"""Bounded samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lesionlens.llm.columns import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, label, place, text) of at most ``rows`` labelled documents of each class 0 and 1, outside the held-out fold.

    The rows with the smallest hash of their id (``place``) are taken, so the sample depends neither on order nor on partitions.
    Only their ids, bounded by 2 * ``rows``, are broadcast; the texts are not shuffled.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    picks = [known.where(F.col("label") == c).orderBy("place", "doc_id").limit(rows) for c in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "place", "text")
