"""Exact duplicates through a persistent digest index.

The index is a Parquet table (digest, keep_id), bucketed and sorted by digest. A batch is reduced to one row
per digest before it meets the index; digests that the index lacks are found by a sort-merge anti-join, whose
index side is read bucket by bucket without a shuffle, and are appended. A text's keeper never changes once
it is in the index, so a batch that is delivered twice, or again after a lost job, gets the same verdicts and
appends nothing.

Defined cases: a null text is the empty text; of equal texts in one batch the largest id stays, a null id
loses to any id; repeated rows (same id, same text) have the same verdict, and ``deduplicate`` returns one of
them; an empty batch gives an empty result; other columns are neither read nor lost.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lesionlens.llm.columns import text_of, unpacked, whole_row
from lesionlens.session import checkpoint_root, materialize


class DigestIndex:
    """A digest index below ``path``, a folder that driver and executors share.

    ``buckets`` is fixed when the index is made (default: the session's shuffle partitions, so that a
    cluster's setting decides) and is found again from the folder's name when it is opened later.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        found = self._made(path)
        if found and buckets not in (None, found):
            raise ValueError(f"the index below {path} has {found} buckets")
        self.buckets = found or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{path.rstrip('/')}/buckets-{self.buckets}"
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"create table if not exists {self.name} (digest string, keep_id bigint) using parquet "
            f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{self.path}'"
        )

    def _made(self, path: str) -> int | None:
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/buckets-*")
        fs = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = fs.globStatus(pattern)
        return int(there[0].getPath().getName().rpartition("-")[2]) if there else None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """Add rows whose digests the index lacks: one sorted file for each bucket."""
        (
            fresh.select("digest", "keep_id").repartition(self.buckets, "digest").write.format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder."""
    from uuid import uuid4

    return DigestIndex(spark, f"{checkpoint_root(spark).rstrip('/')}/digest-index-{uuid4().hex}", buckets)


def digest_of(text: str) -> Column:
    return F.sha2(text_of(text), 256)


def verdicts(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row of a batch; its new digests go into ``index``.

    ``group_size`` counts the rows of the batch with that text. The texts are read once and not shuffled.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), digest_of(text).alias("digest")), "digests")
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    index.append(groups.join(index.table().hint("merge"), "digest", "left_anti"))
    keepers = groups.drop("keep_id").join(index.table().hint("merge"), "digest")
    return (
        rows.join(materialize(keepers, "keepers").hint("merge"), "digest")
        .select("doc_id", "digest", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def deduplicate(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    kept = materialize(
        verdicts(docs, index, doc_id, text).where("kept").groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies")), "kept",
    )
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).alias("_id"), digest_of(text).alias("_digest"))
    mine = (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("doc_id"))
    stay = rows.join(kept.where("copies = 1").hint("merge"), mine, "left_semi").select("row")
    again = kept.where("copies > 1")
    if not again.isEmpty():  # the same row more than once: one of them, whatever order they are read in
        one = rows.join(again.hint("merge"), mine, "left_semi").groupBy("_digest", "_id").agg(
            F.min_by("row", F.xxhash64("row")).alias("row")
        )
        stay = stay.unionByName(one.select("row"))
    return unpacked(stay, "row", docs.columns)
