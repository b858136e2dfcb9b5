"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A ledger is a folder that driver and executors share. Each batch adds two tables to it: signed document rows
(+1 a document that is there now, -1 one that was) and the batch's totals by group. Totals of all batches add up
to the rollup; a revised or deleted document is taken back with the counts it was entered with, which the document
rows hold. To find those a batch reads the ledger's document rows (ids and counts, no texts); :meth:`TokenLedger.compact`
keeps them at one row for each document and version, however many batches there were.

*Versions.* A document is counted under each tokenizer version that it was entered with. A revision replaces the counts of its own
version; a deletion takes the document out of all.

*Commits.* A batch has an id. Its totals are written last, and Spark's success mark in their folder is the
commit. A committed batch that is applied again changes nothing; one that was interrupted is not read by anyone and is
overwritten when it is applied again. A compaction commits in the same way, with the list of the batches it stands for, and
removes their folders afterwards; one that was interrupted is ignored.

Tokens are counted where the text is read; only ids and counts are shuffled. A tokenizer's version is its name and a
digest of its vocabulary file, so counts of two vocabularies never mix.

Defined cases: a null or empty text has 0 tokens and is counted as a document; null sources and languages are groups of their
own; of several changes to one id in a batch the one with the largest ``order`` counts, of equal ones the
largest count; rows with a null id are documents of their own that no later batch can revise; deleting an unknown id changes
nothing; an empty batch commits empty totals; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lesionlens.llm import kernels

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# the split pattern that belongs to the vocabulary: a fixed value
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP = ["source", "lang", "tokenizer"]
ROWS = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, sign int"
TOTALS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


@dataclass(frozen=True)
class Tokenizer:
    """A rank file (base64 token and rank in each line) that every node has at ``path``."""

    path: str = VOCABULARY
    pattern: str = PATTERN

    @property
    def version(self) -> str:
        with open(self.path, "rb") as f:
            return f"{self.path.rpartition('/')[2].partition('.')[0]}-{hashlib.sha256(f.read()).hexdigest()[:12]}"


@cache
def encoding(tokenizer: Tokenizer):
    import tiktoken

    with open(tokenizer.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=tokenizer.pattern, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` in place of the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer).encode_ordinary
        for batch in kernels.pieces(batches, text):
            at = batch.schema.get_field_index(text)
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield batch.set_column(at, "tokens", n)

    fields = [T.StructField("tokens", T.LongType()) if f.name == text else f for f in docs.schema.fields]
    return docs.mapInArrow(count, T.StructType(fields))


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = Tokenizer()):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer

    def _folder(self, part: str, batch: str) -> str:
        return f"{self.path}/{part}/batch-{hashlib.md5(batch.encode()).hexdigest()}"

    def _files(self, pattern: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, [s.getPath() for s in fs.globStatus(path) or []]

    def _snapshot(self) -> tuple[str, set[str]]:
        """(name, folder names of the batches it stands for) of the last committed compaction; empty if there is none."""
        names = [p.getParent().getParent().getName() for p in self._files("snapshots/*/batches/_SUCCESS")[1]]
        if not names:
            return "", set()
        last = max(names)
        return last, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{last}/batches").collect()}

    def _committed(self) -> list[str]:
        """Folder names of the committed batches, compacted ones included."""
        found = {p.getParent().getName() for p in self._files("totals/batch-*/_SUCCESS")[1]}
        return sorted(found | self._snapshot()[1])

    def _is_committed(self, batch: str) -> bool:
        return self._folder("", batch).rpartition("/")[2] in self._committed()

    def _read(self, part: str, schema: str) -> DataFrame:
        snapshot, inside = self._snapshot()
        folders = [f"{self.path}/{part}/{n}" for n in self._committed() if n not in inside]
        folders += [f"{self.path}/snapshots/{snapshot}/{part}"] if snapshot else []
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def compact(self) -> None:
        """Replace all committed batches by one table of the documents that count now, and their totals.

        No batch may be applied meanwhile.
        """
        names, (old, _) = self._committed(), self._snapshot()
        if not names:
            return
        new = f"{len(names):012d}-{uuid4().hex}"
        folder = f"{self.path}/snapshots/{new}"
        self.documents().select("doc_id", "source", "lang", "tokenizer", "tokens", F.col("sign").cast("int")).write.parquet(f"{folder}/rows")
        self.rollup().write.parquet(f"{folder}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{folder}/batches")
        for part in ("rows", "totals"):
            for name in names:
                for fs, paths in [self._files(f"{part}/{name}")]:
                    for path in paths:
                        fs.delete(path, True)
        if old and old != new:
            fs, paths = self._files(f"snapshots/{old}")
            for path in paths:
                fs.delete(path, True)

    def documents(self) -> DataFrame:
        """The documents that count now, one row each."""
        rows = self._read("rows", ROWS)
        now = rows.groupBy("doc_id", "source", "lang", "tokenizer", "tokens").agg(F.sum("sign").alias("sign"))
        return now.where("sign > 0")

    def apply(self, batch: str, changes: DataFrame, delete: Column | None = None, order: Column | None = None, text: str = "text") -> bool:
        """Commit a batch of (doc_id, text, source, lang); rows for which ``delete`` holds remove their document.

        Returns False, and does nothing, if the batch is committed already.
        """
        if self._is_committed(batch):
            return False
        nothing = F.lit(None)
        rows = changes.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
            (delete if delete is not None else F.lit(False)).alias("gone"), (order if order is not None else F.lit(0)).alias("turn"), F.col(text).alias(text),
        )
        rows = counted(rows.withColumn(text, F.when(F.col("gone"), nothing).otherwise(F.col(text))), self.tokenizer, text)
        rows = rows.withColumn("tokenizer", F.lit(self.tokenizer.version))
        value = ["source", "lang", "tokenizer", "tokens"]
        last = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("turn", "tokens", "gone", "source", "lang", "tokenizer")).alias("c"))
        last = last.select("doc_id", F.col("c.gone").alias("gone"), *[F.col(f"c.{v}").alias(v) for v in value])
        loose = rows.where("doc_id is null and not gone")
        entered = last.where("not gone").select("doc_id", *value).unionByName(loose.select("doc_id", *value)).withColumn("sign", F.lit(1))
        if self._committed():
            changed = last.select("doc_id", "gone")
            before = self.documents().join(changed, "doc_id").where(F.col("gone") | (F.col("tokenizer") == self.tokenizer.version))
            entered = entered.unionByName(before.select("doc_id", *value, (-F.col("sign")).cast("int").alias("sign")))
        folder = self._folder("rows", batch)
        entered.write.mode("overwrite").parquet(folder)
        totals = self.spark.read.schema(ROWS).parquet(folder).groupBy(*GROUP).agg(
            F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        totals.write.mode("overwrite").parquet(self._folder("totals", batch))
        return True

    def rollup(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches; groups without documents are left out."""
        sums = self._read("totals", TOTALS).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0")
