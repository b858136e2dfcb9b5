"""Sinks: staged writes that refuse an existing target, a deterministic order, snapshots of inputs.

A table is written to a staging folder beside its target and renamed at the end, so a target is whole (with Spark's success mark in it) or
absent; what an interrupted write leaves is never read and never in the way. Of two writers of one target the later is refused.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameWriter, functions as F

from lesionlens.session import hadoop_path


def _publish(df: DataFrame, writer: DataFrameWriter, format: str, path: str) -> None:
    spark, path = df.sparkSession, path.rstrip("/")
    fs, target = hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} already exists")
    folder, _, name = path.rpartition("/")
    staging = f"{folder}/.{name}.{uuid.uuid4().hex}"
    writer.format(format).save(staging)
    if fs.exists(target) or not fs.rename(hadoop_path(spark, staging)[1], target):
        fs.delete(hadoop_path(spark, staging)[1], True)
        raise FileExistsError(f"{path} already exists")


def write_table(df: DataFrame, path: str, order: list[str] = (), format: str = "parquet", single: bool = False) -> None:
    """Write a result table; an existing target is an error.

    ``order`` sorts globally. ``single`` (one file) is for summary tables whose size does not grow
    with the number of cases.
    """
    out = df.orderBy(*order) if order else df
    if single:
        out = out.coalesce(1)
    _publish(df, out.write.option("header", True) if format == "csv" else out.write, format, path)


def write_cases(df: DataFrame, path: str, case: str, order: list[str], format: str = "csv") -> None:
    """One file for each case, in a folder ``<case>=<value>`` of its own, its rows in ``order``; an existing target is an error."""
    out = df.repartition(case).sortWithinPartitions(case, *order).write.partitionBy(case)
    _publish(df, out.option("header", True) if format == "csv" else out, format, path)


def write_document(df: DataFrame, path: str) -> None:
    """Nested metadata rows as JSON lines; an existing target is an error."""
    _publish(df, df.write, "json", path)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Store the input of an analysis and read the stored copy; an existing target is an error."""
    _publish(df, df.write, "parquet", path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bootstrap_document(table: DataFrame, source: str, seed: int, replicates: int, scope: str) -> DataFrame:
    """One nested row per estimate table: settings and the list of estimates (a row per hypothesis)."""
    columns = [c for c in ("label", "feature", "outcome", "controls", "partial_rho", "ci_low", "ci_high") if c in table.columns]
    return table.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("estimates")).select(
        F.lit(source).alias("input"), F.lit(seed).alias("seed"),
        F.struct(F.lit(scope).alias("scope"), F.lit(replicates).alias("replicates")).alias("bootstrap"), "estimates",
    )
