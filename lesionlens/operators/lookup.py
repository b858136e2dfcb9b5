"""Joins of a large table to a small or keyed one that neither assume size nor suffer from hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lesionlens.session import materialize

BROADCAST_ROWS = 200_000
SALTS = 16


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal names in which NULL keys meet; the keys are taken from the left."""
    there = {k: f"_right_{i}" for i, k in enumerate(keys)}
    met = [F.col(k).eqNullSafe(F.col(r)) for k, r in there.items()]
    return left.join(right.withColumnsRenamed(there), met, how).drop(*there.values())


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``left`` to a table that is unique on ``keys``, whose size is only known at run time. NULL keys meet.

    ``right`` is written and counted. Up to ``limit`` rows it is broadcast. Beyond that the join
    is salted: a row of ``left`` goes to one of ``salts`` copies of its key, chosen from its ``spread``
    columns, so that a key with a third of all rows is split over that many tasks.
    """
    right = materialize(right, "lookup")
    if right.count() <= limit:
        return null_safe_join(left, F.broadcast(right), keys, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the planner sees the size of the stored files, not that of all copies, and would broadcast them
    return null_safe_join(salted, copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of an ungrouped aggregate as a scalar subquery; missing if it has no row."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_scalars"))
    columns = [F.col("_scalars")[c].alias(c) for c in one_row.columns]
    return df.withColumn("_scalars", packed.scalar()).select(*[F.col(c) for c in df.columns], *columns)
