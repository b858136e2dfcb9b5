"""Quantile flags and quantile bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lesionlens.functions.fixed import FAILURE_PERCENTILES
from lesionlens.functions.scalars import flag, norm_missing
from lesionlens.operators.lookup import with_scalars
from lesionlens.operators.ordered import quantiles


def quantile_flags(
    df: DataFrame, value: str = "mean_dice", case: str = "case_id",
    percentiles: tuple[int, ...] = FAILURE_PERCENTILES, prefix: str = "failure",
) -> DataFrame:
    """Add {prefix}_eligible (value present) and {prefix}_bottomNN (value at or below that quantile)."""
    score = norm_missing(value)  # NaN and infinities are missing
    cuts = quantiles(df, [], value, {f"_q{p}": p / 100 for p in percentiles}, [case])
    out = with_scalars(df, cuts).withColumn(f"{prefix}_eligible", score.isNotNull())
    for p in percentiles:
        out = out.withColumn(f"{prefix}_bottom{p:02d}", flag(score <= F.col(f"_q{p}")))
    return out.drop(*[f"_q{p}" for p in percentiles])


def qcut(df: DataFrame, column: str, q: int, duplicates: str = "raise", case: str = "case_id", out: str = "bin") -> DataFrame:
    """Quantile bin 0..q-1 of each row: right-closed, lowest value included; missing values are dropped.

    Equal edges either merge (``duplicates="drop"``) or fail the query (``"raise"``).
    """
    edges = quantiles(df, [], column, {f"_e{k}": k / q for k in range(q + 1)}, [case])
    array = F.array_distinct(F.array(*[F.col(f"_e{k}") for k in range(q + 1)]))
    if duplicates == "raise":
        array = F.when(F.size(array) == q + 1, array).otherwise(F.raise_error(F.lit("bin edges are not unique")))
    rows = with_scalars(df.where(F.col(column).isNotNull()), edges.select(array.alias("_edges")))
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return rows.withColumn(out, below.cast("int")).drop("_edges")


def binned_median(df: DataFrame, x: str, y: str, q: int = 12, case: str = "case_id") -> DataFrame:
    """(bin, n, median_x, median_y) per quantile bin of x, equal edges merged."""
    rows = qcut(df, x, q, "drop", case)
    mx = quantiles(rows, ["bin"], x, {"median_x": 0.5}, [case], count="n")
    my = quantiles(rows, ["bin"], y, {"median_y": 0.5}, [case])
    return mx.join(my, "bin", "left")


def binned_rate(df: DataFrame, x: str, hit: str, q: int = 5, case: str = "case_id") -> DataFrame:
    """(bin, rate, count) of a flag per quantile bin of x; equal edges are an error."""
    return qcut(df, x, q, "raise", case).groupBy("bin").agg(
        F.avg(F.col(hit).cast("double")).alias("rate"), F.count(hit).alias("count")
    )
