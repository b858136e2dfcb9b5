"""Probability ensembling, mirrored averaging and intensity statistics of voxel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.operators.lookup import lookup
from lesionlens.operators.ordered import quantiles

AXES = ("z", "y", "x")
PROBABILITIES = ("p_wt", "p_tc", "p_et")


def ensemble_mean(
    prob: DataFrame, keys: list[str], member: str, weights: dict, values: tuple[str, ...] = PROBABILITIES
) -> DataFrame:
    """Weighted mean of member probabilities per voxel.

    A member without a row for a voxel counts as 0 there, so sums are divided by the declared total
    weight; a member without a declared weight is an error. Members may only be sparsified after averaging, never before at a decision threshold.
    """
    total = float(sum(weights.values()))
    w = F.create_map(*[F.lit(v) for kv in weights.items() for v in (kv[0], float(kv[1]))])
    undeclared = F.raise_error(F.concat(F.lit("no weight declared for member "), F.coalesce(F.col(member).cast("string"), F.lit("NULL"))))
    w = F.coalesce(F.try_element_at(w, F.col(member)), undeclared.cast("double"))
    return prob.groupBy(*keys, *AXES).agg(
        *[(F.sum(F.col(v).cast("double") * w) / F.lit(total)).alias(v) for v in values]
    )


def tta_mean(
    prob: DataFrame, keys: list[str], flip: str, dims: DataFrame, dim_keys: list[str],
    codes: tuple[str, ...] = ("", "x", "y", "z", "xy", "xz", "yz", "xyz"), values: tuple[str, ...] = PROBABILITIES,
) -> DataFrame:
    """Predictions of mirrored volumes turned back and averaged.

    ``flip`` names the mirrored axes (a subset of "xyz"); ``dims`` holds dim_z, dim_y, dim_x per key.
    A mirrored case without dimensions and a code that is not one of ``codes`` are errors.
    """
    rows = lookup(prob, dims.select(*dim_keys, *[f"dim_{a}" for a in AXES]), dim_keys, list(AXES))
    size = {a: F.coalesce(F.col(f"dim_{a}"), F.raise_error(F.lit("a case without dimensions")).cast("int")) for a in AXES}
    for a in AXES:
        back = F.when(F.contains(flip, F.lit(a)), size[a] - 1 - F.col(a)).otherwise(F.col(a))
        rows = rows.withColumn(a, back.cast("int"))
    return ensemble_mean(rows, keys, flip, {c: 1.0 for c in codes}, values)


def masked_zscore(
    img: DataFrame, by: list[str], value: str, mask: Column, spread: list[str] = AXES, out: str = "z_score"
) -> DataFrame:
    """Standardise intensities by mean and population sd of the mask; rows outside the mask become 0."""
    stats = img.where(mask).groupBy(*by).agg(F.avg(value).alias("_a"), F.stddev_pop(value).alias("_s"))
    rows = lookup(img, stats, by, list(spread))
    scaled = (F.col(value) - F.col("_a")) / F.greatest(F.col("_s"), F.lit(1e-8))
    return rows.withColumn(out, F.when(mask, scaled).otherwise(F.lit(0.0))).drop("_a", "_s")


def intensity_fingerprint(img: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by, n, min, max, mean, std, percentile_00_5, median, percentile_99_5) of foreground intensities."""
    base = img.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    parts = {"percentile_00_5": 0.005, "median": 0.5, "percentile_99_5": 0.995}
    return base.join(quantiles(img, by, value, parts, order, count="n"), by)


def median_geometry(geom: DataFrame, columns: list[str], case: str = "case_id") -> DataFrame:
    """One row: the median of each shape and spacing column over cases."""
    items = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    mid = quantiles(geom.select(case, F.inline(items)), ["_c"], "_v", {"_m": 0.5}, [case])
    return mid.agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"median_{c}") for c in columns])
