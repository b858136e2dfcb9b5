"""Case scores of several configurations: reshaping, pairing, summaries and contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lesionlens.functions.fixed import (
    COMPARISONS, OUTCOMES, REGIONS, REPLICATES, REPLICATES_SHORT, SEED,
)
from lesionlens.functions.scalars import norm_missing
from lesionlens.operators.resample import (
    bootstrap_independent, bootstrap_mean, bootstrap_paired, bootstrap_region_mean,
)


def unpivot_scores(scores: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value), missing values kept."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), norm_missing(m).alias("value")) for m in metrics])
    return scores.select(*keys, F.inline(items))


def aggregate_scores(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, n, mean, sd) of the finite values, sample standard deviation."""
    return unpivot_scores(scores, by, metrics).groupBy(*by, "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def paired_join(
    scores: DataFrame, config: str, case: str, metrics: list[str], comparisons: dict[str, tuple[str, str]] = COMPARISONS
) -> DataFrame:
    """(comparison, metric, case, left, right) for cases that both configurations have.

    All contrasts come from one aggregation by (case, metric) instead of a join per contrast.
    """
    names = list(dict.fromkeys(n for pair in comparisons.values() for n in pair))
    side = {n: f"_c{k}" for k, n in enumerate(names)}
    long = unpivot_scores(scores.where(F.col(config).isin(*names)), [config, case], metrics)
    wide = long.groupBy(case, "metric").agg(
        *[F.max(F.when(F.col(config) == n, F.struct("value"))).alias(c) for n, c in side.items()]
    )
    rows = F.array_compact(F.array(*[
        F.when(
            F.col(side[a]).isNotNull() & F.col(side[b]).isNotNull(),
            F.struct(F.lit(name).alias("comparison"), F.col(side[a]).value.alias("left"), F.col(side[b]).value.alias("right")),
        )
        for name, (a, b) in comparisons.items()
    ]))
    return wide.select(case, "metric", F.inline(rows)).select("comparison", "metric", case, "left", "right")


def paired_comparisons(
    scores: DataFrame, config: str, case: str, metrics: list[str],
    comparisons: dict[str, tuple[str, str]] = COMPARISONS, replicates: int = REPLICATES, salt: int = SEED,
) -> DataFrame:
    """All contrasts x metrics with paired bootstrap intervals, as one job."""
    pairs = paired_join(scores, config, case, metrics, comparisons)
    return bootstrap_paired(pairs, "left", "right", ["comparison", "metric"], case, replicates, salt)


def paired_effects(
    evaluated: DataFrame, case: str = "case_id", left: str = "crossfit", right: str = "baseline",
    metrics: tuple[str, ...] = tuple(f"{f}_{r}" for f in ("dsc", "nsd") for r in REGIONS),
    replicates: int = REPLICATES, salt: int = SEED,
) -> DataFrame:
    """(metric, n, baseline_mean, crossfit_mean, mean_difference, ci_low, ci_high, dropped counts)."""
    pairs = paired_join(evaluated, "configuration", case, list(metrics), {"effect": (left, right)})
    out = bootstrap_paired(pairs, "left", "right", ["metric"], case, replicates, salt)
    return out.select(
        "metric", "n", F.col("right_mean").alias(f"{right}_mean"), F.col("left_mean").alias(f"{left}_mean"),
        "mean_difference", "ci_low", "ci_high", "n_dropped_left", "n_dropped_right",
    )


def source_target_gap(
    target: DataFrame, source: DataFrame, values: dict[str, str], case: str, replicates: int = REPLICATES, salt: int = SEED
) -> DataFrame:
    """(region, n_target, n_source, target_mean, source_mean, mean_difference, ci_low, ci_high).

    One row per entry of ``values`` (column -> region name) and a MEAN row over all of them, where the
    regions of a case stay together.
    """
    def long(df: DataFrame) -> DataFrame:
        items = F.array(*[F.struct(F.lit(n).alias("region"), F.col(c).cast("double").alias("_value")) for c, n in values.items()])
        return df.select(case, F.inline(items))

    regions = bootstrap_independent(long(target), long(source), "_value", ["region"], case, replicates, salt)
    mean = bootstrap_region_mean(target, source, list(values), case, replicates, salt)
    columns = ["n_target", "n_source", "target_mean", "source_mean", "mean_difference", "ci_low", "ci_high"]
    return regions.select("region", *columns).unionByName(mean.select(F.lit("MEAN").alias("region"), *columns))


def domain_summary(
    features: DataFrame, domain: str, case: str = "case_id",
    outcomes: tuple[str, ...] = (*OUTCOMES, "failure_bottom10"), masked: dict[str, str] | None = None,
    replicates: int = REPLICATES_SHORT, salt: int = SEED,
) -> DataFrame:
    """Per domain: n, and per outcome its finite n, mean and interval.

    ``masked``: outcome -> flag column; rows without the flag do not count for that outcome.
    """
    masked = {"failure_bottom10": "failure_eligible"} if masked is None else masked
    value = {
        o: F.when(F.col(masked[o]), F.col(o).cast("double")) if o in masked else F.col(o).cast("double") for o in outcomes
    }
    items = F.array(*[F.struct(F.lit(o).alias("_o"), v.alias("_x")) for o, v in value.items()])
    per = bootstrap_mean(features.select(domain, case, F.inline(items)), "_x", [domain, "_o"], case, replicates, salt)
    wide = per.groupBy(domain).agg(*[
        F.max(F.when(F.col("_o") == o, F.col(c))).alias(f"{o}_{c}") for o in outcomes for c in ("n", "mean", "ci_low", "ci_high")
    ])
    return features.groupBy(domain).agg(F.count(F.lit(1)).alias("n")).join(wide, domain, "left")


def failure_counts(features: DataFrame, wt_below: float, et_below: float) -> DataFrame:
    """One row of failure counts and their denominators."""
    return features.agg(
        F.count_if("failure_bottom10").alias("bottom10"),
        F.count_if("failure_eligible").alias("complete"),
        F.count_if(F.col("et_dice") < et_below).alias("et_failures"),
        F.count("et_dice").alias("et_evaluable"),
        F.count_if(F.col("wt_dice") < wt_below).alias("wt_failures"),
        F.count(F.lit(1)).alias("cases"),
    )


def top_by_magnitude(df: DataFrame, value: str, ties: list[str], k: int = 12) -> DataFrame:
    """The ``k`` rows of largest absolute value; ``ties`` columns make the order unique."""
    return df.orderBy(F.abs(value).desc_nulls_last(), *ties).limit(k)
