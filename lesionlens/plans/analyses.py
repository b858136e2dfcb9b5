"""Whole analyses: each takes tables and a target folder, checks, computes, writes and returns its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lesionlens.functions.fixed import (
    BASELINE_MIN_VOXELS, BASELINE_THRESHOLD, COMPARISONS, CONFIGURATIONS, ET_FAILURE_BELOW, FAILURE_PERCENTILES, GRID_MIN_VOXELS,
    GRID_THRESHOLDS, METRIC_FAMILIES, MORPHOLOGY_FEATURES, OUTCOMES, PARTIAL_HYPOTHESES, PRIMARY_FAMILIES, REGIONS,
    REPLICATES, REPLICATES_SHORT, SEED, UNKNOWN_DOMAIN, UNKNOWN_GROUP, VOLUME_SUFFIX, WT_FAILURE_BELOW,
)
from lesionlens.functions.scalars import below, case_id, domain_of, row_mean
from lesionlens.operators import binning, embed, grid, guards, ranks, scores
from lesionlens.operators.lookup import with_scalars
from lesionlens.operators.morphology import case_morphology
from lesionlens.operators.voxels import decode_regions, reconstruct_match
from lesionlens.session import materialize
from lesionlens.sources import readers
from lesionlens.sources.writers import bootstrap_document, snapshot, write_document, write_table

VOXEL_KEYS = ["case_id", "fold"]


def _write_all(tables: dict[str, tuple[DataFrame, list[str]]], target: str) -> dict[str, DataFrame]:
    """Write result tables one by one below ``target`` and return the stored copies."""
    stored = {}
    for name, (df, order) in tables.items():
        path = f"{target.rstrip('/')}/{name}"
        write_table(df, path, order)
        stored[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return stored


def take_inputs(target: str, **inputs: DataFrame) -> dict[str, DataFrame]:
    """Snapshots of an analysis' inputs below its target, with a table of their digests; the analysis reads the stored copies."""
    root = f"{target.rstrip('/')}/inputs"
    taken = {name: snapshot(df, f"{root}/{name}") for name, df in inputs.items()}
    digests = [guards.table_digest(guards.row_digests(df)).select(F.lit(name).alias("input"), "n_rows", "digest") for name, df in taken.items()]
    write_table(reduce(DataFrame.unionByName, digests), f"{root}/digests", ["input"], single=True)
    return taken


def package_cases(labels: DataFrame, root: str, target: str, case: str = "case_id", lab: str = "lab", folder: str | None = None, glob: str = f"*{VOLUME_SUFFIX}") -> DataFrame:
    """The manifest of the files below ``root``, one for each case of ``labels`` (case, label), written to ``target``.

    The case of a file is its name without suffix, or the value of the folder ``<folder>=<value>`` it is in. Missing, extra and repeated
    files and labels outside the domain are errors, named before anything is written.
    """
    files = readers.read_contents(labels.sparkSession, root, glob)
    name = F.regexp_extract("path", rf"/{folder}=([^/]*)/", 1) if folder else case_id("path")
    files = materialize(files.select(name.alias(case), F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256"), "contents")
    domain = materialize(guards.label_domain(labels.withColumn(case, F.col(case).cast("string")), [case], lab), "domain")
    guards.assert_empty(guards.reconcile(domain, files, [case]).where("status <> 'ok'"), "missing or extra files")
    guards.assert_empty(guards.repeated_keys(files, [case]), "several files of a case")
    guards.assert_empty(domain.where("not valid"), "labels outside the domain")
    out = domain.join(files, case).select(case, "file", "length", "sha256", "labels")
    write_table(with_scalars(out, out.agg(F.count(F.lit(1)).alias("n_cases"))), target, [case])
    return labels.sparkSession.read.parquet(target)


def threshold_sweep(
    vox: DataFrame, target: str, cases: DataFrame | None = None, expected: dict[str, float] | None = None,
    thresholds: tuple[float, ...] = GRID_THRESHOLDS, min_voxels: tuple[int, ...] = GRID_MIN_VOXELS,
    replicates: int = REPLICATES, salt: int = SEED,
) -> dict[str, DataFrame]:
    """Cross-fitted search for the ET operating point.

    ``vox``: (case_id, fold, z, y, x, p_wt, p_tc, p_et, ref_lab, export_lab). The baseline reconstruction
    has to equal the exported labels in every case; ``expected`` are baseline mean Dice values by region
    that have to be met within 1e-10.
    """
    if BASELINE_THRESHOLD not in thresholds or BASELINE_MIN_VOXELS not in min_voxels:
        raise ValueError("the grid must contain the baseline operating point")
    vox = take_inputs(target, voxels=vox)["voxels"]
    axes = ["case_id", "z", "y", "x"]
    guards.assert_empty(guards.fold_leaks(vox, "case_id", "fold"), "a case occurs in more than one fold")
    rebuilt = vox.select(*axes, decode_regions().alias("lab"))
    exported = vox.select(*axes, F.col("export_lab").cast("tinyint").alias("lab"))
    differs = reconstruct_match(rebuilt, exported, ["case_id"]).where(~F.col("matches"))
    guards.assert_empty(differs, "reconstruction and export differ")

    cells = _write_all({"grid_per_case": (grid.grid_per_case(vox, VOXEL_KEYS, thresholds, min_voxels, cases=cases),
                                          [*VOXEL_KEYS, "threshold", "min_voxels"])}, target)["grid_per_case"]
    stored = _write_all({
        "grid_summary": (grid.grid_summary(cells), ["threshold", "min_voxels"]),
        "fold_selection": (grid.select_operating_points(cells), ["held_out_fold"]),
        "fold_counts": (grid.fold_counts(cells), ["fold"]),
    }, target)
    if expected is not None:
        base = stored["grid_summary"].where(
            (F.col("threshold") == BASELINE_THRESHOLD) & (F.col("min_voxels") == BASELINE_MIN_VOXELS)
        )
        seen = base.select(F.inline(F.array(*[F.struct(F.lit(r).alias("region"), F.col(f"mean_dsc_{r}").alias("value")) for r in expected])))
        want = vox.sparkSession.createDataFrame(list(expected.items()), "region string, value double")
        guards.assert_empty(grid.regression_gate(seen, want, ["region"]), "baseline Dice is off")
    evaluated = grid.evaluate_points(vox, VOXEL_KEYS, stored["fold_selection"], cases=cases)
    stored |= _write_all({"crossfit_per_case": (evaluated, [*VOXEL_KEYS, "configuration"])}, target)
    effects = scores.paired_effects(stored["crossfit_per_case"], replicates=replicates, salt=salt)
    stored |= _write_all({"paired_effects": (effects, ["metric"])}, target)
    settings(vox.sparkSession, f"{target.rstrip('/')}/settings", analysis="threshold_sweep", thresholds=thresholds,
             min_voxels=min_voxels, replicates=replicates, seed=salt)
    return {"grid_per_case": cells, **stored}


def case_features(metrics: DataFrame, vox: DataFrame, shapes: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row per case: Dice outcomes of ``metrics``, shape features of both sides, group, outcome mean and flags.

    ``metrics``: (case_id, fold, wt_dice, tc_dice, et_dice, ...); ``vox``: (case_id, z, y, x, ref_lab, pred_lab);
    ``groups``: (case_id, header_domain), or (case_id, group_code) to be named by the fixed dictionary.
    """
    df = metrics.join(case_morphology(vox, ["case_id"], shapes), "case_id", "left")
    if groups is not None and "group_code" in groups.columns:
        df = df.join(groups, "case_id", "left").withColumn("header_domain", domain_of("group_code"))
        df = df.withColumn("group_code", F.coalesce("group_code", F.lit(UNKNOWN_GROUP)))
    elif groups is not None:
        df = df.join(groups, "case_id", "left").fillna(UNKNOWN_DOMAIN, ["header_domain"])
    return df.withColumn("mean_dice", row_mean(*[f"{r}_dice" for r in ("wt", "tc", "et")]))


def failure_atlas(
    features: DataFrame, target: str, domain: str = "header_domain", columns: tuple[str, ...] = MORPHOLOGY_FEATURES,
    outcomes: tuple[str, ...] = OUTCOMES, hypotheses=PARTIAL_HYPOTHESES, strata: tuple[str, ...] = ("fold",),
    replicates: int = REPLICATES_SHORT, salt: int = SEED,
) -> dict[str, DataFrame]:
    """Where segmentation fails: domains, associations, failure effects, sensitivity, bins, components."""
    features = take_inputs(target, features=features)["features"]
    flagged = binning.quantile_flags(features).withColumns(
        {"failure_et_lt_05": below("et_dice", ET_FAILURE_BELOW), "failure_wt_lt_08": below("wt_dice", WT_FAILURE_BELOW)}
    )
    df = _write_all({"case_features": (flagged, ["case_id"])}, target)["case_features"]
    columns, outcomes, hypotheses = list(columns), list(outcomes), list(hypotheses)
    flags = {p: f"failure_bottom{p:02d}" for p in FAILURE_PERCENTILES}
    rho = materialize(ranks.spearman(df, columns, outcomes).withColumn("_test", F.concat_ws("/", "feature", "outcome")), "rho")
    effects = materialize(ranks.mann_whitney(df, "failure_bottom10", columns, "failure_eligible"), "effects")
    partial = materialize(ranks.partial_spearman(df, hypotheses), "partial")
    scaled = embed.standardize(embed.impute_median(df, columns), columns)
    explained, points = embed.pca(scaled, columns)
    stored = _write_all({
        "domain_summary": (scores.domain_summary(df, domain, replicates=replicates, salt=salt), [domain]),
        "spearman": (ranks.bh_fdr(rho, "p_value", [], "_test").drop("_test"), ["feature", "outcome"]),
        "failure_effects": (ranks.bh_fdr(effects, "p_value", [], "feature"), ["feature"]),
        "partial_spearman": (ranks.bh_fdr(partial, "p_value", [], "label"), ["label"]),
        "partial_intervals": (ranks.partial_rho_table(df, hypotheses, list(strata), replicates=replicates, salt=salt), ["label"]),
        "failure_sensitivity": (ranks.failure_sensitivity(df, columns, flags), ["percentile", "feature"]),
        "kruskal": (ranks.kruskal(df, domain, outcomes), ["outcome"]),
        "pca_explained": (explained, ["component"]),
        "pca_scores": (points, ["case_id"]),
        "failure_counts": (scores.failure_counts(df, WT_FAILURE_BELOW, ET_FAILURE_BELOW), ["cases"]),
        "wt_volume_medians": (binning.binned_median(df, "log_wt_volume", "wt_dice"), ["bin"]),
        "et_volume_medians": (binning.binned_median(df, "log_et_volume", "et_dice"), ["bin"]),
        "volume_failure_rate": (binning.binned_rate(df.where("failure_eligible"), "log_wt_volume", "failure_bottom10"), ["bin"]),
    }, target)
    stored |= _write_all({
        "strongest_spearman": (scores.top_by_magnitude(stored["spearman"], "rho", ["feature", "outcome"]), ["feature", "outcome"]),
        "strongest_effects": (scores.top_by_magnitude(stored["failure_effects"], "rank_biserial", ["feature"]), ["feature"]),
    }, target)
    document = bootstrap_document(stored["partial_intervals"], "case_features", salt, replicates, "case-sampling uncertainty only")
    write_document(document, f"{target.rstrip('/')}/partial_intervals_document")
    settings(df.sparkSession, f"{target.rstrip('/')}/settings", analysis="failure_atlas", features=columns, outcomes=outcomes,
             replicates=replicates, seed=salt)
    return {"case_features": df, **stored}


def validation_scores(
    table: DataFrame, source: DataFrame, target: str, config: str = "config", case: str = "subject_id",
    configurations: tuple[str, ...] = CONFIGURATIONS, comparisons: dict[str, tuple[str, str]] = COMPARISONS,
    shifted: str = "f1_tta", replicates: int = REPLICATES, salt: int = SEED,
) -> dict[str, DataFrame]:
    """Paired contrasts of configurations, their aggregates, and the gap of one of them to source scores.

    ``table``: one row per configuration and case; ``source``: (case, {region}_dice).
    """
    taken = take_inputs(target, scores=table.where(F.col(config).isin(*configurations)), source=source)
    table, source = taken["scores"], taken["source"]
    guards.assert_empty(guards.align_guard(table, config, case, len(configurations)), "cases do not align")
    guards.assert_empty(guards.repeated_keys(table, [config, case]), "repeated case")
    metrics = [f"{f}_{r}" for f in METRIC_FAMILIES for r in REGIONS]
    paired = scores.paired_comparisons(table, config, case, metrics, comparisons, replicates, salt)
    family = F.regexp_extract("metric", r"^(.*)_[a-z]+$", 1)
    paired = paired.withColumn("metric_family", family).withColumn("primary", family.isin(*PRIMARY_FAMILIES))
    names = {f"dice_{r}": r.upper() for r in REGIONS}
    goal = table.where(F.col(config) == shifted).select(case, *[F.col(f"global_dsc_{r}").alias(f"dice_{r}") for r in REGIONS])
    origin = source.select(case, *[F.col(f"{r}_dice").alias(f"dice_{r}") for r in REGIONS])
    stored = _write_all({
        "paired_comparisons": (paired, ["comparison", "metric"]),
        "source_target_gap": (scores.source_target_gap(goal, origin, names, case, replicates, salt), ["region"]),
        "aggregate_scores": (scores.aggregate_scores(table, [config], metrics), [config, "metric"]),
    }, target)
    settings(table.sparkSession, f"{target.rstrip('/')}/settings", analysis="validation_scores",
             configurations=configurations, replicates=replicates, seed=salt)
    return stored


def settings(spark, target: str, **values) -> None:
    """Metadata of an analysis as one JSON row."""
    write_document(spark.range(1).select(*[F.lit(list(v) if isinstance(v, tuple) else v).alias(k) for k, v in values.items()]), target)
