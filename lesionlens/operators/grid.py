"""Operating-point search: threshold x minimum size, scored per case, selected leave-one-fold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lesionlens.functions.fixed import (
    BASELINE_MIN_VOXELS, BASELINE_THRESHOLD, DECISION_THRESHOLD, GRID_MIN_VOXELS, GRID_THRESHOLDS, REGIONS,
    SURFACE_TOLERANCE,
)
from lesionlens.functions.scalars import any_bit, flag, float_gt, pack_bits, row_mean
from lesionlens.operators.components import AXES, Fragments, label_fragments
from lesionlens.operators.lookup import lookup
from lesionlens.operators.surface import surface_dice
from lesionlens.operators.voxels import dice_value, region_mask
from lesionlens.session import materialize

COUNTED = ("size", "hit_et", "add_tc", "hit_tc", "add_wt", "hit_wt")


def _base_flags(ref: str) -> dict[str, Column]:
    """Prediction masks that do not depend on the ET rule, and reference masks."""
    tc = flag(float_gt("p_tc", DECISION_THRESHOLD))
    wt = tc | flag(float_gt("p_wt", DECISION_THRESHOLD))
    return {"tc": tc, "wt": wt} | {f"ref_{r}": region_mask(ref, r) for r in REGIONS}


def grid_per_case(
    vox: DataFrame,
    keys: list[str],
    thresholds: tuple[float, ...] = GRID_THRESHOLDS,
    min_voxels: tuple[int, ...] = GRID_MIN_VOXELS,
    ref: str = "ref_lab",
    cases: DataFrame | None = None,
    tile: int = 64,
) -> DataFrame:
    """(keys, threshold, min_voxels, dsc_et, dsc_tc, dsc_wt, tp_et, fp_et, fn_et).

    The voxels are shuffled once for all thresholds. From there on only sums per component are needed:
    the minimum size keeps or drops whole components, and WT and TC change by the component's voxels
    outside the ET-independent masks. Give ``cases`` when a case may have no voxel rows at all.
    """
    flags = _base_flags(ref)
    n = len(thresholds)
    masks = [float_gt("p_et", t) for t in thresholds] + [flags["ref_et"]]
    df = vox.withColumn("_m", pack_bits(masks)).withColumn(
        "_f", pack_bits([~flags["tc"], ~flags["tc"] & flags["ref_tc"], ~flags["wt"], ~flags["wt"] & flags["ref_wt"]])
    )
    totals = df.groupBy(*keys).agg(
        *[F.count_if(flags[f"ref_{r}"]).alias(f"ref_{r}") for r in REGIONS],
        *[F.count_if(flags[r]).alias(f"base_{r}") for r in ("tc", "wt")],
        *[F.count_if(flags[r] & flags[f"ref_{r}"]).alias(f"base_hit_{r}") for r in ("tc", "wt")],
    )
    frags = label_fragments(df, keys, "_m", n + 1, payload=["_f"], tile=tile)
    ref_frag = F.element_at("frag", n + 1)
    bit = "cast(shiftright(_f, {}) & 1 as bigint)".format
    pieces = (
        frags.voxels.select(
            *keys, "_f", (ref_frag >= 0).alias("_hit"), F.posexplode(F.slice("frag", 1, n)).alias("mask", "frag")
        )
        .where("frag >= 0")
        .groupBy(*keys, "mask", "frag")
        .agg(
            F.count(F.lit(1)).alias("size"), F.count_if("_hit").alias("hit_et"),
            *[F.sum(F.expr(bit(k))).alias(c) for k, c in enumerate(COUNTED[2:])],
        )
    )
    comps = frags.resolve(pieces)
    if frags.merged is not None:  # else a piece is a whole component
        comps = comps.groupBy(*keys, "mask", "comp").agg(*[F.sum(c).alias(c) for c in COUNTED])
    comps = materialize(comps, "components")

    def per_size(c: str, m: int) -> Column:
        kept = F.lit(True) if m <= 1 else F.col("size") >= m
        if c == "fp":
            return F.count_if(kept & (F.col("hit_et") == 0)).alias(f"fp_{m}")
        return F.sum(F.when(kept, F.col(c)).otherwise(0)).alias(f"{c}_{m}")

    pred = comps.groupBy(*keys, "mask").agg(*[per_size(c, m) for m in min_voxels for c in (*COUNTED, "fp")])

    touch = (
        frags.voxels.select(*keys, ref_frag.alias("rfrag"), F.posexplode(F.slice("frag", 1, n)).alias("mask", "frag"))
        .where("frag >= 0 and rfrag >= 0").distinct()
    )
    touch = frags.resolve(touch)
    touch = frags.resolve(touch, "rfrag", "rcomp", F.lit(n))
    # only components with a voxel of the reference are met, so no other is sent to the join
    best = (
        touch.join(comps.where("hit_et > 0").select(*keys, "mask", "comp", "size"), [*keys, "mask", "comp"])
        .groupBy(*keys, "mask", "rcomp").agg(F.max("size").alias("_best"))
        .groupBy(*keys, "mask")
        .agg(*[(F.count_if(F.lit(True) if m <= 1 else F.col("_best") >= m)).alias(f"tp_{m}") for m in min_voxels])
    )
    lesions = (
        frags.resolve(
            frags.voxels.select(*keys, ref_frag.alias("frag")).where("frag >= 0").distinct(), mask=F.lit(n)
        )
        .select(*keys, "comp").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ref"))
    )

    if cases is not None:
        totals = cases.select(*keys).join(totals, keys, "left")
    cells = totals.join(lesions, keys, "left").withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wide = cells.join(pred, [*keys, "mask"], "left").join(best, [*keys, "mask"], "left")
    wide = wide.fillna(0, [c for c in wide.columns if c not in keys]).withColumn(
        "threshold", F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("mask") + 1)
    )
    rows = []
    for m in min_voxels:
        c = {k: F.col(f"{k}_{m}") for k in (*COUNTED, "fp", "tp")}
        rows.append(F.struct(
            F.lit(int(m)).alias("min_voxels"),
            dice_value(c["hit_et"], c["size"], F.col("ref_et")).alias("dsc_et"),
            dice_value(F.col("base_hit_tc") + c["hit_tc"], F.col("base_tc") + c["add_tc"], F.col("ref_tc")).alias("dsc_tc"),
            dice_value(F.col("base_hit_wt") + c["hit_wt"], F.col("base_wt") + c["add_wt"], F.col("ref_wt")).alias("dsc_wt"),
            c["tp"].alias("tp_et"), c["fp"].alias("fp_et"), (F.col("n_ref") - c["tp"]).alias("fn_et"),
        ))
    return wide.select(*keys, "threshold", F.inline(F.array(*rows)))


def evaluate_points(
    vox: DataFrame,
    keys: list[str],
    points: DataFrame,
    fold: str = "fold",
    baseline: tuple[float, int] = (BASELINE_THRESHOLD, BASELINE_MIN_VOXELS),
    ref: str = "ref_lab",
    cases: DataFrame | None = None,
    tile: int = 64,
    tolerance: float = SURFACE_TOLERANCE,
) -> DataFrame:
    """(keys, configuration, threshold, min_voxels, dsc_*, nsd_*) at the baseline and at the fold's own point.

    ``points``: (held_out_fold, threshold, min_voxels), one row per fold. ``keys`` include ``fold``.
    """
    own = materialize(points.select(
        F.col("held_out_fold").alias(fold), F.col("threshold").alias("_t"), F.col("min_voxels").alias("_s")
    ), "points")
    df = lookup(vox, own, [fold], [k for k in keys if k != fold] + ["z", "y", "x"])
    base_t, base_m = baseline
    flags = _base_flags(ref)
    df = df.withColumn(
        "_m", pack_bits([float_gt("p_et", base_t), flag(float_gt("p_et", F.col("_t")))])
    ).withColumn("_f", pack_bits([flags["tc"], flags["wt"], *[flags[f"ref_{r}"] for r in REGIONS]]))
    frags = label_fragments(df, keys, "_m", 2, payload=["_s"], tile=tile)
    needed = F.when(F.col("mask") == 0, F.lit(base_m)).otherwise(F.col("_s"))
    dropped = _piece_sizes(frags, keys).where((needed > 1) & (F.col("size") < needed))

    # ET decision per voxel: every mask voxel except those of components that are too small
    et = (
        frags.voxels.select(*keys, *AXES, F.posexplode("frag").alias("mask", "frag"))
        .where("frag >= 0")
        .join(dropped.select(*keys, "mask", "frag"), [*keys, "mask", "frag"], "left_anti")
        .select(*keys, *AXES, F.when(F.col("mask") == 0, 1).otherwise(2).alias("_et"), F.lit(0).cast("bigint").alias("_f"))
    )
    rest = df.where("_f <> 0").select(*keys, *AXES, F.lit(0).alias("_et"), "_f")
    merged = et.unionByName(rest).groupBy(*keys, *AXES).agg(
        F.bit_or("_et").alias("_et"), F.bit_or("_f").alias("_f")
    )
    masks_of = {}
    for k, name in enumerate(("baseline", "crossfit")):
        hit = any_bit("_et", k)
        masks_of[name] = {"et": hit, "tc": hit | any_bit("_f", 0), "wt": hit | any_bit("_f", 1)}
    ref_of = {r: any_bit("_f", 2 + k) for k, r in enumerate(REGIONS)}
    final = materialize(merged, "decided")
    pairs = {f"{n}_{r}": (masks_of[n][r], ref_of[r]) for n in masks_of for r in REGIONS}
    aggs = []
    for name, (p, r) in pairs.items():
        aggs += [F.count_if(p & r).alias(f"h_{name}"), F.count_if(p).alias(f"p_{name}"), F.count_if(r).alias(f"r_{name}")]
    overlap = final.groupBy(*keys).agg(*aggs)
    surface = surface_dice(final, keys, pairs, tolerance)
    every = (vox if cases is None else cases).select(*keys).distinct()
    wide = every.join(overlap, keys, "left").join(surface, keys, "left")
    wide = lookup(wide, own, [fold], [k for k in keys if k != fold] or keys)
    rows = []
    for name, (t, m) in {
        "baseline": (F.lit(float(base_t)), F.lit(int(base_m))), "crossfit": (F.col("_t"), F.col("_s").cast("int"))
    }.items():
        rows.append(F.struct(
            F.lit(name).alias("configuration"), t.cast("double").alias("threshold"), m.alias("min_voxels"),
            *[dice_value(F.col(f"h_{name}_{r}"), F.col(f"p_{name}_{r}"), F.col(f"r_{name}_{r}")).alias(f"dsc_{r}")
              for r in REGIONS],
            *[F.col(f"{name}_{r}").alias(f"nsd_{r}") for r in REGIONS],
        ))
    return wide.select(*keys, F.inline(F.array(*rows)))


def _piece_sizes(frags: Fragments, keys: list[str]) -> DataFrame:
    """Every piece with the size of the whole component it belongs to."""
    pieces = (
        frags.voxels.select(*keys, "_s", F.posexplode("frag").alias("mask", "frag")).where("frag >= 0")
        .groupBy(*keys, "mask", "frag", "_s").agg(F.count(F.lit(1)).alias("size"))
    )
    if frags.merged is None:
        return pieces
    named = frags.resolve(pieces.withColumn("_piece", F.col("frag")))
    whole = named.groupBy(*keys, "mask", "comp").agg(F.sum("size").alias("size"))
    return named.drop("size").join(whole, [*keys, "mask", "comp"]).withColumnRenamed("_piece", "frag")


def _lesion_scores() -> dict[str, Column]:
    tp, fp, fn = F.col("tp_et"), F.col("fp_et"), F.col("fn_et")
    p, r = F.col("lesion_precision_et"), F.col("lesion_recall_et")
    return {
        "lesion_precision_et": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(1.0),
        "lesion_recall_et": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0),
        "lesion_f1_et": F.when(p + r > 0, F.try_divide(2 * p * r, p + r)).otherwise(0.0),
        "lesion_f2_et": F.when(4 * p + r > 0, F.try_divide(5 * p * r, 4 * p + r)).otherwise(0.0),
    }


def _finish(df: DataFrame) -> DataFrame:
    means = {f"mean_dsc_{r}": F.try_divide(F.col(f"_s_{r}"), F.col(f"_c_{r}").cast("double")) for r in REGIONS}
    df = df.withColumns(means).withColumn("mean_region_dsc", row_mean(*means))
    for name, c in _lesion_scores().items():
        df = df.withColumn(name, c)
    return df.drop(*[f"_{k}_{r}" for k in "sc" for r in REGIONS])


def _cell_sums(grid: DataFrame, by: list[str]) -> DataFrame:
    return grid.groupBy(*by).agg(
        *[F.coalesce(F.sum(f"dsc_{r}"), F.lit(0.0)).alias(f"_s_{r}") for r in REGIONS],
        *[F.count(f"dsc_{r}").alias(f"_c_{r}") for r in REGIONS],
        *[F.sum(c).cast("bigint").alias(c) for c in ("tp_et", "fp_et", "fn_et")],
    )


def grid_summary(grid: DataFrame, by: tuple[str, ...] = ("threshold", "min_voxels")) -> DataFrame:
    """Per cell: mean Dice per region (missing skipped), mean of the region means, lesion sums and scores."""
    return _finish(_cell_sums(grid, list(by)))


def lofo_summary(grid: DataFrame, fold: str = "fold", by: tuple[str, ...] = ("threshold", "min_voxels")) -> DataFrame:
    """:func:`grid_summary` of all other folds for each held-out fold: cell total minus the fold's own part.

    One pass over the grid; the window runs over folds x cells sums only.
    """
    own = _cell_sums(grid, [fold, *by])
    cell = Window.partitionBy(*by)
    summed = [c for c in own.columns if c not in (fold, *by)]
    rest = own.select(
        F.col(fold).alias("held_out_fold"), *by, *[(F.sum(c).over(cell) - F.col(c)).alias(c) for c in summed]
    )
    return _finish(rest)


def select_operating_points(grid: DataFrame, fold: str = "fold") -> DataFrame:
    """Best cell per held-out fold by region mean, ET mean, threshold, size -- all descending, missing last."""
    best = Window.partitionBy("held_out_fold").orderBy(
        *[F.col(c).desc_nulls_last() for c in ("_region", "_et", "threshold", "min_voxels")]
    )
    s = lofo_summary(grid, fold)
    # sums of the complement are taken by subtraction; 12 digits keep equal cells equal
    s = s.withColumn("_region", F.round("mean_region_dsc", 12)).withColumn("_et", F.round("mean_dsc_et", 12))
    return (
        s.withColumn("_n", F.row_number().over(best)).where("_n = 1")
        .select(
            "held_out_fold", "threshold", "min_voxels",
            F.col("mean_region_dsc").alias("calibration_mean_region_dsc"),
            F.col("mean_dsc_et").alias("calibration_mean_dsc_et"),
        )
    )


def best_cells(summary: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` cells of a summary with the highest mean of region means."""
    return summary.orderBy(
        F.col("mean_region_dsc").desc_nulls_last(), F.col("threshold").desc(), F.col("min_voxels").desc()
    ).limit(k)


def fold_counts(cases: DataFrame, fold: str = "fold", case: str = "case_id") -> DataFrame:
    return cases.groupBy(fold).agg(F.countDistinct(case).alias("n_cases"))


def regression_gate(
    observed: DataFrame, expected: DataFrame, keys: list[str], value: str = "value", atol: float = 1e-10
) -> DataFrame:
    """Rows of ``expected`` whose observed value is absent or further away than ``atol``."""
    joined = expected.withColumnRenamed(value, "expected").join(
        observed.select(*keys, F.col(value).alias("observed")), keys, "left"
    )
    return joined.where(~flag(F.abs(F.col("observed") - F.col("expected")) <= atol))
