"""Voxel-level agreement, region masks, shape measures and erosion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.functions.fixed import DECISION_THRESHOLD, REGION_LABELS, REGIONS
from lesionlens.functions.scalars import any_bit, flag, float_gt, pack_bits
from lesionlens.operators.components import TILE, whole_tiles

AXES = ("z", "y", "x")


def region_mask(lab: str | Column, region: str) -> Column:
    lab = F.col(lab) if isinstance(lab, str) else lab
    return flag(lab.isin(*REGION_LABELS[region]))


def with_region_masks(df: DataFrame, lab: str, prefix: str = "is_") -> DataFrame:
    return df.withColumns({f"{prefix}{r}": region_mask(lab, r) for r in REGIONS})


def decode_regions(
    p_wt: str = "p_wt", p_tc: str = "p_tc", et_mask: Column | None = None,
    wt: float = DECISION_THRESHOLD, tc: float = DECISION_THRESHOLD,
) -> Column:
    """Label of a voxel from its region probabilities and the ET decision; a later region overwrites.

    WT gives 2, TC gives 1, the ET mask gives 3, so predicted WT and TC depend on the ET decision.
    """
    et = et_mask if et_mask is not None else float_gt("p_et", DECISION_THRESHOLD)
    return (
        F.when(flag(et), 3).when(flag(float_gt(p_tc, tc)), 1).when(flag(float_gt(p_wt, wt)), 2).otherwise(0)
    ).cast("tinyint")


def align_voxels(pred: DataFrame, ref: DataFrame, keys: list[str], lab: str = "lab") -> DataFrame:
    """Prediction and reference labels side by side; absent background rows become 0.

    Union and one aggregation instead of a full outer join: one shuffle and no null keys.
    """
    zero = F.lit(0).cast("tinyint")
    both = pred.select(*keys, *AXES, F.col(lab).alias("pred_lab"), zero.alias("ref_lab")).unionByName(
        ref.select(*keys, *AXES, zero.alias("pred_lab"), F.col(lab).alias("ref_lab"))
    )
    return both.groupBy(*keys, *AXES).agg(F.max("pred_lab").alias("pred_lab"), F.max("ref_lab").alias("ref_lab"))


def reconstruct_match(decoded: DataFrame, exported: DataFrame, keys: list[str], lab: str = "lab") -> DataFrame:
    """Per case the number of voxels where a reconstruction and an export differ, and whether none does."""
    differs = F.col("pred_lab") != F.col("ref_lab")
    return (
        align_voxels(decoded, exported, keys, lab)
        .groupBy(*keys)
        .agg(F.count_if(differs).alias("n_different"))
        .withColumn("matches", F.col("n_different") == 0)
    )


def confusion(voxels: DataFrame, by: list[str], pred: str = "pred_lab", ref: str = "ref_lab") -> DataFrame:
    """(by, region, tp, fp, fn) voxel counts of aligned labels, all regions in one pass."""
    aggs = []
    for r in REGIONS:
        p, q = region_mask(pred, r), region_mask(ref, r)
        aggs += [
            F.count_if(p & q).alias(f"tp_{r}"), F.count_if(p & ~q).alias(f"fp_{r}"), F.count_if(~p & q).alias(f"fn_{r}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(r).alias("region"), *[F.col(f"{c}_{r}").alias(c) for c in ("tp", "fp", "fn")])
        for r in REGIONS
    ])
    return voxels.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))


def dice_value(tp: Column, n_pred: Column, n_ref: Column) -> Column:
    """2 tp / (pred + ref), missing when both masks are empty."""
    return F.try_divide(F.lit(2.0) * tp, (n_pred + n_ref).cast("double"))


def dice(voxels: DataFrame, by: list[str], pred: str = "pred_lab", ref: str = "ref_lab") -> DataFrame:
    """(by, region, dice) of aligned labels."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(voxels, by, pred, ref).select(*by, "region", dice_value(tp, tp + fp, tp + fn).alias("dice"))


def erode_bits(vox: DataFrame, keys: list[str], bits: str, out: str = "interior", tile: int = TILE) -> DataFrame:
    """``vox`` with the masks left after erosion with a 3x3x3 cube; everything outside the rows is background.

    A volume is cut into cubes of ``tile`` voxels a side; a voxel at a face also goes to the cubes beyond it, which answer only for
    their own. So voxels are shuffled once, and one BIGINT carries all masks. In a cube the erosion is done axis by axis: a voxel
    stays if both neighbours on a line stayed.
    """
    tiles, columns = [f"_tile_{a}" for a in AXES], vox.columns
    df = vox
    for a, t in zip(AXES, tiles):
        df = df.withColumn(t, F.explode(F.sequence(*[F.floor((F.col(a).cast("bigint") + d) / F.lit(tile)) for d in (-1, 1)])))
    group = [*keys, *tiles]
    side = tile + 2

    def erode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches, group, nulls=True):
            local = [table.column(a).to_numpy().astype(np.int64) - table.column(t).to_numpy() * tile + 1 for a, t in zip(AXES, tiles)]
            code = ((number.astype(np.int64) * side + local[0]) * side + local[1]) * side + local[2]
            kept = table.column(bits).fill_null(0).to_numpy().astype(np.int64)
            for step in (1, side, side * side):
                both = kept.copy()
                for there in (code - step, code + step):
                    at = np.minimum(np.searchsorted(code, there), len(code) - 1)
                    both &= np.where(code[at] == there, kept[at], 0)
                kept = both
            owned = np.logical_and.reduce([(c >= 1) & (c <= tile) for c in local])
            done = table.select(columns).append_column(out, pa.array(kept)).filter(pa.array(owned))
            yield from done.combine_chunks().to_batches()

    parts = int(vox.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartition(parts, *group).sortWithinPartitions(*group, *AXES)
    return spread.mapInArrow(erode, T.StructType([*vox.schema.fields, T.StructField(out, T.LongType())]))


def surface_voxels(vox: DataFrame, keys: list[str], masks: dict[str, Column]) -> DataFrame:
    """(keys, mask, z, y, x) of mask voxels with fewer than 26 neighbours in the same mask."""
    df = erode_bits(vox.withColumn("_m", pack_bits(list(masks.values()))), keys, "_m")
    on = [F.when(any_bit("_m", k) & ~any_bit("interior", k), F.lit(n)) for k, n in enumerate(masks)]
    return df.select(*keys, F.explode(F.array_compact(F.array(*on))).alias("mask"), *AXES)


def _with_masks(vox: DataFrame, keep: list, bits: str, names: list[str]) -> DataFrame:
    """One row per voxel and mask it belongs to; the aggregation that follows combines them map-side."""
    on = [F.when(any_bit(bits, k), F.lit(k)) for k in range(len(names))]
    rows = vox.select(*keep, F.explode(F.array_compact(F.array(*on))).alias("_k"))
    return rows.withColumn("mask", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1))


def bounding_boxes(vox: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: voxel count, bounding box, span and the share of the box that is filled."""
    aggs = [F.count(F.lit(1)).alias("volume")]
    for a in AXES:
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}")]
    spans = {f"span_{a}": (F.col(f"max_{a}") - F.col(f"min_{a}") + 1).cast("bigint") for a in AXES}
    box = reduce(lambda p, q: p * q, [F.col(f"span_{a}") for a in AXES])
    return vox.groupBy(*keys).agg(*aggs).withColumns(spans).withColumn("extent", F.col("volume") / box)


def centroids(vox: DataFrame, keys: list[str], shapes: DataFrame, shape_keys: list[str]) -> DataFrame:
    """Mean position per axis as a share of the volume's size (dim_z, dim_y, dim_x of ``shapes``).

    A case without a shape is kept with missing positions.
    """
    mean = vox.groupBy(*keys).agg(*[F.avg(a).alias(f"_m{a}") for a in AXES])
    return mean.join(shapes, shape_keys, "left").select(
        *keys, *[(F.col(f"_m{a}") / F.col(f"dim_{a}")).alias(f"centroid_{a}") for a in AXES]
    )


def compactness(surface: Column, volume: Column) -> Column:
    """Surface voxels over volume to the power two thirds."""
    return surface / F.power(volume.cast("double"), F.lit(2.0 / 3.0))


def shape_measures(vox: DataFrame, keys: list[str], masks: dict[str, Column]) -> DataFrame:
    """(keys, mask): volume, bounding box, sums of positions and surface voxels, for all masks in one pass."""
    df = erode_bits(vox.withColumn("_m", pack_bits(list(masks.values()))).where("_m <> 0"), keys, "_m")
    aggs = [
        F.count(F.lit(1)).alias("volume"),
        F.sum(F.expr("1 - (shiftrightunsigned(interior, _k) & 1)")).alias("surface_voxels"),
    ]
    for a in AXES:
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.avg(a).alias(f"mean_{a}")]
    rows = _with_masks(df, [*keys, *AXES, "interior"], "_m", list(masks))
    return rows.groupBy(*keys, "mask").agg(*aggs)
