"""Shape features of all regions of reference and prediction, one row per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.functions.fixed import LARGE_COMPONENT
from lesionlens.functions.scalars import log_volume, pack_bits, relative_bias, safe_ratio
from lesionlens.operators.components import label_fragments
from lesionlens.operators.voxels import compactness, region_mask, shape_measures

AXES = ("x", "y", "z")
COUNTS = ("volume", "components", "components_10", "surface_voxels", "span_x", "span_y", "span_z")
SHAPES = ("largest_fraction", "compactness", "extent", "centroid_x", "centroid_y", "centroid_z")


def morphology(
    vox: DataFrame, keys: list[str], masks: dict[str, Column], shapes: DataFrame,
    min_size: int = LARGE_COMPONENT, tile: int = 64,
) -> DataFrame:
    """(keys, mask, <13 measures>) for every key of ``shapes`` (dim_z, dim_y, dim_x) and every mask.

    An empty mask has zero counts and spans and missing ratios.
    """
    measures = shape_measures(vox, keys, masks)
    packed = vox.withColumn("_m", pack_bits(list(masks.values())))
    frags = label_fragments(packed, keys, "_m", len(masks), tile=tile, sizes=True)
    # pieces are nearly as many as voxels where these are scattered: none is grouped unless it may continue in another tile
    pieces = (
        frags.voxels.select(*keys, F.posexplode(F.arrays_zip("frag", "sizes")).alias("mask", "_piece"))
        .select(*keys, "mask", F.col("_piece.frag").alias("frag"), F.col("_piece.sizes").alias("size")).where("size > 0")
    )
    comps = frags.resolve(pieces)
    if frags.merged is not None:
        comps = comps.groupBy(*keys, "mask", "comp").agg(F.sum("size").alias("size"))
    names = F.array(*[F.lit(n) for n in masks])
    stats = (
        comps.groupBy(*keys, "mask")
        .agg(
            F.count(F.lit(1)).alias("components"),
            F.count_if(F.col("size") >= min_size).alias("components_10"),
            F.max("size").alias("_largest"),
        )
        .withColumn("mask", F.element_at(names, F.col("mask") + 1))
    )
    every = shapes.withColumn("mask", F.explode(names))
    df = every.join(measures, [*keys, "mask"], "left").join(stats, [*keys, "mask"], "left")
    span = {a: (F.col(f"max_{a}") - F.col(f"min_{a}") + 1).cast("double") for a in AXES}
    volume = F.col("volume").cast("double")
    out = df.select(
        *keys, "mask", volume.alias("volume"),
        F.col("components").cast("double").alias("components"),
        F.col("components_10").cast("double").alias("components_10"),
        (F.col("_largest") / volume).alias("largest_fraction"),
        F.col("surface_voxels").cast("double").alias("surface_voxels"),
        compactness(F.col("surface_voxels"), volume).alias("compactness"),
        (volume / (span["x"] * span["y"] * span["z"])).alias("extent"),
        *[(span[a] / F.col(f"dim_{a}")).alias(f"span_{a}") for a in AXES],
        *[(F.col(f"mean_{a}") / F.col(f"dim_{a}")).alias(f"centroid_{a}") for a in AXES],
    )
    return out.fillna(0.0, list(COUNTS))


def case_morphology(vox: DataFrame, keys: list[str], shapes: DataFrame, ref: str = "ref_lab", pred: str = "pred_lab",
                    tile: int = 64) -> DataFrame:
    """Wide features: {region}_* of the reference, pred_{region}_* of the prediction, ratios, logs, biases."""
    masks = {r: region_mask(ref, r) for r in ("wt", "tc", "et")}
    masks |= {f"pred_{r}": region_mask(pred, r) for r in ("wt", "tc", "et")}
    long = morphology(vox, keys, masks, shapes, tile=tile)
    wide = long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("mask") == m, F.col(c))).alias(f"{m}_{c}") for m in masks for c in (*COUNTS, *SHAPES)
    ])
    derived = {f"{r}_volume_bias": relative_bias(f"pred_{r}_volume", f"{r}_volume") for r in ("wt", "tc", "et")}
    for a, b in (("tc", "wt"), ("et", "wt"), ("et", "tc")):
        derived[f"{a}_{b}_ratio"] = safe_ratio(f"{a}_volume", f"{b}_volume")
    for r in ("wt", "tc", "et"):
        derived[f"log_{r}_volume"] = log_volume(f"{r}_volume")
    return wide.withColumns(derived)
