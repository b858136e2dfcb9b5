"""Catalogue, voxel part: queries over the derived volumes and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lesionlens.functions.fixed import (
    BASELINE_MIN_VOXELS, BASELINE_THRESHOLD, GRID_MIN_VOXELS, GRID_THRESHOLDS, REGIONS, REGION_LABELS, REPLICATES,
)
from lesionlens.functions.scalars import float_gt
from lesionlens.operators import components as cc, ensemble, grid as g, guards, morphology as mo, surface, voxels as vx
from lesionlens.operators.lookup import with_scalars
from lesionlens.operators.scores import paired_effects
from lesionlens.plans.check_sql import bootstrap_ctes, code, component_ctes, fx, interval, with_
from lesionlens.plans.fixtures import SIDE, fixture
from lesionlens.session import materialize

CASE = ["case_id"]
FOLDED = ["case_id", "fold"]


def vox(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "voxels").drop("pct_wt", "pct_tc", "pct_et")


def stored_vox(spark: SparkSession, sf: str) -> DataFrame:
    """The voxel table as a real one would be found: written, not derived again by each reader."""
    return materialize(vox(spark, sf), "voxels")


def shapes(df: DataFrame) -> DataFrame:
    return df.select("case_id").distinct().select("case_id", *[F.lit(SIDE).alias(f"dim_{a}") for a in "zyx"])


def decoded(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_lab", vx.decode_regions())


def masks(lab: str) -> dict:
    return {r: vx.region_mask(lab, r) for r in REGIONS}


# --- scans, decoding, agreement ---------------------------------------------------------------------

def region_masks(spark, sf):
    df = vx.with_region_masks(vox(spark, sf), "ref_lab")
    return df.groupBy("case_id").agg(*[F.count_if(f"is_{r}").alias(f"n_{r}") for r in REGIONS])


def region_decode(spark, sf):
    df = decoded(vox(spark, sf))
    return df.groupBy("case_id", F.col("pred_lab").cast("int").alias("lab")).agg(F.count(F.lit(1)).alias("n"))


def reconstruct_match(spark, sf):
    df = decoded(vox(spark, sf))
    rebuilt = df.select("case_id", "z", "y", "x", F.col("pred_lab").alias("lab"))
    exported = df.select("case_id", "z", "y", "x", F.col("export_lab").alias("lab")).where("lab > 0")
    return vx.reconstruct_match(rebuilt, exported, CASE)


def _aligned(spark, sf):
    df = decoded(vox(spark, sf))
    pred = df.where("pred_lab > 0").select("case_id", "z", "y", "x", F.col("pred_lab").alias("lab"))
    ref = df.where("ref_lab > 0").select("case_id", "z", "y", "x", F.col("ref_lab").alias("lab"))
    return vx.align_voxels(pred, ref, CASE)


def voxel_confusion(spark, sf):
    return vx.confusion(_aligned(spark, sf), CASE)


def dice(spark, sf):
    return vx.dice(decoded(vox(spark, sf)), CASE)


def label_domain(spark, sf):
    out = guards.label_domain(vox(spark, sf), CASE, "ref_lab", allowed=(0, 1, 3))
    return out.select("case_id", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"), "n_labels", "valid")


# --- shape ------------------------------------------------------------------------------------------

def bbox_extent(spark, sf):
    df = decoded(vox(spark, sf)).where(vx.region_mask("pred_lab", "et"))
    return vx.bounding_boxes(df, CASE)


def centroid(spark, sf):
    df = vox(spark, sf)
    out = vx.centroids(df.where(vx.region_mask("ref_lab", "wt")), CASE, shapes(df), CASE)
    return out.select("case_id", *[F.round(f"centroid_{a}", 9).alias(f"centroid_{a}") for a in "zyx"])


def surface_voxels(spark, sf):
    # the whole table as one dense volume, so that there is an interior
    df = vox(spark, sf).groupBy("fold", "z", "y", "x").agg(F.max("ref_lab").alias("ref_lab"))
    return vx.surface_voxels(df, ["fold"], masks("ref_lab"))


def compactness(spark, sf):
    df = vox(spark, sf).groupBy("fold", "z", "y", "x").agg(F.max("ref_lab").alias("ref_lab"))
    out = vx.shape_measures(df, ["fold"], masks("ref_lab"))
    value = F.round(vx.compactness(F.col("surface_voxels"), F.col("volume")), 9)
    return out.select("fold", "mask", "volume", "surface_voxels", value.alias("compactness"))


def surface_dice(spark, sf, tile=cc.TILE):
    df = decoded(vox(spark, sf))
    out = surface.surface_dice(df, CASE, {r: (masks("pred_lab")[r], masks("ref_lab")[r]) for r in REGIONS}, tile=tile)
    return out.select("case_id", *[F.round(r, 9).alias(f"nsd_{r}") for r in REGIONS])


def surface_dice_tiles(spark, sf):
    return surface_dice(spark, sf, SMALL_TILE)


# --- components -------------------------------------------------------------------------------------

def connected_components(spark, sf):
    return cc.connected_components(vox(spark, sf).select("case_id", "z", "y", "x"), CASE)


SMALL_TILE = 8  # of 20 voxels a side, so that pieces of a component meet across tiles


def connected_components_tiles(spark, sf):
    return cc.connected_components(vox(spark, sf).select("case_id", "z", "y", "x"), CASE, tile=SMALL_TILE)


def component_stats(spark, sf):
    comp = cc.connected_components(decoded(vox(spark, sf)), CASE, masks("pred_lab"))
    return cc.component_stats(comp, ["case_id", "mask"])


def min_size_filter(spark, sf):
    comp = cc.connected_components(decoded(vox(spark, sf)), CASE, {"et": vx.region_mask("pred_lab", "et")}).drop("mask")
    return cc.min_size_filter(comp, CASE, 5)


def lesion_match(spark, sf, tile=cc.TILE):
    comp = cc.connected_components(decoded(vox(spark, sf)), CASE, {
        "pred": vx.region_mask("pred_lab", "et"), "ref": vx.region_mask("ref_lab", "et"),
    }, tile)
    pred, ref = (comp.where(F.col("mask") == m).drop("mask") for m in ("pred", "ref"))
    return cc.lesion_match(pred, ref, CASE)


def lesion_match_tiles(spark, sf):
    return lesion_match(spark, sf, SMALL_TILE)


def morphology(spark, sf, tile=cc.TILE):
    df = decoded(stored_vox(spark, sf))
    named = masks("ref_lab") | {f"pred_{r}": m for r, m in masks("pred_lab").items()}
    out = mo.morphology(df, CASE, named, shapes(df), tile=tile)
    return out.select("case_id", "mask", *[F.round(c, 12).alias(c) for c in (*mo.COUNTS, *mo.SHAPES)])


def morphology_tiles(spark, sf):
    return morphology(spark, sf, SMALL_TILE)


# --- operating points -------------------------------------------------------------------------------

def _grid(spark, sf):
    return g.grid_per_case(stored_vox(spark, sf), FOLDED)


def grid_cross(spark, sf):
    df = vox(spark, sf).agg(*[F.count_if(float_gt("p_et", t)).alias(f"n{k}") for k, t in enumerate(GRID_THRESHOLDS)])
    cells = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("min_voxels"), F.col(f"n{k}").alias("n_voxels"))
        for k, t in enumerate(GRID_THRESHOLDS) for m in GRID_MIN_VOXELS
    ])
    return df.select(F.inline(cells))


def grid_per_case(spark, sf):
    return _grid(spark, sf)


def grid_per_case_tiles(spark, sf):
    return g.grid_per_case(stored_vox(spark, sf), FOLDED, tile=SMALL_TILE)


SUMMARY = [f"mean_dsc_{r}" for r in REGIONS] + ["mean_region_dsc"]
LESIONS = ["tp_et", "fp_et", "fn_et"]
SCORES = ["lesion_precision_et", "lesion_recall_et", "lesion_f1_et", "lesion_f2_et"]


def _rounded(df, keys):
    return df.select(*keys, *LESIONS, *[F.round(c, 9).alias(c) for c in (*SUMMARY, *SCORES)])


def grid_summary(spark, sf):
    return _rounded(g.grid_summary(_grid(spark, sf)), ["threshold", "min_voxels"])


def lofo_summary(spark, sf):
    return _rounded(g.lofo_summary(_grid(spark, sf)), ["held_out_fold", "threshold", "min_voxels"])


def crossfit_select(spark, sf):
    out = g.select_operating_points(_grid(spark, sf))
    means = ("calibration_mean_region_dsc", "calibration_mean_dsc_et")
    return out.select("held_out_fold", "threshold", "min_voxels", *[F.round(c, 9).alias(c) for c in means])


def apply_selection(spark, sf):
    cells = materialize(_grid(spark, sf), "grid")
    points = g.select_operating_points(cells).withColumnRenamed("held_out_fold", "fold")
    return cells.join(F.broadcast(points.select("fold", "threshold", "min_voxels")), ["fold", "threshold", "min_voxels"])


def topk_grid(spark, sf):
    s = g.grid_summary(_grid(spark, sf)).withColumn("mean_region_dsc", F.round("mean_region_dsc", 9))
    return g.best_cells(s.select("threshold", "min_voxels", "mean_region_dsc"))


def fold_counts(spark, sf):
    return g.fold_counts(vox(spark, sf))


def regression_gate(spark, sf):
    cells = g.grid_summary(_grid(spark, sf)).where((F.col("threshold") == BASELINE_THRESHOLD) & (F.col("min_voxels") == BASELINE_MIN_VOXELS))
    rows = F.array(*[F.struct(F.lit(r).alias("region"), F.col(f"mean_dsc_{r}").alias("value")) for r in REGIONS])
    observed = cells.select(F.inline(rows))
    direct = vx.dice(decoded(vox(spark, sf)), CASE).groupBy("region").agg(F.avg("dice").alias("value"))
    # one expected value is moved, so exactly one violation has to come out
    expected = direct.withColumn("value", F.col("value") + F.when(F.col("region") == "tc", 1e-3).otherwise(0.0))
    out = g.regression_gate(observed, expected, ["region"])
    return out.select("region", F.round("expected", 9).alias("expected"), F.round("observed", 9).alias("observed"))


def _evaluated(spark, sf):
    df = stored_vox(spark, sf)
    return g.evaluate_points(df, FOLDED, g.select_operating_points(g.grid_per_case(df, FOLDED)))


def crossfit_per_case(spark, sf):
    out = _evaluated(spark, sf)
    values = [f"{f}_{r}" for f in ("dsc", "nsd") for r in REGIONS]
    return out.select("case_id", "fold", "configuration", "threshold", "min_voxels", *[F.round(c, 9).alias(c) for c in values])


def paired_effects_q(spark, sf):
    out = paired_effects(_evaluated(spark, sf), replicates=REPLICATES)
    values = ("baseline_mean", "crossfit_mean", "mean_difference", "ci_low", "ci_high")
    return out.select("metric", "n", *[F.round(c, 9).alias(c) for c in values], "n_dropped_left", "n_dropped_right")


# --- ensembles and intensities ----------------------------------------------------------------------

WEIGHTS = {k: 1.0 for k in range(1, 8)}


def ensemble_mean(spark, sf):
    df = fixture(spark, sf, "members")
    out = ensemble.ensemble_mean(df, CASE, "member", WEIGHTS)
    return out.select("case_id", "z", "y", "x", *[F.round(p, 6).alias(p) for p in ensemble.PROBABILITIES])


def tta_mean(spark, sf):
    df = fixture(spark, sf, "members")
    names = F.create_map(*[F.lit(v) for k, c in enumerate(("", "x", "y", "z", "xy", "xz", "yz")) for v in (k + 1, c)])
    df = df.withColumn("flip", F.try_element_at(names, F.col("member")))
    out = ensemble.tta_mean(df, CASE, "flip", shapes(df), CASE, codes=("", "x", "y", "z", "xy", "xz", "yz"))
    return out.select("case_id", "z", "y", "x", *[F.round(p, 6).alias(p) for p in ensemble.PROBABILITIES])


def masked_zscore(spark, sf):
    df = materialize(fixture(spark, sf, "image"), "image")  # read for the moments and again for the voxels
    out = ensemble.masked_zscore(df, ["case_id", "channel"], "intensity", F.col("inside") == 1)
    return out.select("case_id", "channel", "z", "y", "x", F.round("z_score", 6).alias("z_score"))


def intensity_fingerprint(spark, sf):
    df = fixture(spark, sf, "image").where("inside = 1")
    out = ensemble.intensity_fingerprint(df, ["channel"], "intensity", ["case_id", "z", "y", "x"])
    cols = ("min", "max", "mean", "std", "percentile_00_5", "median", "percentile_99_5")
    return out.select("channel", "n", *[F.round(c, 6).alias(f"v_{c}") for c in cols])


def median_geometry(spark, sf):
    box = vox(spark, sf).groupBy("case_id").agg(
        *[(F.max(a) - F.min(a) + 1).alias(f"dim_{a}") for a in "zyx"], (F.count(F.lit(1)) / F.lit(100.0)).alias("spacing")
    )
    return ensemble.median_geometry(box, ["dim_z", "dim_y", "dim_x", "spacing"])


QUERIES = {
    "region_masks": region_masks, "region_decode": region_decode,
    "reconstruct_match": reconstruct_match, "voxel_confusion": voxel_confusion, "dice": dice, "label_domain": label_domain,
    "bbox_extent": bbox_extent, "centroid": centroid, "surface_voxels": surface_voxels, "compactness": compactness,
    "surface_dice": surface_dice, "surface_dice_tiles": surface_dice_tiles, "connected_components": connected_components, "component_stats": component_stats,
    "min_size_filter": min_size_filter, "lesion_match": lesion_match, "morphology": morphology,
    "grid_cross": grid_cross, "grid_per_case": grid_per_case, "grid_summary": grid_summary, "lofo_summary": lofo_summary,
    "crossfit_select": crossfit_select, "apply_selection": apply_selection, "topk_grid": topk_grid,
    "fold_counts": fold_counts, "regression_gate": regression_gate, "crossfit_per_case": crossfit_per_case,
    "paired_effects": paired_effects_q, "ensemble_mean": ensemble_mean, "tta_mean": tta_mean,
    "connected_components_tiles": connected_components_tiles, "lesion_match_tiles": lesion_match_tiles,
    "morphology_tiles": morphology_tiles, "grid_per_case_tiles": grid_per_case_tiles,
    "masked_zscore": masked_zscore, "intensity_fingerprint": intensity_fingerprint, "median_geometry": median_geometry,
}


# --- checking SQL -----------------------------------------------------------------------------------

def _in(lab: str, r: str) -> str:
    return f"{lab} in ({', '.join(map(str, REGION_LABELS[r]))})"


V = fx("voxels")
# the label decode, written from the integer percentages
DEC = ("dec", "select *, case when pct_et > 50 then 3 when pct_tc > 50 then 1 when pct_wt > 50 then 2 else 0 end as pred_lab from voxels")
ONE_VOLUME = ("vol", "select fold, z, y, x, max(ref_lab) as ref_lab from voxels group by 1, 2, 3, 4")


def _long(source: str, keys: str, lab: str = "ref_lab", prefix: str = "") -> str:
    return " union all ".join(
        f"select {keys}, '{prefix}{r}' as mask, z, y, x from {source} where {_in(lab, r)}" for r in REGIONS
    )


def _surface_ctes(mask: str, key: str) -> list[tuple[str, str]]:
    """surf(mask, key, z, y, x): voxels with fewer than 26 neighbours of the same mask."""
    return [
        ("steps", "select a.d as dz, b.d as dy, c.d as dx from (select unnest([-1,0,1]) as d) a, (select unnest([-1,0,1]) as d) b, (select unnest([-1,0,1]) as d) c"),
        ("moved", f"select mask, {key}, z, y, x, z + dz as nz, y + dy as ny, x + dx as nx from {mask} cross join steps"),
        ("near", f"""select a.mask, a.{key}, a.z, a.y, a.x, count(*) as n from moved a
            join {mask} b on b.mask = a.mask and b.{key} = a.{key} and b.z = a.nz and b.y = a.ny and b.x = a.nx
            group by 1, 2, 3, 4, 5"""),
        ("surf", f"select mask, {key}, z, y, x from near where n < 27"),
    ]


def _nsd_ctes(pairs: str) -> list[tuple[str, str]]:
    """nsd(k, case_id, nsd) from ``pairs``(k, case_id, side, z, y, x) with side 'p' or 'r'."""
    return [
        ("corner", f"""select k, case_id, side, z + dz as z, y + dy as y, x + dx as x, count(*) as n
            from {pairs}, (select unnest([0,1]) as dz) a, (select unnest([0,1]) as dy) b, (select unnest([0,1]) as dx) c
            group by 1, 2, 3, 4, 5, 6"""),
        ("rim", "select k, case_id, side, z, y, x from corner where n < 8"),
        ("cross7", "select * from (values (0,0,0), (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)) t(dz, dy, dx)"),
        ("seek", """select k, case_id, side, case side when 'p' then 'r' else 'p' end as other, z, y, x,
            z + dz as nz, y + dy as ny, x + dx as nx from rim cross join cross7"""),
        ("matched", """select distinct a.k, a.case_id, a.side, a.z, a.y, a.x from seek a
            join rim b on b.k = a.k and b.case_id = a.case_id and b.side = a.other and b.z = a.nz and b.y = a.ny and b.x = a.nx"""),
        ("nsd", """select r.k, r.case_id, coalesce(m.n, 0) * 1.0e0 / r.n as nsd
            from (select k, case_id, count(*) as n from rim group by 1, 2) r
            left join (select k, case_id, count(*) as n from matched group by 1, 2) m on m.k = r.k and m.case_id = r.case_id"""),
    ]


# the whole grid in plain SQL: threshold masks and the reference mask (k = -1) labelled together
PCT = [round(t * 100) for t in GRID_THRESHOLDS]
THRESHOLDS = ("thr", "select * from (values " + ", ".join(f"({k}, {p}, {t!r}e0)" for k, (p, t) in enumerate(zip(PCT, GRID_THRESHOLDS))) + ") t(k, pct, threshold)")
SIZES = ("sizes", "select unnest([" + ", ".join(map(str, GRID_MIN_VOXELS)) + "]) as m")
GRID_CTES = [
    V, THRESHOLDS, SIZES,
    ("mask", """select k, case_id, z, y, x from voxels, thr where pct_et > pct
        union all select -1, case_id, z, y, x from voxels where ref_lab = 3"""),
    *component_ctes("mask"),
    ("size", "select k, case_id, comp, count(*) as size from comp group by 1, 2, 3"),
    ("cases", "select distinct case_id, fold from voxels"),
    ("cell", "select case_id, fold, k, threshold, m from cases, thr, sizes"),
    ("kept", """select c.k, s.m, c.case_id, c.id from comp c join size z on z.k = c.k and z.case_id = c.case_id and z.comp = c.comp
        cross join sizes s where c.k >= 0 and z.size >= s.m"""),
    ("pos", f"select *, {code()} as id from voxels"),
    ("scored", """select e.k, e.m, v.case_id, v.ref_lab,
          case when q.id is not null then 3 when v.pct_tc > 50 then 1 when v.pct_wt > 50 then 2 else 0 end as pred_lab
        from pos v cross join (select k, m from thr, sizes) e
        left join kept q on q.k = e.k and q.m = e.m and q.case_id = v.case_id and q.id = v.id"""),
    ("dsc", "select k, m, case_id, " + ", ".join(
        f"2.0e0 * sum(case when {_in('pred_lab', r)} and {_in('ref_lab', r)} then 1 else 0 end) / "
        f"nullif(sum(case when {_in('pred_lab', r)} then 1 else 0 end) + sum(case when {_in('ref_lab', r)} then 1 else 0 end), 0) as dsc_{r}"
        for r in REGIONS) + " from scored group by 1, 2, 3"),
    ("touch", """select distinct p.k, p.case_id, p.comp as pcomp, r.comp as rcomp from comp p
        join comp r on r.k = -1 and r.case_id = p.case_id and r.id = p.id where p.k >= 0"""),
    ("hits", """select t.k, s.m, t.case_id, count(distinct t.rcomp) as tp, count(distinct t.pcomp) as touched
        from touch t join size z on z.k = t.k and z.case_id = t.case_id and z.comp = t.pcomp
        cross join sizes s where z.size >= s.m group by 1, 2, 3"""),
    ("preds", "select z.k, s.m, z.case_id, count(*) as n from size z cross join sizes s where z.k >= 0 and z.size >= s.m group by 1, 2, 3"),
    ("refs", "select case_id, count(*) as n from size where k = -1 group by 1"),
    ("grid", """select c.case_id, c.fold, c.threshold, c.m as min_voxels, d.dsc_et, d.dsc_tc, d.dsc_wt,
          coalesce(h.tp, 0) as tp_et, coalesce(p.n, 0) - coalesce(h.touched, 0) as fp_et, coalesce(r.n, 0) - coalesce(h.tp, 0) as fn_et
        from cell c join dsc d on d.k = c.k and d.m = c.m and d.case_id = c.case_id
        left join hits h on h.k = c.k and h.m = c.m and h.case_id = c.case_id
        left join preds p on p.k = c.k and p.m = c.m and p.case_id = c.case_id
        left join refs r on r.case_id = c.case_id"""),
]


def _summary_sql(source: str, keys: str) -> str:
    return f"""select {keys}, tp_et, fp_et, fn_et, {', '.join(f'round({c}, 9) as {c}' for c in SUMMARY)},
        round(p, 9) as lesion_precision_et, round(r, 9) as lesion_recall_et,
        round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as lesion_f1_et,
        round(case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) else 0 end, 9) as lesion_f2_et
      from (select *, (mean_dsc_et + mean_dsc_tc + mean_dsc_wt) / 3 as mean_region_dsc,
              case when tp_et + fp_et > 0 then tp_et * 1.0e0 / (tp_et + fp_et) else 1 end as p,
              case when tp_et + fn_et > 0 then tp_et * 1.0e0 / (tp_et + fn_et) else 1 end as r
            from (select {keys}, cast(sum(tp_et) as bigint) as tp_et, cast(sum(fp_et) as bigint) as fp_et,
                         cast(sum(fn_et) as bigint) as fn_et, avg(dsc_et) as mean_dsc_et, avg(dsc_tc) as mean_dsc_tc,
                         avg(dsc_wt) as mean_dsc_wt from {source} group by {keys}) a) b"""


HELD = ("held", "select f.fold as held_out_fold, g.* exclude (fold) from (select distinct fold from grid) f join grid g on g.fold <> f.fold")
PICK = ("pick", """select held_out_fold, threshold, min_voxels, region, et from (
      select *, row_number() over (partition by held_out_fold order by round(region, 12) desc nulls last,
             round(et, 12) desc nulls last, threshold desc, min_voxels desc) as rn
      from (select held_out_fold, threshold, min_voxels, (avg(dsc_et) + avg(dsc_tc) + avg(dsc_wt)) / 3 as region, avg(dsc_et) as et
            from held group by 1, 2, 3) s) t where rn = 1""")
# both operating points per case, with surface agreement
EVAL_CTES = [
    *GRID_CTES, HELD, PICK,
    ("points", """select c.case_id, c.fold, 'baseline' as configuration, 0.5e0 as threshold, 1 as min_voxels from cases c
        union all select c.case_id, c.fold, 'crossfit', p.threshold, p.min_voxels from cases c join pick p on p.held_out_fold = c.fold"""),
    ("chosen", """select p.configuration, v.case_id, v.z, v.y, v.x, v.ref_lab,
          case when q.id is not null then 3 when v.pct_tc > 50 then 1 when v.pct_wt > 50 then 2 else 0 end as pred_lab
        from pos v join points p on p.case_id = v.case_id join thr t on t.threshold = p.threshold
        left join kept q on q.k = t.k and q.m = p.min_voxels and q.case_id = v.case_id and q.id = v.id"""),
    ("sides", " union all ".join(
        f"select configuration || '_{r}' as k, case_id, '{s}' as side, z, y, x from chosen where {_in(lab, r)}"
        for r in REGIONS for s, lab in (("p", "pred_lab"), ("r", "ref_lab")))),
    *_nsd_ctes("sides"),
    ("evaluated", "select p.case_id, p.fold, p.configuration, p.threshold, p.min_voxels, g.dsc_et, g.dsc_tc, g.dsc_wt, "
        + ", ".join(f"n_{r}.nsd as nsd_{r}" for r in REGIONS)
        + " from points p join grid g on g.case_id = p.case_id and g.threshold = p.threshold and g.min_voxels = p.min_voxels"
        + "".join(f" left join nsd n_{r} on n_{r}.case_id = p.case_id and n_{r}.k = p.configuration || '_{r}'" for r in REGIONS)),
]
METRICS = [f"{f}_{r}" for f in ("dsc", "nsd") for r in REGIONS]

MORPH_LONG = ("named", " union all ".join(
    f"select case_id, '{p}{r}' as mask, z, y, x from dec where {_in(lab, r)}"
    for p, lab in (("", "ref_lab"), ("pred_", "pred_lab")) for r in REGIONS))

ORACLES = {
    "region_masks": with_(V) + "select case_id, " + ", ".join(
        f"count(case when {_in('ref_lab', r)} then 1 end) as n_{r}" for r in REGIONS) + " from voxels group by case_id",
    "region_decode": with_(V, DEC) + "select case_id, pred_lab as lab, count(*) as n from dec group by 1, 2",
    "reconstruct_match": with_(V, DEC) + """select case_id, count(case when pred_lab <> export_lab then 1 end) as n_different,
        count(case when pred_lab <> export_lab then 1 end) = 0 as matches from dec group by 1""",
    "voxel_confusion": with_(V, DEC) + " union all ".join(
        f"""select case_id, '{r}' as region, count(case when {_in('pred_lab', r)} and {_in('ref_lab', r)} then 1 end) as tp,
        count(case when {_in('pred_lab', r)} and not {_in('ref_lab', r)} then 1 end) as fp,
        count(case when not {_in('pred_lab', r)} and {_in('ref_lab', r)} then 1 end) as fn from dec group by 1""" for r in REGIONS),
    "dice": with_(V, DEC) + " union all ".join(
        f"""select case_id, '{r}' as region, 2.0e0 * count(case when {_in('pred_lab', r)} and {_in('ref_lab', r)} then 1 end)
        / nullif(count(case when {_in('pred_lab', r)} then 1 end) + count(case when {_in('ref_lab', r)} then 1 end), 0) as dice
        from dec group by 1""" for r in REGIONS),
    "label_domain": with_(V, ("d", "select distinct case_id, ref_lab from voxels")) + """select case_id,
        string_agg(cast(ref_lab as varchar), ',' order by ref_lab) as labels, cast(count(*) as int) as n_labels,
        count(case when ref_lab not in (0, 1, 3) then 1 end) = 0 as valid from d group by 1""",
    "bbox_extent": with_(V, DEC) + """select *, volume * 1.0e0 / (span_z * span_y * span_x) as extent from (
        select case_id, count(*) as volume, min(z) as min_z, max(z) as max_z, min(y) as min_y, max(y) as max_y, min(x) as min_x,
          max(x) as max_x, cast(max(z) - min(z) + 1 as bigint) as span_z, cast(max(y) - min(y) + 1 as bigint) as span_y,
          cast(max(x) - min(x) + 1 as bigint) as span_x from dec where pred_lab = 3 group by 1) b""",
    "centroid": with_(V) + """select case_id, round(avg(z) / 20, 9) as centroid_z, round(avg(y) / 20, 9) as centroid_y,
        round(avg(x) / 20, 9) as centroid_x from voxels where ref_lab in (1, 2, 3) group by 1""",
    "surface_voxels": with_(V, ONE_VOLUME, ("m", _long("vol", "fold")), *_surface_ctes("m", "fold"))
        + "select fold, mask, z, y, x from surf",
    "compactness": with_(V, ONE_VOLUME, ("m", _long("vol", "fold")), *_surface_ctes("m", "fold"))
        + """select fold, mask, volume, surface_voxels, round(surface_voxels / power(volume * 1.0e0, 2.0e0 / 3.0e0), 9) as compactness
        from (select fold, mask, count(*) as volume from m group by 1, 2)
        join (select fold, mask, count(*) as surface_voxels from surf group by 1, 2) using (fold, mask)""",
    "surface_dice": with_(
        V, DEC, ("sides", " union all ".join(
            f"select '{r}' as k, case_id, '{s}' as side, z, y, x from dec where {_in(lab, r)}"
            for r in REGIONS for s, lab in (("p", "pred_lab"), ("r", "ref_lab")))), *_nsd_ctes("sides"))
        + "select case_id, " + ", ".join(f"round(max(case when k = '{r}' then nsd end), 9) as nsd_{r}" for r in REGIONS)
        + " from nsd group by 1",
    "connected_components": with_(V, ("m", "select 0 as k, case_id, z, y, x from voxels"), *component_ctes("m"), recursive=True)
        + "select n.case_id, n.z, n.y, n.x, c.comp from comp c join node n on n.case_id = c.case_id and n.id = c.id",
    "component_stats": with_(
        V, DEC, ("m", " union all ".join(f"select '{r}' as k, case_id, z, y, x from dec where {_in('pred_lab', r)}" for r in REGIONS)),
        *component_ctes("m"), ("size", "select k, case_id, comp, count(*) as size from comp group by 1, 2, 3"), recursive=True)
        + """select case_id, k as mask, count(*) as components, count(case when size >= 10 then 1 end) as components_large,
        cast(sum(size) as bigint) as volume, max(size) * 1.0e0 / sum(size) as largest_fraction from size group by 1, 2""",
    "min_size_filter": with_(
        V, ("m", "select 0 as k, case_id, z, y, x from voxels where pct_et > 50"), *component_ctes("m"), recursive=True)
        + """select n.case_id, n.z, n.y, n.x, c.comp from comp c join node n on n.case_id = c.case_id and n.id = c.id
        join (select case_id, comp from comp group by 1, 2 having count(*) >= 5) s on s.case_id = c.case_id and s.comp = c.comp""",
    "lesion_match": with_(
        V, ("m", """select 'p' as k, case_id, z, y, x from voxels where pct_et > 50
            union all select 'r', case_id, z, y, x from voxels where ref_lab = 3"""), *component_ctes("m"),
        ("touch", """select distinct p.case_id, p.comp as pc, r.comp as rc from comp p
            join comp r on r.case_id = p.case_id and r.id = p.id and r.k = 'r' where p.k = 'p'"""),
        ("n", "select case_id, count(distinct case when k = 'p' then comp end) as np, count(distinct case when k = 'r' then comp end) as nr from comp group by 1"),
        ("t", "select case_id, count(distinct pc) as tp_pred, count(distinct rc) as tp from touch group by 1"), recursive=True)
        + "select case_id, coalesce(tp, 0) as tp, np - coalesce(tp_pred, 0) as fp, nr - coalesce(tp, 0) as fn from n left join t using (case_id)",
    "morphology": with_(
        V, DEC, MORPH_LONG, ("m", "select mask as k, case_id, z, y, x from named"), *component_ctes("m"),
        ("size", "select k as mask, case_id, comp, count(*) as size from comp group by 1, 2, 3"), *[(n.replace("moved", "moved2"), q.replace("from moved a", "from moved2 a")) for n, q in _surface_ctes("named", "case_id")],
        ("every", "select distinct v.case_id, t.mask from voxels v, (select unnest(['et','tc','wt','pred_et','pred_tc','pred_wt']) as mask) t"),
        ("box", """select case_id, mask, count(*) as volume, max(x) - min(x) + 1 as sx, max(y) - min(y) + 1 as sy,
            max(z) - min(z) + 1 as sz, avg(x) as mx, avg(y) as my, avg(z) as mz from named group by 1, 2"""),
        ("stat", "select case_id, mask, count(*) as n, count(case when size >= 10 then 1 end) as n10, max(size) as largest from size group by 1, 2"),
        ("sv", "select case_id, mask, count(*) as surface from surf group by 1, 2"), recursive=True)
        + """select case_id, mask, coalesce(volume, 0) * 1.0e0 as volume, coalesce(n, 0) * 1.0e0 as components,
        coalesce(n10, 0) * 1.0e0 as components_10, coalesce(surface, 0) * 1.0e0 as surface_voxels,
        coalesce(round(sx / 20.0e0, 12), 0) as span_x, coalesce(round(sy / 20.0e0, 12), 0) as span_y, coalesce(round(sz / 20.0e0, 12), 0) as span_z,
        round(largest * 1.0e0 / volume, 12) as largest_fraction, round(surface / power(volume * 1.0e0, 2.0e0 / 3.0e0), 12) as compactness,
        round(volume * 1.0e0 / (sx * sy * sz), 12) as extent, round(mx / 20, 12) as centroid_x, round(my / 20, 12) as centroid_y,
        round(mz / 20, 12) as centroid_z
        from every left join box using (case_id, mask) left join stat using (case_id, mask) left join sv using (case_id, mask)""",
    "grid_cross": with_(V, THRESHOLDS, SIZES) + """select threshold, m as min_voxels, n as n_voxels
        from (select threshold, count(*) as n from voxels join thr on pct_et > pct group by 1) t cross join sizes""",
    "grid_per_case": with_(*GRID_CTES, recursive=True) + "select * from grid",
    "grid_summary": with_(*GRID_CTES, recursive=True) + _summary_sql("grid", "threshold, min_voxels"),
    "lofo_summary": with_(*GRID_CTES, HELD, recursive=True) + _summary_sql("held", "held_out_fold, threshold, min_voxels"),
    "crossfit_select": with_(*GRID_CTES, HELD, PICK, recursive=True) + """select held_out_fold, threshold, min_voxels,
        round(region, 9) as calibration_mean_region_dsc, round(et, 9) as calibration_mean_dsc_et from pick""",
    "apply_selection": with_(*GRID_CTES, HELD, PICK, recursive=True) + """select g.* from grid g
        join pick p on p.held_out_fold = g.fold and p.threshold = g.threshold and p.min_voxels = g.min_voxels""",
    "topk_grid": with_(*GRID_CTES, recursive=True) + """select threshold, min_voxels,
        round((avg(dsc_et) + avg(dsc_tc) + avg(dsc_wt)) / 3, 9) as mean_region_dsc from grid group by 1, 2
        order by 3 desc nulls last, 1 desc, 2 desc limit 10""",
    "fold_counts": with_(V) + "select fold, count(distinct case_id) as n_cases from voxels group by 1",
    "regression_gate": with_(V, DEC, ("d", """select case_id, 2.0e0 * count(case when pred_lab in (1, 3) and ref_lab in (1, 3) then 1 end)
        / nullif(count(case when pred_lab in (1, 3) then 1 end) + count(case when ref_lab in (1, 3) then 1 end), 0) as dice from dec group by 1"""))
        + "select 'tc' as region, round(avg(dice) + 1e-3, 9) as expected, round(avg(dice), 9) as observed from d",
    "crossfit_per_case": with_(*EVAL_CTES, recursive=True) + "select case_id, fold, configuration, threshold, min_voxels, "
        + ", ".join(f"round({c}, 9) as {c}" for c in METRICS) + " from evaluated",
    "paired_effects": with_(
        *EVAL_CTES,
        ("sides2", " union all ".join(
            f"select '{c}' as metric, case_id, max(case when configuration = 'crossfit' then {c} end) as l, "
            f"max(case when configuration = 'baseline' then {c} end) as r from evaluated group by case_id" for c in METRICS)),
        ("diffs", "select metric, case_id, l - r as d from sides2 where l - r is not null"),
        *bootstrap_ctes("diffs", ["metric"], ["d"], "case_id", REPLICATES), recursive=True)
        + f"""select s.*, c.ci_low, c.ci_high, n_dropped_left, n_dropped_right from (
          select metric, count(l - r) as n, round(avg(case when l - r is not null then r end), 9) as baseline_mean,
            round(avg(case when l - r is not null then l end), 9) as crossfit_mean, round(avg(l - r), 9) as mean_difference
          from sides2 group by 1) s
        join (select metric, count(case when l is null and r is not null then 1 end) as n_dropped_left,
                     count(case when r is null and l is not null then 1 end) as n_dropped_right from sides2 group by 1) x using (metric)
        left join (select metric, {interval('mean_d')} from rep group by 1) c using (metric)""",
    "ensemble_mean": with_(fx("members")) + "select case_id, z, y, x, " + ", ".join(
        f"round(sum(cast({p} as double) * 1.0e0) / 7.0e0, 6) as {p}" for p in ensemble.PROBABILITIES)
        + " from members group by 1, 2, 3, 4",
    "tta_mean": with_(fx("members"), ("back", """select case_id, case when member in (4, 6, 7) then 19 - z else z end as z,
        case when member in (3, 5, 7) then 19 - y else y end as y, case when member in (2, 5, 6) then 19 - x else x end as x,
        p_wt, p_tc, p_et from members""")) + "select case_id, z, y, x, " + ", ".join(
        f"round(sum(cast({p} as double)) / 7.0e0, 6) as {p}" for p in ensemble.PROBABILITIES) + " from back group by 1, 2, 3, 4",
    "masked_zscore": with_(fx("image"), ("s", "select case_id, channel, avg(intensity) as a, stddev_pop(intensity) as sd from image where inside = 1 group by 1, 2"))
        + """select i.case_id, i.channel, z, y, x, round(case when inside = 1 then (intensity - a) / greatest(sd, 1e-8) else 0 end, 6) as z_score
        from image i left join s on s.case_id = i.case_id and s.channel = i.channel""",
    "intensity_fingerprint": with_(fx("image")) + """select channel, count(*) as n, round(min(intensity), 6) as v_min,
        round(max(intensity), 6) as v_max, round(avg(intensity), 6) as v_mean, round(stddev_pop(intensity), 6) as v_std,
        round(quantile_cont(intensity, 0.005), 6) as v_percentile_00_5, round(quantile_cont(intensity, 0.5), 6) as v_median,
        round(quantile_cont(intensity, 0.995), 6) as v_percentile_99_5 from image where inside = 1 group by 1""",
    "median_geometry": with_(V, ("b", """select case_id, max(z) - min(z) + 1 as dz, max(y) - min(y) + 1 as dy, max(x) - min(x) + 1 as dx,
        count(*) / 100.0e0 as s from voxels group by 1""")) + """select quantile_cont(cast(dz as double), 0.5) as median_dim_z,
        quantile_cont(cast(dy as double), 0.5) as median_dim_y, quantile_cont(cast(dx as double), 0.5) as median_dim_x,
        quantile_cont(s, 0.5) as median_spacing from b""",
}

# the same results whatever the tile
ORACLES |= {f"{name}_tiles": ORACLES[name] for name in ("connected_components", "lesion_match", "morphology", "grid_per_case", "surface_dice")}
