import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from lesionlens.functions.fixed import REGION_LABELS
from lesionlens.functions.scalars import case_id, float_gt, norm_missing
from lesionlens.operators.grid import evaluate_points, grid_per_case, grid_summary, lofo_summary, select_operating_points
from lesionlens.operators.morphology import case_morphology
from lesionlens.operators.surface import surface_dice
from lesionlens.operators.voxels import (
    align_voxels, confusion, decode_regions, dice, reconstruct_match, surface_voxels,
)

SHAPE = (9, 8, 10)
REGIONS = ("et", "tc", "wt")


def volumes(n=6, seed=5):
    """case -> (reference labels, probabilities by channel); the last one is empty on both sides."""
    rng = np.random.default_rng(seed)
    out = {}
    for c in range(n):
        blob = rng.random(SHAPE) < 0.2
        blob[2:6, 2:6, 1:8] |= rng.random((4, 4, 7)) < 0.7
        ref = np.where(blob, rng.integers(1, 4, SHAPE), 0)
        near = np.where(ref > 0, rng.random(SHAPE) < 0.8, rng.random(SHAPE) < 0.05)
        p = np.where(near[None], rng.integers(10, 100, (3, *SHAPE)), 0) / 100
        out[c] = (ref, p.astype("float32"))
    out[n] = (np.zeros(SHAPE, int), np.zeros((3, *SHAPE), "float32"))
    return out


def voxel_frame(spark, vols):
    parts = []
    for c, (ref, p) in vols.items():
        at = np.argwhere((ref > 0) | (p > 0).any(axis=0))
        z, y, x = at.T
        parts.append(pd.DataFrame({
            "case_id": c, "fold": c % 3, "z": z, "y": y, "x": x, "p_wt": p[0, z, y, x], "p_tc": p[1, z, y, x],
            "p_et": p[2, z, y, x], "ref_lab": ref[z, y, x],
        }))
    schema = "case_id long, fold int, z int, y int, x int, p_wt float, p_tc float, p_et float, ref_lab byte"
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=2), schema)


def decode(p, et):
    seg = np.zeros(SHAPE, int)
    seg[p[0] > np.float32(0.5)] = 2
    seg[p[1] > np.float32(0.5)] = 1
    seg[et] = 3
    return seg


def et_mask(p, t, m):
    mask = p[2] > np.float32(t)
    for part in brute.components(mask):
        if len(part) < m:
            for v in part:
                mask[v] = False
    return mask


def region(lab, r):
    return np.isin(lab, REGION_LABELS[r])


@pytest.fixture(scope="module")
def vols():
    return volumes()


@pytest.fixture(scope="module")
def vox(spark, vols):
    return voxel_frame(spark, vols).cache()


@pytest.fixture(scope="module")
def cases(spark, vols):
    return spark.createDataFrame([(c, c % 3) for c in vols], "case_id long, fold int")


def test_dice_and_confusion(vox, vols):
    df = vox.withColumn("pred_lab", decode_regions())
    got = {(r["case_id"], r["region"]): r["dice"] for r in dice(df, ["case_id"]).collect()}
    counts = {(r["case_id"], r["region"]): r for r in confusion(df, ["case_id"]).collect()}
    for c, (ref, p) in vols.items():
        seg = decode(p, p[2] > np.float32(0.5))
        for r in REGIONS:
            a, b = region(seg, r), region(ref, r)
            if not (a.any() or b.any()):
                assert got.get((c, r)) is None
                continue
            assert got[c, r] == pytest.approx(brute.dice(a, b))
            assert counts[c, r]["fp"] == (a & ~b).sum() and counts[c, r]["fn"] == (~a & b).sum()


def test_one_side_empty_scores_zero(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 0, 0)], "case_id int, pred_lab int, ref_lab int")
    got = {(r["case_id"], r["region"]): r["dice"] for r in dice(rows, ["case_id"]).collect()}
    assert got[1, "et"] == 0.0 and got[2, "wt"] is None


def test_alignment_and_reconstruction(spark):
    schema = "case_id int, z int, y int, x int, lab byte"
    a = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 0, 1, 3), (2, 5, 5, 5, 1)], schema)
    b = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 0, 0, 2, 3), (2, 5, 5, 5, 1)], schema)
    got = {r["case_id"]: (r["n_different"], r["matches"]) for r in reconstruct_match(a, b, ["case_id"]).collect()}
    assert got == {1: (2, False), 2: (0, True)}
    assert align_voxels(a, b, ["case_id"]).count() == 4


@pytest.mark.parametrize("tile", [1, 3])
def test_erosion_is_the_same_in_any_cubes(vox, tile):
    from lesionlens.operators.voxels import erode_bits

    df = vox.withColumn("case_id", F.when(F.col("case_id") > 1, F.col("case_id"))).withColumn("x", F.col("x") - 3).withColumn("m", F.lit(3))
    df = df.where("case_id is not null or x > 0")
    key = ["case_id", "z", "y", "x"]
    got, want = (sorted(map(str, erode_bits(df, ["case_id"], "m", tile=t).select(*key, "interior").collect())) for t in (tile, 64))
    assert got == want and len(want) == df.count() and any("interior=3" in r for r in want)


def test_surface_voxels_are_mask_minus_erosion(vox, vols):
    got = surface_voxels(vox, ["case_id"], {r: F.col("ref_lab").isin(*REGION_LABELS[r]) for r in REGIONS}).toPandas()
    for c, (ref, _) in vols.items():
        for r in REGIONS:
            m = region(ref, r)
            want = set(map(tuple, np.argwhere(m & ~brute.interior(m))))
            rows = got[(got.case_id == c) & (got["mask"] == r)]
            assert set(zip(rows.z, rows.y, rows.x)) == want and len(rows) == len(want)


def test_solid_block_has_interior(spark):
    rows = [(1, z, y, x) for z in range(5) for y in range(6) for x in range(4)]
    df = spark.createDataFrame(rows, "case_id int, z int, y int, x int")
    assert surface_voxels(df, ["case_id"], {"m": F.lit(True)}).count() == 5 * 6 * 4 - 3 * 4 * 2


@pytest.mark.parametrize("tolerance", [1.0, 2.0])
def test_surface_dice(vox, vols, cases, tolerance):
    df = vox.withColumn("pred_lab", decode_regions())
    pairs = {r: (F.col("pred_lab").isin(*REGION_LABELS[r]), F.col("ref_lab").isin(*REGION_LABELS[r])) for r in REGIONS}
    got = {x["case_id"]: x for x in surface_dice(df, ["case_id"], pairs, tolerance, cases=cases).collect()}
    for tile in (1, 4):  # volumes that many cubes share, and NULL as the name of one
        named = df.withColumn("case_id", F.when(F.col("case_id") > 1, F.col("case_id")))
        cut = {x["case_id"]: x for x in surface_dice(named, ["case_id"], pairs, tolerance, tile=tile).collect()}
        assert all(cut[c][r] == (None if got[c][r] is None else pytest.approx(got[c][r])) for c in cut if c is not None for r in REGIONS) and len(cut) > 2
    for c, (ref, p) in vols.items():
        seg = decode(p, p[2] > np.float32(0.5))
        for r in REGIONS:
            want = brute.surface_dice(region(seg, r), region(ref, r), tolerance)
            assert got[c][r] == (want if want is None else pytest.approx(want))


def test_surface_dice_weights(spark, vox):
    df = vox.withColumn("pred_lab", decode_regions())
    pairs = {"wt": (F.col("pred_lab") > 0, F.col("ref_lab") > 0)}
    plain = {x["case_id"]: x["wt"] for x in surface_dice(df, ["case_id"], pairs).collect()}
    same = spark.range(256).selectExpr("cast(id as int) as code", "2.5D as weight")
    got = {x["case_id"]: x["wt"] for x in surface_dice(df, ["case_id"], pairs, weights=same).collect()}
    assert got == pytest.approx(plain)
    # weight only corners with exactly one voxel: both sides counted by hand
    ones = spark.createDataFrame([(1 << k, 1.0) for k in range(8)], "code int, weight double")
    block = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], "case_id int, z int, y int, x int")
    pair = {"m": (F.lit(True), F.col("x") == 0)}
    # prediction: 8 of 12 corners have one voxel; reference: all 8; 4 + 8 of the 16 are matched at 0 mm... all at 1 mm
    assert surface_dice(block, ["case_id"], pair, 1.0, weights=ones).first()["m"] == pytest.approx(1.0)
    assert surface_dice(block, ["case_id"], pair, 0.5, weights=ones).first()["m"] == pytest.approx((4 + 8) / 16)


@pytest.mark.parametrize("tile", [64, 4])
def test_morphology(spark, vox, vols, cases, tile):
    shapes = cases.select("case_id", *[F.lit(d).alias(f"dim_{a}") for a, d in zip("zyx", SHAPE)])
    df = vox.withColumn("pred_lab", decode_regions())
    got = case_morphology(df, ["case_id"], shapes, tile=tile).toPandas().set_index("case_id")
    for c, (ref, p) in vols.items():
        for prefix, lab in (("", ref), ("pred_", decode(p, p[2] > np.float32(0.5)))):
            for r in REGIONS:
                m, k = region(lab, r), f"{prefix}{r}"
                row = got.loc[c]
                parts = brute.components(m)
                assert row[f"{k}_volume"] == m.sum() and row[f"{k}_components"] == len(parts)
                assert row[f"{k}_components_10"] == sum(len(q) >= 10 for q in parts)
                if not m.any():
                    assert row[f"{k}_span_z"] == 0 and np.isnan(row[f"{k}_extent"]) and row[f"{k}_surface_voxels"] == 0
                    continue
                at = np.argwhere(m)
                span = at.max(axis=0) - at.min(axis=0) + 1
                surf = (m & ~brute.interior(m)).sum()
                assert row[f"{k}_surface_voxels"] == surf
                assert row[f"{k}_compactness"] == pytest.approx(surf / m.sum() ** (2 / 3))
                assert row[f"{k}_extent"] == pytest.approx(m.sum() / span.prod())
                assert row[f"{k}_largest_fraction"] == pytest.approx(max(map(len, parts)) / m.sum())
                for i, a in enumerate("zyx"):
                    assert row[f"{k}_span_{a}"] == pytest.approx(span[i] / SHAPE[i])
                    assert row[f"{k}_centroid_{a}"] == pytest.approx(at.mean(axis=0)[i] / SHAPE[i])
        wt, pwt = (ref > 0).sum(), (decode(p, p[2] > np.float32(0.5)) > 0).sum()
        if wt:
            assert got.loc[c, "wt_volume_bias"] == pytest.approx((pwt - wt) / wt)
        else:
            assert np.isnan(got.loc[c, "wt_volume_bias"])


GRID = ((0.2, 0.5, 0.6), (1, 3, 8))


@pytest.fixture(scope="module", params=[64, 3])
def grid(request, vox, cases):
    return grid_per_case(vox, ["case_id", "fold"], *GRID, cases=cases, tile=request.param).toPandas()


def test_grid_per_case(grid, vols):
    assert len(grid) == len(vols) * 9
    for row in grid.itertuples():
        ref, p = vols[row.case_id]
        mask = et_mask(p, row.threshold, row.min_voxels)
        seg = decode(p, mask)
        for r in REGIONS:
            want = brute.dice(region(seg, r), region(ref, r))
            got = getattr(row, f"dsc_{r}")
            assert np.isnan(got) if want is None else got == pytest.approx(want)
        assert (row.tp_et, row.fp_et, row.fn_et) == brute.lesions(mask, region(ref, "et"))


def test_grid_summary_and_selection(spark, grid):
    df = spark.createDataFrame(grid)
    plain = grid_summary(df).toPandas().set_index(["threshold", "min_voxels"]).sort_index()
    want = grid.groupby(["threshold", "min_voxels"])[["dsc_et", "dsc_tc", "dsc_wt"]].mean()
    assert np.allclose(plain[["mean_dsc_et", "mean_dsc_tc", "mean_dsc_wt"]], want)
    assert np.allclose(plain.mean_region_dsc, want.mean(axis=1))
    chosen = select_operating_points(df).toPandas().set_index("held_out_fold")
    lofo = lofo_summary(df).toPandas()
    for f in range(3):
        rest = grid[grid.fold != f]
        direct = grid_summary(spark.createDataFrame(rest)).toPandas()
        mine = lofo[lofo.held_out_fold == f].drop(columns="held_out_fold")
        both = direct.merge(mine, on=["threshold", "min_voxels"])
        for c in direct.columns[2:]:
            assert np.allclose(both[f"{c}_x"], both[f"{c}_y"])
        best = direct.round(12).sort_values(["mean_region_dsc", "mean_dsc_et", "threshold", "min_voxels"]).iloc[-1]
        assert (chosen.loc[f, "threshold"], chosen.loc[f, "min_voxels"]) == (best.threshold, best.min_voxels)


def test_zero_rules_of_lesion_scores(spark):
    rows = [(1, 0.5, 1, None, None, None, 0, 0, 0), (1, 0.6, 1, 0.5, 0.5, 0.5, 0, 2, 3)]
    schema = "fold int, threshold double, min_voxels int, dsc_et double, dsc_tc double, dsc_wt double, tp_et int, fp_et int, fn_et int"
    got = {r["threshold"]: r for r in grid_summary(spark.createDataFrame(rows, schema)).collect()}
    assert got[0.5]["lesion_precision_et"] == 1.0 and got[0.5]["lesion_f1_et"] == 1.0 and got[0.5]["mean_region_dsc"] is None
    assert got[0.6]["lesion_precision_et"] == 0.0 and got[0.6]["lesion_f1_et"] == 0.0 and got[0.6]["lesion_f2_et"] == 0.0


@pytest.mark.parametrize("tile", [64, 4])
def test_evaluate_points(spark, vox, vols, cases, tile):
    points = {0: (0.2, 3), 1: (0.6, 1), 2: (0.5, 8)}
    pts = spark.createDataFrame([(f, *p) for f, p in points.items()], "held_out_fold int, threshold double, min_voxels int")
    got = evaluate_points(vox, ["case_id", "fold"], pts, cases=cases, tile=tile).toPandas()
    assert len(got) == 2 * len(vols)
    for row in got.itertuples():
        ref, p = vols[row.case_id]
        t, m = (0.5, 1) if row.configuration == "baseline" else points[row.fold]
        seg = decode(p, et_mask(p, t, m))
        for r in REGIONS:
            a, b = region(seg, r), region(ref, r)
            for got_v, want in ((getattr(row, f"dsc_{r}"), brute.dice(a, b)), (getattr(row, f"nsd_{r}"), brute.surface_dice(a, b, 1.0))):
                assert np.isnan(got_v) if want is None else got_v == pytest.approx(want)


def test_threshold_in_single_precision(spark):
    row = spark.sql("select cast(0.2 as float) as p, double('NaN') as n, double('-Infinity') as i").select(
        float_gt("p", 0.2).alias("gt"), norm_missing("n").alias("n"), norm_missing("i").alias("i")
    ).first()
    assert (row["gt"], row["n"], row["i"]) == (False, None, None)


def test_case_id(spark):
    df = spark.createDataFrame([("/a/b/c-1.nii.gz",), ("x.npz",), (".hidden",), ("plain",)], "p string")
    assert [r[0] for r in df.select(case_id("p")).collect()] == ["c-1", "x", ".hidden", "plain"]
