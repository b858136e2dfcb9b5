import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import components as flood, lesions
from lesionlens.operators.components import (
    component_stats, connected_components, contract, label_fragments, lesion_match, min_size_filter,
)


def volume(seed, shape=(13, 11, 17), density=0.14):
    rng = np.random.default_rng(seed)
    mask = rng.random(shape) < density
    mask[3:9, 4, 2:16] |= rng.random((6, 14)) < 0.5  # one large body over several tiles
    return mask


def frame(spark, masks):
    parts = []
    for case, mask in masks.items():
        parts.append(pd.DataFrame(np.argwhere(mask), columns=["z", "y", "x"]).assign(case_id=case))
    pdf = pd.concat(parts).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf.astype({"z": "int32", "y": "int32", "x": "int32"}), "z int, y int, x int, case_id string")


def code(v):
    return (int(v[0]) << 40) | (int(v[1]) << 20) | int(v[2])


@pytest.mark.parametrize("tile", [64, 4, 2])
def test_components_match_flood_fill(spark, tile):
    masks = {f"c{i}": volume(i) for i in range(4)}
    masks["diag"] = np.zeros((9, 9, 9), bool)
    for i in range(9):
        masks["diag"][i, i, i] = True  # contact by corners only
    got = connected_components(frame(spark, masks), ["case_id"], tile=tile).toPandas()
    for case, mask in masks.items():
        want = {v: min(map(code, part)) for part in flood(mask) for v in part}
        rows = got[got.case_id == case]
        assert len(rows) == mask.sum()
        assert {(r.z, r.y, r.x): r.comp for r in rows.itertuples()} == {tuple(map(int, k)): v for k, v in want.items()}


@pytest.mark.parametrize("tile", [64, 4])
def test_piece_sizes_come_with_their_first_voxel(spark, tile):
    vox = frame(spark, {"a": volume(1), "b": volume(2)}).withColumn("_m", F.when(F.col("x") % 3 == 0, 2).otherwise(3))
    got = label_fragments(vox, ["case_id"], "_m", 2, tile=tile, sizes=True).voxels
    pieces = got.select("case_id", F.posexplode(F.arrays_zip("frag", "sizes")).alias("mask", "p")).select("case_id", "mask", "p.frag", "p.sizes").where("frag >= 0")
    whole = pieces.groupBy("case_id", "mask", "frag").agg(F.count(F.lit(1)).alias("n"), F.sum("sizes").alias("s"), F.count_if(F.col("sizes") > 0).alias("k")).toPandas()
    assert len(whole) > 10 and (whole.n == whole.s).all() and (whole.k == 1).all()


def test_long_snake_over_many_tiles(spark):
    mask = np.zeros((3, 24, 24), bool)
    for y in range(0, 24, 2):
        mask[1, y, :] = True
        if y + 1 < 24:
            mask[1, y + 1, 23 if (y // 2) % 2 == 0 else 0] = True
    got = connected_components(frame(spark, {"s": mask}), ["case_id"], tile=3)
    assert got.select("comp").distinct().count() == 1


def test_graphs_solved_whole_or_by_stars_are_the_same(spark):
    rng = np.random.default_rng(5)
    rows = [(g, *map(int, (max(a, b), min(a, b)))) for g, n in (("a", 60), ("b", 400)) for a, b in rng.integers(0, 200, (n, 2)) if a != b]
    edges = spark.createDataFrame(rows + rows[:5], "g string, u long, v long").cache()
    got = [sorted(map(tuple, contract(edges, ["g"], local_edges=n).collect())) for n in (1000, 100, 0)]
    assert got[0] and got[0] == got[1] == got[2]


def test_pieces_are_never_broadcast(spark):
    got = connected_components(frame(spark, {"c": volume(1)}), ["case_id"], tile=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # repeated ids pack so well that files of many rows look small


def test_stats_filter_and_matching(spark):
    pred, ref = {}, {}
    for i in range(5):
        pred[f"c{i}"], ref[f"c{i}"] = volume(i, density=0.05), volume(i + 50, density=0.04)
    pred["none"], ref["some"] = np.zeros((4, 4, 4), bool), volume(99)
    cases = spark.createDataFrame([(c,) for c in {*pred, *ref}], "case_id string")
    p = connected_components(frame(spark, pred), ["case_id"], tile=5)
    r = connected_components(frame(spark, ref), ["case_id"], tile=5)
    stats = {x["case_id"]: x for x in component_stats(p, ["case_id"], 10, cases).collect()}
    match = {x["case_id"]: (x["tp"], x["fp"], x["fn"]) for x in lesion_match(p, r, ["case_id"], cases).collect()}
    kept = min_size_filter(p, ["case_id"], 5).groupBy("case_id").count().toPandas().set_index("case_id")["count"]
    empty = np.zeros((4, 4, 4), bool)
    for c in {*pred, *ref}:
        a = pred.get(c, empty)
        b = ref.get(c, np.zeros(a.shape, bool))
        a = a if a.shape == b.shape else np.zeros(b.shape, bool)
        parts = flood(a)
        assert stats[c]["components"] == len(parts)
        assert stats[c]["components_large"] == sum(len(q) >= 10 for q in parts)
        if parts:
            assert stats[c]["largest_fraction"] == pytest.approx(max(map(len, parts)) / a.sum())
        else:
            assert stats[c]["largest_fraction"] is None
        assert match[c] == lesions(a, b)
        assert kept.get(c, 0) == sum(len(q) for q in parts if len(q) >= 5)


def test_several_masks_in_one_pass(spark):
    mask = volume(7)
    df = frame(spark, {"a": mask}).withColumn("p", F.pmod(F.col("z") * 5 + F.col("y") * 3 + F.col("x"), F.lit(10)))
    named = {f"t{t}": F.col("p") > t for t in (1, 4, 7)}
    got = connected_components(df, ["case_id"], named, tile=4)
    for name, cond in named.items():
        alone = connected_components(df.where(cond), ["case_id"], tile=64)
        assert got.where(F.col("mask") == name).drop("mask").exceptAll(alone).isEmpty()
        assert alone.exceptAll(got.where(F.col("mask") == name).drop("mask")).isEmpty()
