"""Whole analyses on small volumes and tables: they run, write, refuse to overwrite and agree with each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lesionlens.functions.fixed import METRIC_FAMILIES, REGIONS
from lesionlens.operators.voxels import decode_regions, dice
from lesionlens.plans import analyses
from test_voxels import SHAPE, voxel_frame, volumes


@pytest.fixture(scope="module")
def vox(spark):
    return voxel_frame(spark, volumes(24, seed=9)).withColumn("pred_lab", decode_regions()).withColumn("export_lab", F.col("pred_lab")).cache()


def test_threshold_sweep(spark, vox, tmp_path):
    means = {r["region"]: r["m"] for r in dice(vox, ["case_id"]).groupBy("region").agg(F.avg("dice").alias("m")).collect()}
    out = analyses.threshold_sweep(vox, str(tmp_path / "a"), expected=means, thresholds=(0.3, 0.5), min_voxels=(1, 4), replicates=30)
    n = vox.select("case_id").distinct().count()
    assert out["grid_per_case"].count() == 4 * n and out["crossfit_per_case"].count() == 2 * n
    assert {r["metric"] for r in out["paired_effects"].collect()} == {f"{f}_{r}" for f in ("dsc", "nsd") for r in REGIONS}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        analyses.threshold_sweep(vox, str(tmp_path / "a"), thresholds=(0.5,), min_voxels=(1,), replicates=5)
    with pytest.raises(ValueError, match="differ"):
        analyses.threshold_sweep(vox.withColumn("export_lab", F.lit(1)), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="off"):
        analyses.threshold_sweep(vox, str(tmp_path / "c"), expected={"et": 0.5}, thresholds=(0.5,), min_voxels=(1,))


def test_failure_atlas(spark, vox, tmp_path):
    d = dice(vox, ["case_id"]).groupBy("case_id").pivot("region", ["wt", "tc", "et"]).agg(F.first("dice"))
    metrics = d.select("case_id", (F.col("case_id") % 3).cast("int").alias("fold"), *[F.col(r).alias(f"{r}_dice") for r in ("wt", "tc", "et")])
    shapes = d.select("case_id", *[F.lit(s).alias(f"dim_{a}") for a, s in zip("zyx", SHAPE)])
    groups = d.where("case_id % 5 <> 0").select("case_id", F.when(F.col("case_id") % 2 == 0, "GLI").otherwise("odd").alias("group_code"))
    features = analyses.case_features(metrics, vox, shapes, groups)
    out = analyses.failure_atlas(features, str(tmp_path / "atlas"), replicates=20)
    assert out["spearman"].count() == 21 * 4 and out["failure_sensitivity"].count() == 21 * 3
    assert out["partial_intervals"].count() == 4 and out["pca_explained"].count() == 10
    assert {r["header_domain"] for r in out["domain_summary"].collect()} == {"Domain A (q1/s0)", "Unknown domain"}
    assert out["failure_effects"].where("p_fdr < p_value").isEmpty()
    assert out["strongest_spearman"].count() == 12 and out["strongest_effects"].count() == 12
    cases = out["case_features"].count()
    assert out["failure_counts"].first()["cases"] == cases
    assert out["volume_failure_rate"].agg(F.sum("count")).first()[0] == out["case_features"].where("failure_eligible").count()
    assert {"failure_et_lt_05", "failure_wt_lt_08"} <= set(out["case_features"].columns)
    document = spark.read.json(str(tmp_path / "atlas" / "partial_intervals_document")).first()
    assert len(document["estimates"]) == 4 and document["bootstrap"]["replicates"] == 20
    assert spark.read.json(str(tmp_path / "atlas" / "settings")).first()["analysis"] == "failure_atlas"


def test_validation_scores(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for c in ("f1_notta", "f1_tta", "f5_notta", "f5_tta", "resenc_f5_tta"):
        t = pd.DataFrame(rng.random((40, 12)), columns=[f"{f}_{r}" for f in METRIC_FAMILIES for r in REGIONS])
        rows.append(t.assign(config=c, subject_id=[f"s{i}" for i in range(40)]))
    table = spark.createDataFrame(pd.concat(rows))
    source = spark.createDataFrame(pd.DataFrame(rng.random((30, 3)), columns=["et_dice", "tc_dice", "wt_dice"]).assign(subject_id=[f"o{i}" for i in range(30)]))
    out = analyses.validation_scores(table, source, str(tmp_path / "v"), replicates=40)
    assert out["paired_comparisons"].count() == 60 and out["aggregate_scores"].count() == 60
    assert {r["region"] for r in out["source_target_gap"].collect()} == {"ET", "TC", "WT", "MEAN"}
    with pytest.raises(ValueError, match="align"):
        analyses.validation_scores(table.where("not (config = 'f5_tta' and subject_id = 's3')"), source, str(tmp_path / "w"))
