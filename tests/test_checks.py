import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lesionlens.functions.scalars import float_gt
from lesionlens.operators import binning, components, ensemble, guards, inventory, lookup as lk, ordered
from lesionlens.plans import analyses
from lesionlens.session import materialize
from lesionlens.sources import readers, writers

EYE = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
SCHEMA = "case_id string, affine array<double>, shape array<int>"


def moved(at, by):
    out = list(EYE)
    out[at] += by
    return out


@pytest.mark.parametrize("affine,shape,atol,reason", [
    (EYE, [5, 6, 7], 0.0, None),
    (EYE, [5, 6, 8], 0.0, "shape"),
    (moved(3, 2.0), [5, 6, 7], 0.0, "affine"),
    (moved(0, 1e-9), [5, 6, 7], 0.0, "affine"),
    (moved(0, 1e-7), [5, 6, 7], 1e-5, None),
    (moved(0, 1e-3), [5, 6, 7], 1e-5, "affine"),
    (EYE[:12], [5, 6, 7], 1e-5, "affine"),
    (moved(0, float("nan")), [5, 6, 7], 1e-5, "affine"),
])
def test_geometry(spark, affine, shape, atol, reason):
    ref = spark.createDataFrame([("c", [float(v) for v in EYE], [5, 6, 7])], SCHEMA)
    out = spark.createDataFrame([("c", [float(v) for v in affine], shape)], SCHEMA)
    assert guards.geometry_matches(ref, out, "case_id", atol).first()["matches"] == (reason is None)
    found = guards.geometry_violations(ref, out, "case_id", atol)
    if reason is None:
        guards.assert_empty(found, "geometry")
    else:
        assert found.first()["reason"] == reason
        with pytest.raises(guards.GuardError, match=reason):
            guards.assert_empty(found, "geometry")


def test_guards(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "case_id string, fold int")
    assert guards.count_guard(df, ["case_id"]).count() == 1
    assert guards.count_guard(df, ["case_id", "fold"], 3).isEmpty()
    assert guards.count_guard(df, ["case_id", "fold"], 4).count() == 1
    assert [r["case_id"] for r in guards.fold_leaks(df, "case_id", "fold").collect()] == ["a"]
    assert [r["case_id"] for r in guards.align_guard(df, "fold", "case_id", 2).collect()] == ["b"]
    split = spark.createDataFrame([("a", 0)], "case_id string, fold int")
    assert {(r["case_id"], r["split_fold"]) for r in guards.fold_mismatch(df, split).collect()} == {("a", 0), ("b", None)}
    both = guards.reconcile(df.select("case_id"), spark.createDataFrame([("b",), ("c",)], "case_id string"), ["case_id"])
    assert {(r[0], r[1]) for r in both.collect()} == {("a", "missing"), ("b", "ok"), ("c", "extra")}
    assert {(r[0], r[1]) for r in guards.reconcile_counts(both).collect()} == {("missing", 1), ("ok", 1), ("extra", 1)}
    labels = spark.createDataFrame([("a", 0), ("a", 3), ("b", 7)], "case_id string, lab int")
    assert {r["case_id"]: (r["labels"], r["valid"]) for r in guards.label_domain(labels, ["case_id"], "lab").collect()} == {
        "a": ([0, 3], True), "b": ([7], False)}


def test_table_digest_ignores_order_but_counts_rows(spark):
    rows = [("x",), ("y",), ("z",)]
    make = lambda r: guards.table_digest(guards.content_digest(spark.createDataFrame(r, "t string"), "t")).first()["digest"]
    assert make(rows) == make(rows[::-1]) != make(rows + [("z",)])


def test_inventory(spark):
    names = ["a-t1n.nii.gz", "dir/a-t1c.nii.gz", "a_0002.nii.gz", "a-t2f.nii.gz", "b_0003.nii.gz", "_0001.nii.gz", "note.nii.gz", "c-t1n.txt", "-t2w.nii.gz"]
    inv = inventory.parse_inventory(spark.createDataFrame([(n,) for n in names], "path string"))
    got = {(r["path"], r["case_id"], r["modality"], r["channel"]) for r in inv.collect()}
    assert got == {
        ("a-t1n.nii.gz", "a", "t1n", "0000"), ("dir/a-t1c.nii.gz", "a", "t1c", "0001"), ("a_0002.nii.gz", "a", "t2f", "0002"),
        ("a-t2f.nii.gz", "a", "t2f", "0002"), ("b_0003.nii.gz", "b", "t2w", "0003"), ("-t2w.nii.gz", "", "t2w", "0003")}
    assert [(r["case_id"], r["modality"]) for r in inventory.duplicate_modalities(inv).collect()] == [("a", "t2f")]
    lacks = {r["case_id"]: r["missing"] for r in inventory.missing_modalities(inv).collect()}
    assert lacks["a"] == ["t2w"] and lacks["b"] == ["t1c", "t1n", "t2f"]
    mapping = inventory.channel_map(inv)
    stale = inventory.stale_files(spark.createDataFrame([("a_0000.nii.gz",), ("old_0000.nii.gz",)], "destination string"), mapping)
    assert [r[0] for r in stale.collect()] == ["old_0000.nii.gz"]


@pytest.mark.parametrize("small", [True, False])
def test_discover_cases(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
    files = spark.createDataFrame([(1, "f1/b.npz"), (0, "f0/c.npz"), (0, "f0/a.npz"), (1, "f1/a.npz")], "fold int, path string")
    labels = spark.createDataFrame([("l/a.nii.gz",), ("l/b.nii.gz",)], "path string")
    exports = spark.createDataFrame([(0, "f0/a.nii.gz"), (0, "f0/c.nii.gz"), (1, "f1/b.nii.gz")], "fold int, path string")
    cases, bad = inventory.discover_cases(files, labels, exports)
    assert [(r["case_index"], r["fold"], r["case_id"]) for r in cases.orderBy("case_index").collect()] == [
        (0, 0, "a"), (1, 0, "c"), (2, 1, "a"), (3, 1, "b")]
    assert {(r[0], r[1]) for r in bad.collect()} == {("several folds", "a"), ("no label", "c"), ("no export", "a")}


def test_files_and_documents(spark, tmp_path):
    for f in (0, 1):
        d = tmp_path / f"fold_{f}" / "validation"
        d.mkdir(parents=True)
        (d / f"c{f}.nii.gz").write_bytes(b"x" * (f + 1))
        (d / "notes.txt").write_text("n")
        metrics = {"(1, 2, 3)": {"Dice": 0.9, "FP": 1, "FN": 2}, "(1, 3)": {"Dice": float("nan"), "FP": 0, "FN": 0}, "(3,)": {"Dice": 0.25 * f, "FP": 3, "FN": 4}}
        item = {"prediction_file": f"/o/c{f}.nii.gz", "reference_file": f"/r/c{f}.nii.gz", "metrics": metrics}
        (d / "summary.json").write_text(json.dumps({"metric_per_case": [item], "mean": {}}, indent=1))
    (tmp_path / "splits.json").write_text(json.dumps([{"train": ["c1"], "val": ["c0"]}, {"train": ["c0"], "val": ["c1"]}], indent=1))
    files = readers.list_files(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["length"]) for r in files) == [("c0.nii.gz", 1), ("c1.nii.gz", 2)]
    rows = {r["case_id"]: r for r in readers.read_summaries(spark, str(tmp_path / "fold_*")).collect()}
    assert (rows["c1"]["fold"], rows["c1"]["et_dice"], rows["c1"]["wt_fn"]) == (1, 0.25, 2.0)
    splits = readers.explode_splits(readers.read_documents(spark, str(tmp_path / "splits.json")), "document")
    assert {(r["fold"], r["case_id"]) for r in splits.collect()} == {(0, "c0"), (1, "c1")}


def test_score_scan_and_sinks(spark, tmp_path):
    cols = [f.name for f in readers.SCORE_SCHEMA.fields]
    lines = ["extra," + ",".join(reversed(cols))]
    for s in ("case-00002-seg.nii.gz", "case-00001-seg.nii.gz", "mean", "xcase-00001-seg.nii.gz"):
        values = {c: "0.5" for c in cols} | {"subject_id": s, "global_dsc_et": "" if s.endswith("2-seg.nii.gz") else "inf"}
        lines.append("z," + ",".join(values[c] for c in reversed(cols)))
    path = tmp_path / "s.csv"
    path.write_text("\n".join(lines) + "\n")
    got = readers.read_scores(spark, str(path), r"^case-\d{5}-seg\.nii\.gz$", 2).collect()
    assert [r["subject_id"][5:10] for r in got] == ["00001", "00002"] and got[1]["global_dsc_et"] is None
    assert got[0]["global_dsc_et"] is None  # infinities are missing on the way in
    with pytest.raises(guards.GuardError):
        readers.read_scores(spark, str(path), r"^case-\d{5}-seg\.nii\.gz$", 3)
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string")
    writers.write_table(df, out, ["id"], "csv", single=True)
    assert [r["id"] for r in spark.read.option("header", True).csv(out).collect()] == ["1", "2"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        writers.write_table(df, out, format="csv")
    assert writers.snapshot(df, str(tmp_path / "snap")).count() == 2
    writers.write_document(df.agg(F.struct(F.count("id").alias("n")).alias("stats")), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first()["stats"]["n"] == 2


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_lookup_broadcasts_no_copies(spark, how):
    left, right = spark.range(100).selectExpr("id % 7 k", "id x"), spark.range(5).selectExpr("id k", "id * 2 v")
    out = lk.lookup(left, right, ["k"], ["x"], how, limit=1)
    assert out.count() == (100 if how == "left" else 72)
    assert "Broadcast" not in out._jdf.queryExecution().toString()


def test_voxel_scan_derives_and_aligns_once(spark, monkeypatch):
    from lesionlens.plans import catalog_files

    stored = []
    monkeypatch.setattr(catalog_files, "materialize", lambda df, name: stored.append(name) or materialize(df, name))
    out = catalog_files.voxel_scan(spark, "/root/testdata/sf0.001")
    assert stored == ["voxels", "cases", "aligned"]
    assert all("/aligned-" in f for f in out.inputFiles()), "the sources were aligned again for each use"


def test_voxel_scan_aligns_sources(spark, tmp_path):
    prob = spark.createDataFrame([("a", 0, 0, 0, 0, 0.9, 0.8, 0.7)], readers.PROBABILITY_SCHEMA)
    lab = spark.createDataFrame([("a", 0, 0, 0, 3), ("a", 1, 1, 1, 2)], readers.LABEL_SCHEMA)
    for name, d in (("p", prob), ("l", lab), ("e", lab.where("z = 0"))):
        d.write.parquet(str(tmp_path / name))
    shapes = spark.createDataFrame([("a", 2, 2, 2)], "case_id string, dim_z int, dim_y int, dim_x int")
    args = [str(tmp_path / n) for n in "ple"]
    got = {r["z"]: r for r in readers.read_voxels(spark, *args, shapes).collect()}
    assert got[0]["ref_lab"] == 3 and got[0]["export_lab"] == 3 and got[0]["p_wt"] == pytest.approx(0.9)
    assert (got[1]["ref_lab"], got[1]["export_lab"], got[1]["p_et"]) == (2, 0, 0.0)
    with pytest.raises(guards.GuardError):
        readers.read_voxels(spark, *args, shapes.withColumn("dim_z", F.lit(1)))
    folds = {r["fold"] for r in spark.read.parquet(args[0]).collect()}
    assert {r["fold"] for r in got.values()} == folds
    assert readers.read_voxels(spark, *args, folds=[max(folds) + 1]).count() == 0
    several = spark.createDataFrame([("a", 0), ("a", 1)], "case_id string, fold int")
    with pytest.raises(guards.GuardError, match="several folds"):
        readers.read_voxels(spark, *args, cases=several)


def test_quantiles_and_thresholds_ignore_nan(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(i, v) for i, v in enumerate((0.1, 0.2, 0.3, nan, inf, None))], "case_id int, v double")
    for rows in (None, 1 << 60):
        got = ordered.quantiles(df, [], "v", {"q": 0.5}, ["case_id"], "n", rows=rows).first()
        assert (got["q"], got["n"]) == (0.2, 3)
    flagged = binning.quantile_flags(df, "v").orderBy("case_id").collect()
    assert [r["failure_eligible"] for r in flagged] == [True, True, True, False, False, False]
    above = df.select(float_gt(F.col("v").cast("float"), 0.15).alias("a")).collect()
    assert [r["a"] for r in above] == [False, True, True, False, True, None]


def test_null_keys_are_refused_by_components(spark):
    vox = spark.createDataFrame([(None, 0, 0, 0)], "case_id int, z int, y int, x int")
    with pytest.raises(Exception, match="holds NULL"):
        components.connected_components(vox, ["case_id"]).count()


@pytest.mark.parametrize("limit", [10, 0])
def test_lookup_both_ways(spark, limit):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    got = lk.lookup(left, right, ["k"], ["id"], limit=limit).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"x": 334, "y": 333, None: 333}
    assert lk.lookup(left, right.select("k"), ["k"], ["id"], "left_semi", limit).count() == 667


def test_ensembles(spark):
    schema = "case_id int, m int, z int, y int, x int, p_wt float, p_tc float, p_et float"
    rows = [(1, 0, 0, 0, 0, 1.0, 0.5, 0.0), (1, 1, 0, 0, 0, 0.5, 0.5, 0.5), (1, 1, 0, 0, 1, 1.0, 1.0, 1.0)]
    got = {r["x"]: r for r in ensemble.ensemble_mean(spark.createDataFrame(rows, schema), ["case_id"], "m", {0: 0.5, 1: 0.5}).collect()}
    assert got[0]["p_wt"] == pytest.approx(0.75) and got[1]["p_et"] == pytest.approx(0.5)
    flips = spark.createDataFrame([(1, "", 0, 0, 0, 1.0), (1, "x", 0, 0, 4, 1.0), (1, "xyz", 2, 1, 4, 0.5)], "case_id int, f string, z int, y int, x int, p float")
    dims = spark.createDataFrame([(1, 3, 2, 5)], "case_id int, dim_z int, dim_y int, dim_x int")
    out = ensemble.tta_mean(flips, ["case_id"], "f", dims, ["case_id"], ("", "x", "xyz"), ("p",)).collect()
    assert len(out) == 1 and (out[0]["z"], out[0]["y"], out[0]["x"]) == (0, 0, 0) and out[0]["p"] == pytest.approx(2.5 / 3)
    img = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 9.0), (2, 0, 4.0)], "c int, x int, v double")
    z = {(r["c"], r["x"]): r["z_score"] for r in ensemble.masked_zscore(img, ["c"], "v", F.col("x") < 2, ["x"]).collect()}
    assert z == {(1, 0): -1.0, (1, 1): 1.0, (1, 2): 0.0, (2, 0): 0.0}


def test_an_interrupted_write_is_not_in_the_way(spark, tmp_path):
    rows = spark.range(3).withColumn("bad", F.expr("if(id = 2, raise_error('stop'), 1)"))
    target = str(tmp_path / "t")
    with pytest.raises(Exception, match="stop"):
        writers.write_table(rows, target)
    assert not (tmp_path / "t").exists()
    writers.write_table(rows.drop("bad"), target)
    assert spark.read.parquet(target).count() == 3 and (tmp_path / "t" / "_SUCCESS").exists()
    for write in (writers.write_table, writers.write_document, writers.snapshot):
        with pytest.raises(FileExistsError, match="already exists"):
            write(rows.drop("bad").limit(1), target)
    assert spark.read.parquet(target).count() == 3


def test_package_cases_names_what_is_wrong(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "case string, n int, v string")
    writers.write_cases(files, str(tmp_path / "files"), "case", ["n"])
    labels = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "case_id string, lab int")
    pack = lambda lab, name: analyses.package_cases(lab, str(tmp_path / "files"), str(tmp_path / name), folder="case", glob="*.csv")
    got = {r.case_id: r for r in pack(labels, "ok").collect()}
    raw = {c: next((tmp_path / "files" / f"case={c}").glob("*.csv")).read_bytes() for c in "ab"}
    assert {c: (r.length, r.sha256, list(r.labels), r.n_cases) for c, r in got.items()} == {
        c: (len(raw[c]), hashlib.sha256(raw[c]).hexdigest(), lab, 2) for c, lab in (("a", [1, 3]), ("b", [2]))}
    assert raw["a"] == b"n,v\n1,x\n2,y\n"
    with pytest.raises(guards.GuardError, match="missing or extra.*'c'.*missing"):
        pack(labels.union(spark.createDataFrame([("c", 1)], labels.schema)), "one")
    with pytest.raises(guards.GuardError, match="missing or extra.*'b'.*extra"):
        pack(labels.where("case_id = 'a'"), "two")
    with pytest.raises(guards.GuardError, match="domain"):
        pack(labels.withColumn("lab", F.lit(9)), "three")
    spark.createDataFrame([("x",)], "v string").coalesce(1).write.csv(str(tmp_path / "files" / "case=b" / "more"))
    with pytest.raises(guards.GuardError, match="several files"):
        pack(labels, "four")
    assert not any((tmp_path / n).exists() for n in ("one", "two", "three", "four"))


def test_inputs_are_kept_with_their_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, v string")
    taken = analyses.take_inputs(str(tmp_path / "a"), rows=df, none=df.where("false"))
    assert taken["rows"].count() == 2 and taken["none"].count() == 0
    one = {r.input: (r.n_rows, r.digest) for r in spark.read.parquet(str(tmp_path / "a" / "inputs" / "digests")).collect()}
    analyses.take_inputs(str(tmp_path / "b"), rows=df.orderBy(F.desc("id")).select("v", "id"), none=df.where("id = 1"))
    two = {r.input: (r.n_rows, r.digest) for r in spark.read.parquet(str(tmp_path / "b" / "inputs" / "digests")).collect()}
    assert one["rows"] == two["rows"] and one["none"] != two["none"]
    with pytest.raises(FileExistsError):
        analyses.take_inputs(str(tmp_path / "a"), rows=df)


def test_voxel_tables_by_fold_are_pruned_by_the_cases(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{k}", k % 3, 0, 0, k) for k in range(6)], "case_id string, fold int, z int, y int, x int")
    paths = [str(tmp_path / n) for n in ("prob", "label")]
    rows.selectExpr("*", "0.5f p_wt", "0.5f p_tc", "0.5f p_et").write.partitionBy("fold").parquet(paths[0])
    rows.selectExpr("*", "cast(1 as tinyint) lab").write.partitionBy("fold").parquet(paths[1])
    cases = rows.where("fold = 1").select("case_id", "fold")
    got = readers.read_voxels(spark, *paths, cases=cases)
    assert {(r.case_id, r.fold, r.ref_lab) for r in got.collect()} == {("c1", 1, 1), ("c4", 1, 1)}
    text = got._jdf.queryExecution().toString()
    assert text.count("PartitionFilters: [isnotnull(fold") + text.count("PartitionFilters: [(fold") + text.count("PartitionFilters: [fold") >= 2
