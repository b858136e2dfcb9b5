"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lesionlens.functions.fixed import METRIC_FAMILIES, REGIONS, SUMMARY_KEYS, VOLUME_SUFFIX
from lesionlens.functions.scalars import case_id, known
from lesionlens.operators.guards import assert_empty, content_digest, count_guard, fold_leaks, shape_guard
from lesionlens.operators.lookup import lookup

SCORE_SCHEMA = T.StructType(
    [T.StructField("subject_id", T.StringType())]
    + [T.StructField(f"{f}_{r}", T.DoubleType()) for f in METRIC_FAMILIES for r in REGIONS]
)
SUMMARY_SCHEMA = "metric_per_case array<struct<prediction_file string, reference_file string, " \
    "metrics map<string, struct<Dice double, FP double, FN double>>>>"
SPLIT_SCHEMA = "array<struct<val array<string>>>"
PROBABILITY_SCHEMA = "case_id string, fold int, z int, y int, x int, p_wt float, p_tc float, p_et float"
LABEL_SCHEMA = "case_id string, z int, y int, x int, lab tinyint"
GEOMETRY_SCHEMA = "case_id string, affine array<double>, shape array<int>"


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header. Columns are taken by name, so the file may hold others in any order."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    header = spark.read.option("header", True).csv(path)  # names only, nothing is inferred
    missing = [f.name for f in wanted if f.name not in header.columns]
    if missing:
        raise ValueError(f"{path}: columns {missing} are missing")
    # an empty field is missing, so are NaN and infinities; anything else has to fit the declared type
    return known(header.select(*[
        F.when(F.trim(F.col(f"`{f.name}`")) != "", F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in wanted
    ]))


def read_scores(
    spark: SparkSession, path: str, id_pattern: str, expect_n: int | None = None, schema: T.StructType = SCORE_SCHEMA
) -> DataFrame:
    """Score rows whose subject_id matches the anchored pattern (aggregate rows drop out), ordered by id.

    With ``expect_n`` the number of rows and of distinct ids is checked at once.
    """
    rows = keep_matching(scan_csv(spark, path, schema), "subject_id", id_pattern)
    if expect_n is not None:
        assert_empty(count_guard(rows, ["subject_id"], expect_n), f"{path}: expected {expect_n} case rows")
    return rows.orderBy("subject_id")


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose ``column`` matches the whole pattern; missing does not match."""
    body = pattern.removeprefix("^").removesuffix("$")
    return df.where(F.coalesce(F.col(column).rlike(f"^(?:{body})$"), F.lit(False)))


def read_features(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return known(spark.read.schema(schema).parquet(path))
    return scan_csv(spark, path, schema)


def flatten_summary(summaries: DataFrame, fold: str = "fold") -> DataFrame:
    """(case_id, fold, paths, {region}_{dice,fp,fn}) from summary documents; map keys are label tuples."""
    items = summaries.select(fold, F.explode("metric_per_case").alias("m"))
    values = []
    for r, key in SUMMARY_KEYS.items():
        at = F.try_element_at(F.col("m.metrics"), F.lit(key))
        values += [at[n].alias(f"{r}_{n.lower()}") for n in ("Dice", "FP", "FN")]
    return items.select(
        case_id("m.prediction_file").alias("case_id"), fold, F.col("m.prediction_file").alias("prediction_path"),
        F.col("m.reference_file").alias("reference_path"), *values,
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per-fold summary documents below ``path``; the fold number is in the folder name ``fold_<n>``."""
    docs = (
        spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path)
    )
    number = F.regexp_extract(F.col("_metadata.file_path"), r"fold_(\d+)", 1).cast("int")
    return flatten_summary(docs.withColumn("fold", number))


def explode_splits(df: DataFrame, document: str) -> DataFrame:
    """(fold, case_id) from a split list as JSON text; the position in the list is the fold."""
    parsed = df.select(F.from_json(document, SPLIT_SCHEMA).alias("_s"))
    return parsed.select(F.posexplode("_s").alias("fold", "_v")).select("fold", F.explode("_v.val").alias("case_id"))


def explode_map(df: DataFrame, document: str, keep: list[str] = ()) -> DataFrame:
    """(keep, key, value) rows of a JSON object column."""
    return df.select(*keep, F.explode(F.from_json(document, "map<string,string>")).alias("key", "value"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as text, one row per file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def list_files(spark: SparkSession, root: str, glob: str = f"*{VOLUME_SUFFIX}") -> DataFrame:
    """(path, length, modificationTime) of matching files at any depth; contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(root).select("path", "length", "modificationTime")
    )


def read_contents(spark: SparkSession, root: str, glob: str = f"*{VOLUME_SUFFIX}") -> DataFrame:
    """(path, length, sha256) of matching files at any depth. A task holds one file at a time; only digests leave it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return content_digest(files, "content").select("path", "length", "sha256")


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GEOMETRY_SCHEMA).parquet(path)


def _labels(spark: SparkSession, path: str, folds: list[int] | None) -> DataFrame:
    """A label table; of one partitioned by fold, those folds only."""
    lab = spark.read.schema(LABEL_SCHEMA).parquet(path)
    return lab.where(F.col("fold").isin(folds)) if folds is not None and "fold" in lab.columns else lab


def read_voxels(
    spark: SparkSession, prob: str, label: str, export: str | None = None, shapes: DataFrame | None = None,
    cases: DataFrame | None = None, folds: list[int] | None = None,
) -> DataFrame:
    """(case_id, fold, z, y, x, probabilities, reference and exported labels) per voxel, absent background as 0.

    The fold of a case is that of its probabilities, or of ``cases`` (case_id, fold), which also covers cases without any
    probability above background. A case in several folds is an error. ``folds`` keeps the cases of some folds, by default those of
    ``cases``; of tables partitioned by fold, labels and exports included, only those partitions are read.

    The sources are sparse voxel tables, aligned by one union and aggregation. With ``shapes``
    (case_id, dim_z, dim_y, dim_x) any voxel outside its volume is an error.
    """
    axes = ["case_id", "z", "y", "x"]
    zero, none = F.lit(0).cast("tinyint"), F.lit(0.0).cast("float")
    p = known(spark.read.schema(PROBABILITY_SCHEMA).parquet(prob))
    if folds is None and cases is not None:
        folds = [r.fold for r in cases.select(F.col("fold").cast("int").alias("fold")).distinct().collect()]  # a handful
    if folds is not None:
        p = p.where(F.col("fold").isin(folds))
    named = (p if cases is None else cases).select("case_id", F.col("fold").cast("int").alias("fold")).distinct()
    if folds is not None:
        named = named.where(F.col("fold").isin(folds))
    assert_empty(fold_leaks(named, "case_id", "fold"), "cases in several folds")
    parts = p.select(*axes, "p_wt", "p_tc", "p_et", zero.alias("ref_lab"), zero.alias("export_lab"))
    empty = [none.alias(c) for c in ("p_wt", "p_tc", "p_et")]
    lab = _labels(spark, label, folds)
    parts = parts.unionByName(lab.select(*axes, *empty, F.col("lab").alias("ref_lab"), zero.alias("export_lab")))
    if export is not None:
        exp = _labels(spark, export, folds)
        parts = parts.unionByName(exp.select(*axes, *empty, zero.alias("ref_lab"), F.col("lab").alias("export_lab")))
    if shapes is not None:
        assert_empty(shape_guard(parts, shapes, ["case_id"]), "voxels outside their volume")
    values = ("p_wt", "p_tc", "p_et", "ref_lab", "export_lab")
    rows = parts.groupBy(*axes).agg(*[F.max(c).alias(c) for c in values])
    rows = lookup(rows, named, ["case_id"], ["z", "y", "x"], "left" if folds is None else "inner")
    return rows.select("case_id", "fold", "z", "y", "x", *values)
