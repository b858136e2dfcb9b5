"""Catalogue, files part: sinks, file inventories, digests of contents and the manifest, each written and read back in the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lesionlens.functions.fixed import METRIC_FAMILIES, REGIONS
from lesionlens.operators import guards
from lesionlens.operators.lookup import with_scalars
from lesionlens.plans import analyses
from lesionlens.plans.check_sql import fx, with_
from lesionlens.plans.fixtures import fixture, table
from lesionlens.session import materialize, scratch
from lesionlens.sources import readers, writers


def _case_files(spark, sf) -> str:
    """A file for each nation that has customers: its customers, in order."""
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    writers.write_cases(rows, path := scratch(spark, "case-files"), "c_nationkey", ["c_custkey"])
    return path


def _nation(path: str = "path"):
    return F.regexp_extract(path, "/c_nationkey=([^/]*)/", 1).cast("int").alias("nation")


def file_inventory(spark, sf) -> DataFrame:
    return readers.list_files(spark, _case_files(spark, sf), "*.csv").select(_nation(), "length")


def file_digests(spark, sf) -> DataFrame:
    return readers.read_contents(spark, _case_files(spark, sf), "*.csv").select(_nation(), "length", "sha256")


def package_manifest(spark, sf) -> DataFrame:
    """The manifest of the nations' files; labels by segment."""
    customers = table(spark, sf, "customer")
    lab = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(3)
    labels = customers.select(F.col("c_nationkey").alias("case_id"), lab.alias("lab"))
    out = analyses.package_cases(labels, _case_files(spark, sf), scratch(spark, "manifest"), folder="c_nationkey", glob="*.csv")
    return out.select("case_id", "length", "sha256", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"), "n_cases")


def _score_file(spark, sf) -> str:
    scores = fixture(spark, sf, "scores")
    name = F.concat("config", F.lit("-"), F.lpad(F.col("case_id").cast("string"), 8, "0"))
    values = {f"{f}_{r}": F.col(f"dsc_{r}") * (k + 1) for k, f in enumerate(METRIC_FAMILIES) for r in REGIONS}
    rows = scores.select(name.alias("subject_id"), *[v.alias(c) for c, v in values.items()])
    means = rows.agg(F.lit("mean").alias("subject_id"), *[F.avg(c).alias(c) for c in values])
    writers.write_table(rows.unionByName(means), path := scratch(spark, "scores-csv"), ["subject_id"], "csv")
    return path


def csv_round_trip(spark, sf) -> DataFrame:
    """Score rows written as CSV with the scorer's own mean row, scanned back by pattern."""
    return readers.read_scores(spark, _score_file(spark, sf), r"c\d-\d{8}", fixture(spark, sf, "scores").count())


def refused_write(spark, sf) -> DataFrame:
    """A second write of other rows is refused and leaves the first."""
    regions, path = table(spark, sf, "region").select("r_regionkey", "r_name"), scratch(spark, "refused")
    writers.write_table(regions, path, ["r_regionkey"])
    refused = 0
    for write in (lambda: writers.write_table(regions.where("r_regionkey > 1"), path), lambda: writers.write_document(regions, path), lambda: writers.snapshot(regions, path)):
        try:
            write()
        except FileExistsError:
            refused += 1
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


def document_round_trip(spark, sf) -> DataFrame:
    """A nested document for each nation, written as JSON and flattened again."""
    cases = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("cases"), F.count(F.lit(1)).alias("n_cases"))
    nested = cases.select(F.col("c_nationkey").alias("nation"), F.struct("n_cases", F.lit("1.0").alias("version")).alias("about"), "cases")
    writers.write_document(nested, path := scratch(spark, "documents"))
    back = spark.read.schema(nested.schema).json(path)
    return back.select("nation", F.col("about.n_cases").alias("n_cases"), F.inline("cases"))


def snapshot_inputs(spark, sf) -> DataFrame:
    """Rows and digest of the inputs that an analysis keeps: of the stored copies, and of the tables themselves."""
    inputs = {n: table(spark, sf, n) for n in ("supplier", "labels")}
    target = scratch(spark, "analysis")
    taken = analyses.take_inputs(target, **inputs)
    again = [guards.table_digest(guards.row_digests(df)).select(F.lit(n).alias("input"), F.col("digest").alias("of_table")) for n, df in inputs.items()]
    kept = spark.read.parquet(f"{target}/inputs/digests").join(again[0].unionByName(again[1]), "input")
    sizes = {n: df.count() for n, df in taken.items()}
    stored = F.create_map(*[F.lit(x).cast(t) for n, k in sizes.items() for x, t in ((n, "string"), (k, "bigint"))])
    return kept.select("input", "n_rows", F.element_at(stored, F.col("input")).alias("n_stored"), (F.col("digest") == F.col("of_table")).alias("same"))


def voxel_scan(spark, sf) -> DataFrame:
    """Voxel tables by fold, scanned by the reader with the cases and shapes they are declared with."""
    # each is read several times: the voxels are derived once, what the reader aligned is aligned once
    vox = materialize(fixture(spark, sf, "voxels").withColumn("case_id", F.col("case_id").cast("string")), "voxels")
    root, axes = scratch(spark, "volumes"), ["case_id", "z", "y", "x"]
    parts = {"prob": vox.select("fold", *axes, "p_wt", "p_tc", "p_et"), "label": vox.select("fold", *axes, F.col("ref_lab").alias("lab")),
             "export": vox.select("fold", *axes, F.col("export_lab").alias("lab"))}
    for name, df in parts.items():
        df.write.partitionBy("fold").parquet(f"{root}/{name}")
    cases = materialize(vox.select("case_id", "fold").distinct(), "cases")
    shapes = cases.select("case_id", *[F.lit(20).alias(f"dim_{a}") for a in "zyx"])
    read = materialize(readers.read_voxels(spark, *[f"{root}/{n}" for n in parts], shapes=shapes, cases=cases), "aligned")
    outside = guards.shape_guard(read, shapes, ["case_id"]).agg(F.count(F.lit(1)).alias("n_outside"))
    lab = lambda c, v: F.count_if(F.col(c) == v)
    return with_scalars(read.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_voxels"), F.countDistinct("case_id").alias("n_cases"), *[F.max(a).alias(f"max_{a}") for a in "zyx"],
        lab("ref_lab", 3).alias("n_ref_et"), lab("export_lab", 3).alias("n_export_et"), F.round(F.sum(F.col("p_et").cast("double")), 4).alias("sum_et")), outside)


QUERIES = {
    "file_inventory": file_inventory, "file_digests": file_digests, "package_manifest": package_manifest, "csv_round_trip": csv_round_trip,
    "refused_write": refused_write, "document_round_trip": document_round_trip, "snapshot_inputs": snapshot_inputs, "voxel_scan": voxel_scan,
}

CASE_FILES = ("files", """select c_nationkey as nation, concat(string_agg(line, chr(10) order by c_custkey), chr(10)) as body from (
    select c_nationkey, c_custkey, concat(c_custkey, ',', c_name, ',', c_mktsegment) as line from customer) l group by 1""")
WHOLE = ("whole", "select nation, concat('c_custkey,c_name,c_mktsegment', chr(10), body) as body from files")

ORACLES = {
    "file_inventory": with_(CASE_FILES, WHOLE) + "select nation, cast(octet_length(encode(body)) as bigint) as length from whole",
    "file_digests": with_(CASE_FILES, WHOLE) + "select nation, cast(octet_length(encode(body)) as bigint) as length, sha256(body) as sha256 from whole",
    "package_manifest": with_(CASE_FILES, WHOLE) + """select cast(nation as varchar) as case_id, cast(octet_length(encode(body)) as bigint) as length,
        sha256(body) as sha256, labels, (select count(*) from whole) as n_cases from whole
        join (select c_nationkey as nation, string_agg(lab, ',' order by lab) as labels from (
          select distinct c_nationkey, case c_mktsegment when 'BUILDING' then '1' when 'MACHINERY' then '2' else '3' end as lab from customer) d group by 1) l using (nation)""",
    "csv_round_trip": with_(fx("scores")) + "select concat(config, '-', lpad(cast(case_id as varchar), 8, '0')) as subject_id, " + ", ".join(
        f"dsc_{r} * {k + 1} as {f}_{r}" for k, f in enumerate(METRIC_FAMILIES) for r in REGIONS) + " from scores",
    "refused_write": "select r_regionkey, r_name, 3 as refused from region",
    "document_round_trip": """select c_nationkey as nation, count(*) over (partition by c_nationkey) as n_cases, c_custkey, c_mktsegment from customer""",
    "snapshot_inputs": "select 'supplier' as input, count(*) as n_rows, count(*) as n_stored, true as same from supplier union all select 'labels', count(*), count(*), true from labels",
    "voxel_scan": with_(fx("voxels")) + """select fold, count(*) as n_voxels, count(distinct case_id) as n_cases, max(z) as max_z, max(y) as max_y, max(x) as max_x,
        count(case when ref_lab = 3 then 1 end) as n_ref_et, count(case when export_lab = 3 then 1 end) as n_export_et,
        round(sum(cast(p_et as double)), 4) as sum_et, cast(0 as bigint) as n_outside from voxels group by fold""",
}
