"""Physical plans: what is read, how often rows move, and that nothing is joined without keys."""

import re

import pytest
from pyspark.sql import functions as F

from lesionlens.operators import components, ordered, surface, voxels
from lesionlens.plans import fixtures
from lesionlens.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vox(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vox") / "v")
    spark.range(4000).select(
        (F.col("id") % 3).alias("case_id"), (F.col("id") % 2).cast("int").alias("fold"),
        *[F.floor(F.col("id") / k % 20).cast("int").alias(a) for k, a in ((400, "z"), (20, "y"), (1, "x"))],
        (F.col("id") % 4).cast("tinyint").alias("pred_lab"), (F.col("id") % 3).cast("tinyint").alias("ref_lab"),
        F.rand(1).cast("float").alias("p_wt"),
    ).write.partitionBy("fold").parquet(path)
    return spark.read.parquet(path)


def test_dice_reads_three_columns_and_shuffles_once(vox):
    p = plan(voxels.dice(vox.where("fold = 1"), ["case_id"]))
    assert re.search(r"ReadSchema: struct<case_id:bigint,pred_lab:tinyint,ref_lab:tinyint>", p)
    assert "PartitionFilters: [isnotnull(fold" in p and p.count("Exchange hashpartitioning") == 1


def test_erosion_moves_voxels_once(vox):
    p = plan(voxels.erode_bits(vox.withColumn("m", F.lit(1)), ["case_id"], "m"))
    assert p.count("Exchange hashpartitioning") == 1


def test_surface_needs_one_voxel_shuffle(vox):
    pairs = {f"p{k}": (F.col("pred_lab") > k, F.col("ref_lab") > k) for k in range(3)}
    p = plan(surface.surface_dice(vox, ["case_id"], pairs))
    assert p.count("Exchange hashpartitioning") == 2  # voxels, sums per case


def test_no_join_without_keys(vox):
    comp = components.connected_components(vox.select("case_id", "z", "y", "x"), ["case_id"], tile=8)
    for df in (components.lesion_match(comp, comp, ["case_id"]), components.min_size_filter(comp, ["case_id"], 3),
               ordered.quantiles(vox, ["case_id"], "p_wt", {"m": 0.5})):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_hot_group_is_split_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
    df = spark.range(20000).select(F.when(F.col("id") < 12000, 0).otherwise(1 + F.col("id") % 50).alias("g"), "id", F.lit(1.0).alias("v"))
    # small partitions would be merged again; at scale they are not small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = ordered._pieces(df, ["g", "v", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    largest = pieces.groupBy("g", ordered.PIECE).count().agg(F.max("count")).first()[0]
    assert largest <= 12000 / 3  # one group and even one value spread over several tasks
    got = ordered.ranked(df, ["g"], "v", ["id"]).where("g = 0").agg(F.min("ties"), F.max("ties"), F.max("before")).first()
    assert tuple(got) == (12000, 12000, 0)


@pytest.mark.parametrize("name", sorted(fixtures.GROUPED))
def test_voxels_meet_before_they_are_grouped(spark, tmp_path, monkeypatch, name):
    spark.range(6000).selectExpr(
        "id % 40 l_orderkey", "nullif(id % 30, 7) l_partkey", "nullif(id % 3, 2) l_suppkey", "cast(id % 4 as int) l_linenumber",
        "cast(id % 50 as double) l_quantity", "id * 1.5e0 l_extendedprice", "id % 11 / 100.0e0 l_discount", "id % 9 / 100.0e0 l_tax",
        "substr('ANR', cast(id % 3 as int) + 1, 1) l_returnflag",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = sorted(map(str, fixtures.fixture(spark, str(tmp_path), name).collect()))
    monkeypatch.setattr(fixtures, "GROUPED_ROWS", (100, 1000))
    got = fixtures.fixture(spark, str(tmp_path), name)
    p = plan(got)
    assert p.count("Exchange") == 1 and p.index("partial_") < p.index("Exchange")  # the plan begins with its last step
    assert sorted(map(str, got.collect())) == plain and len(plain) < 6000
    assert got.groupBy(F.spark_partition_id()).count().count() > 20


def test_grouping_tasks_are_bounded():
    rows = (1, 600_000, 36_000_000, 216_000_000, 2_160_000_000)
    assert [fixtures.grouping_tasks(n) for n in rows] == [1, 2, 72, 200, 1080]


def test_list_files_never_reads_contents(spark, tmp_path):
    (tmp_path / "a.nii.gz").write_bytes(b"abc")
    p = plan(readers.list_files(spark, str(tmp_path)))
    assert "content" not in re.search(r"ReadSchema: \S+", p).group(0)


def test_checkpoint_folder(spark, monkeypatch):
    from lesionlens import session

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Fake:
        sparkContext = spark.sparkContext
        conf = Conf("s3a://shared/ckpt")

    assert session.checkpoint_root(Fake) == "s3a://shared/ckpt"
    Fake.conf = Conf(None)
    monkeypatch.setattr(session, "_local_roots", {})
    assert session.checkpoint_root(Fake) == session.checkpoint_root(Fake)

    class Cluster:
        master = "spark://host:7077"

    Fake.sparkContext = Cluster
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake)
