import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lesionlens.operators import ordered
from lesionlens.operators.ordered import average_rank, quantiles, ranked, row_position, suffix_min


@pytest.fixture(params=["small", "ranged"], autouse=True)
def path(request, monkeypatch):
    if request.param == "ranged":
        monkeypatch.setattr(ordered, "SMALL_ROWS", 0)


def table(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
    v = np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 200, n) / 8.0)
    pdf = pd.DataFrame({"g": g.astype("int64"), "id": np.arange(n), "v": v, "w": rng.integers(1, 4, n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_average_rank_matches_pandas(spark, parts):
    pdf, df = table(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = average_rank(df, ["g"], "v", ["id"]).toPandas().set_index("id").avg_rank.sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = pdf.groupby("g").v.rank(method="average")
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_weighted_rank_equals_repeated_rows(spark):
    pdf, df = table(spark, 600)
    got = average_rank(df, ["g"], "v", ["id"], weight="w").toPandas().set_index("id").avg_rank.sort_index()
    rep = pdf.loc[pdf.index.repeat(pdf.w)]
    want = rep.assign(r=rep.groupby("g").v.rank(method="average")).groupby("id").r.first()
    assert np.allclose(got.to_numpy(), want.to_numpy())


def test_quantiles_match_numpy(spark):
    pdf, df = table(spark)
    got = quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.975}, ["id"], count="n").toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(float), np.quantile(part.v, [0.05, 0.5, 0.975]))
        assert got.loc[g, "n"] == len(part)
    whole = quantiles(df, [], "v", {"m": 0.1}, ["id"]).collect()
    assert whole[0]["m"] == pytest.approx(np.quantile(pdf.v, 0.1))


def test_positions_and_suffix_min(spark):
    pdf, df = table(spark)
    pos = row_position(df, ["g"], "id").toPandas()
    want = pdf.sort_values("id").groupby("g").cumcount() + 1
    assert (pos.set_index("id").ordinal.sort_index().to_numpy() == want.sort_index().to_numpy()).all()
    got = suffix_min(df.withColumn("x", F.col("v") * ((F.col("id") * 7919) % 101)), ["g"], ["v", "id"], "x")
    got = got.toPandas().set_index("id").suffix_min
    p = pdf.assign(x=pdf.v * ((pdf.id * 7919) % 101)).sort_values(["g", "v", "id"], ascending=False)
    want = p.groupby("g").x.cummin().set_axis(p.id)
    assert np.allclose(got.sort_index(), want.sort_index())


def test_null_values_and_single_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, None), (3, 5.0)], "g int, v double")
    got = {r["g"]: (r["before"], r["ties"], r["total"]) for r in ranked(df, ["g"], "v").collect()}
    assert got == {1: (0, 1, 1), 3: (0, 1, 1)}
