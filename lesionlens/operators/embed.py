"""Imputation, standardisation and principal components of feature columns."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from lesionlens.operators.lookup import with_scalars
from lesionlens.operators.ordered import quantiles
from lesionlens.session import materialize


def impute_median(df: DataFrame, columns: list[str], case: str = "case_id") -> DataFrame:
    """Missing values of each column become its median; one stacked quantile job for all columns."""
    items = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
    mid = quantiles(df.select(case, F.inline(items)), ["_c"], "_v", {"_m": 0.5}, [case])
    one = mid.agg(*[F.max(F.when(F.col("_c") == c, F.col("_m"))).alias(f"_m_{c}") for c in columns])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}
    return with_scalars(df, one).withColumns(filled).drop(*[f"_m_{c}" for c in columns])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population standard deviation; a constant column is only centred."""
    one = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {
        c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return with_scalars(df, one).withColumns(scaled).drop(*[f"_{k}_{c}" for k in "as" for c in columns])


def pca(df: DataFrame, columns: list[str], k: int = 10, case: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(component, explained_ratio) and (case, pca1, pca2) of standardised columns.

    The sign of a component is fixed: its loading of largest magnitude is positive. Only the loadings,
    columns x k numbers, reach the driver.
    """
    k = min(k, len(columns))
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df).select(case, "_x")
    rows = materialize(rows, "vectors")  # read by the fit and by the scores
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    ratios = [(j + 1, float(v)) for j, v in enumerate(model.explainedVariance.toArray())]
    explained = df.sparkSession.createDataFrame(ratios, "component int, explained_ratio double")
    scores = vector_to_array("_p")
    parts = [(scores[j] * F.lit(signs[j])).alias(f"pca{j + 1}") for j in range(min(2, k))]
    return explained, model.transform(rows).select(case, *parts)
