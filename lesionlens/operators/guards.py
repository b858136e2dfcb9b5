"""Data-quality guards: each returns the violations as rows; no rows means the check passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.functions.fixed import ALLOWED_LABELS
from lesionlens.operators.lookup import with_scalars


class GuardError(ValueError):
    """A guard found violations."""


def assert_empty(violations: DataFrame, what: str, examples: int = 5) -> None:
    """Raise :class:`GuardError` with up to five examples if there are violations."""
    found = violations.limit(examples).collect()
    if found:
        shown = "; ".join(str(r.asDict(recursive=True)) for r in found)
        raise GuardError(f"{what}: {shown}")


def count_guard(df: DataFrame, key: list[str], expect: int | None = None) -> DataFrame:
    """One row (n_rows, n_distinct, expected) if keys repeat or their number is not ``expect``."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(*key).alias("n_distinct"))
    n = n.withColumn("expected", F.lit(expect).cast("bigint"))
    wrong = F.col("n_rows") != F.col("n_distinct")
    if expect is not None:
        wrong = wrong | (F.col("n_rows") != expect)
    return n.where(wrong)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def fold_leaks(df: DataFrame, case: str, fold: str) -> DataFrame:
    """Cases that occur in more than one fold."""
    return df.groupBy(case).agg(F.countDistinct(fold).alias("n_folds")).where("n_folds > 1")


def fold_mismatch(metrics: DataFrame, splits: DataFrame, case: str = "case_id", fold: str = "fold") -> DataFrame:
    """Metric rows whose fold is not the split's, or whose case is in no split."""
    known = splits.select(case, F.col(fold).alias("split_fold"))
    return metrics.join(known, case, "left").where(~F.col(fold).eqNullSafe(F.col("split_fold")))


def align_guard(df: DataFrame, config: str, case: str, n_configs: int) -> DataFrame:
    """Cases that are missing from at least one of ``n_configs`` configurations."""
    return df.groupBy(case).agg(F.countDistinct(config).alias("n_configs")).where(F.col("n_configs") < n_configs)


def reconcile(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): ok, missing (only expected) or extra (only present); keys may repeat on either side."""
    sides = expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_p")).unionByName(
        present.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_p"))
    ).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_p").alias("_p"))
    status = F.when(F.col("_p") == 0, "missing").when(F.col("_e") == 0, "extra").otherwise("ok")
    return sides.select(*keys, status.alias("status"))


def reconcile_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def content_digest(df: DataFrame, content: str, out: str = "sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(content).cast("binary"), 256))


def row_digests(df: DataFrame, out: str = "sha256") -> DataFrame:
    """One digest for each row, of all its columns by name."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias(out))


def table_digest(df: DataFrame, digest: str = "sha256") -> DataFrame:
    """One row (n_rows, digest) of a whole table from its row digests, independent of row order.

    The row digests are summed limb by limb (exact integers, combined map-side) and the sums hashed, so
    no task ever sees the table; repeated rows count.
    """
    limbs = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(x).alias(f"_l{k}") for k, x in enumerate(limbs)])
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_l{k}").cast("string") for k in range(4)])
    return sums.select("n_rows", F.sha2(text, 256).alias("digest"))


def label_domain(labels: DataFrame, keys: list[str], lab: str, allowed: tuple[int, ...] = ALLOWED_LABELS) -> DataFrame:
    """(keys, labels, n_labels, valid): sorted distinct labels per case; labels are 16-bit integers.

    Distinct (case, label) rows are formed first, so the collected sets hold at most one entry per label.
    """
    pairs = labels.select(*keys, F.col(lab).cast("smallint").alias("_l")).distinct()
    out = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list("_l")).alias("labels"))
    bad = F.size(F.array_except("labels", F.array(*[F.lit(a).cast("smallint") for a in allowed])))
    return out.select(*keys, "labels", F.size("labels").alias("n_labels"), (bad == 0).alias("valid"))


def _affine_matches(a: Column, b: Column, atol: float) -> Column:
    if atol == 0.0:
        close = F.zip_with(a, b, lambda x, y: (x == y) & ~F.isnan(x))
    else:
        close = F.zip_with(a, b, lambda x, y: (F.abs(x - y) <= atol) & ~F.isnan(x) & ~F.isnan(y))
    return (F.size(a) == F.size(b)) & F.forall(close, lambda ok: F.coalesce(ok, F.lit(False)))


def _side_by_side(ref: DataFrame, out: DataFrame, key: str) -> DataFrame:
    return ref.select(key, F.col("affine").alias("ref_affine"), F.col("shape").alias("ref_shape"), F.lit(True).alias("_in_ref")).join(
        out.select(key, F.col("affine").alias("out_affine"), F.col("shape").alias("out_shape"), F.lit(True).alias("_in_out")), key, "full"
    )


def geometry_matches(ref: DataFrame, out: DataFrame, key: str, atol: float = 0.0) -> DataFrame:
    """(key, matches): shape exactly equal and affine within ``atol`` (bit-exact by default, no relative part).

    A case that only one side has does not match.
    """
    same = (F.col("ref_shape") == F.col("out_shape")) & _affine_matches(F.col("ref_affine"), F.col("out_affine"), atol)
    return _side_by_side(ref, out, key).select(key, F.coalesce(same, F.lit(False)).alias("matches"))


def geometry_violations(ref: DataFrame, out: DataFrame, key: str, atol: float = 0.0) -> DataFrame:
    """Mismatching cases with ``reason`` missing, extra, shape (checked in this order) or affine, and both values."""
    absent = F.when(F.col("_in_out").isNull(), "missing").when(F.col("_in_ref").isNull(), "extra")
    reason = absent.when(~F.col("ref_shape").eqNullSafe(F.col("out_shape")), "shape").when(
        ~F.coalesce(_affine_matches(F.col("ref_affine"), F.col("out_affine"), atol), F.lit(False)), "affine"
    )
    return _side_by_side(ref, out, key).withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_in_ref", "_in_out")


def shape_guard(vox: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Cases with voxels outside their declared volume (dim_z, dim_y, dim_x) or without a declared one."""
    axes = ("z", "y", "x")
    box = vox.groupBy(*keys).agg(
        *[F.min(a).alias(f"min_{a}") for a in axes], *[F.max(a).alias(f"max_{a}") for a in axes]
    )
    inside = reduce(
        lambda p, q: p & q, [(F.col(f"min_{a}") >= 0) & (F.col(f"max_{a}") < F.col(f"dim_{a}")) for a in axes]
    )
    return box.join(shapes, keys, "left").where(~F.coalesce(inside, F.lit(False)))


def manifest(labels: DataFrame, files: DataFrame, key: str, lab: str, content: str, name: str) -> DataFrame:
    """(key, file, labels, valid, sha256, status, n_cases): one row per case and file.

    ``status`` is ok, missing (labels without a file) or extra (a file without labels); ``n_cases`` counts the
    finished cases, those that are ok. It is one number, attached from an ungrouped aggregate.
    """
    domain = label_domain(labels, [key], lab).withColumn("_e", F.lit(1))
    digests = content_digest(files, content).select(key, F.col(name).alias("file"), "sha256", F.lit(1).alias("_p"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_e").isNull(), "extra").otherwise("ok")
    rows = domain.join(digests, key, "full").withColumn("status", status)
    total = rows.where("status = 'ok'").agg(F.countDistinct(key).alias("n_cases"))
    return with_scalars(rows.select(key, "file", "labels", "valid", "sha256", "status"), total)
