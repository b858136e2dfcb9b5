"""File inventories: names to cases, modalities and channels, completeness and case discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.functions.fixed import MODALITIES, VOLUME_SUFFIX
from lesionlens.functions.scalars import case_id
from lesionlens.operators.ordered import row_position


def parse_name(path: str | Column) -> Column:
    """Struct (case_id, modality, channel) of a volume file name, NULL for other names.

    ``<case>-<modality>.nii.gz`` is tried first, then ``<case>_<channel>.nii.gz``.
    """
    path = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(path, "/"), -1)
    tail = VOLUME_SUFFIX.replace(".", r"\.") + "$"
    by_modality = rf"(?s)^(.*)-({'|'.join(MODALITIES)}){tail}"
    by_channel = rf"(?s)^(.+)_({'|'.join(MODALITIES.values())}){tail}"
    code = F.create_map(*[F.lit(x) for kv in MODALITIES.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in MODALITIES.items() for x in (v, k)])
    m, c = F.regexp_extract(name, by_modality, 2), F.regexp_extract(name, by_channel, 2)
    return F.when(
        m != "",
        F.struct(
            F.regexp_extract(name, by_modality, 1).alias("case_id"), m.alias("modality"),
            F.try_element_at(code, m).alias("channel"),
        ),
    ).when(
        c != "",
        F.struct(
            F.regexp_extract(name, by_channel, 1).alias("case_id"), F.try_element_at(back, c).alias("modality"),
            c.alias("channel"),
        ),
    )


def parse_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with case_id, modality and channel; names in neither convention are left out."""
    return files.withColumn("_n", parse_name(path)).where(F.col("_n").isNotNull()).select(*files.columns, "_n.*")


def duplicate_modalities(inv: DataFrame) -> DataFrame:
    return inv.groupBy("case_id", "modality").agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")


def missing_modalities(inv: DataFrame, required: tuple[str, ...] = tuple(MODALITIES)) -> DataFrame:
    """(case_id, missing): sorted modalities without a file.

    One flag per required modality, so nothing is collected per case.
    """
    have = inv.groupBy("case_id").agg(*[F.max(F.col("modality") == m).alias(f"_{m}") for m in required])
    lacks = F.array_compact(F.array(*[F.when(~F.col(f"_{m}"), F.lit(m)) for m in sorted(required)]))
    return have.select("case_id", lacks.alias("missing")).where(F.size("missing") > 0)


def channel_map(inv: DataFrame, path: str = "path") -> DataFrame:
    """(source, destination): each file and its channel-coded target name."""
    target = F.concat(F.col("case_id"), F.lit("_"), F.col("channel"), F.lit(VOLUME_SUFFIX))
    return inv.select(F.col(path).alias("source"), target.alias("destination"))


def stale_files(present: DataFrame, mapping: DataFrame) -> DataFrame:
    """Target files that no source maps to."""
    return present.join(mapping.select("destination"), "destination", "left_anti")


def discover_cases(
    files: DataFrame, labels: DataFrame, exports: DataFrame, expect: dict[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) from out-of-fold prediction files (fold, path), label files (path) and exports (fold, path).

    ``cases``: (case_index, fold, case_id, path), a dense index in (fold, name) order. ``violations``:
    (reason, case_id) for a name in several folds, a name repeated in a fold, a missing label, a missing export, and with
    ``expect`` (cases of each fold) a fold whose number of cases is another, named fold <n>.
    """
    rows = files.select("fold", case_id("path").alias("case_id"), "path")
    rows = rows.withColumn("_order", F.struct("fold", "case_id"))
    cases = row_position(rows, [], "_order").select(
        (F.col("ordinal") - 1).alias("case_index"), "fold", "case_id", "path"
    )
    found = rows.select("fold", "case_id")
    several = found.groupBy("case_id").agg(F.countDistinct("fold").alias("_n")).where("_n > 1")
    twice = found.groupBy("fold", "case_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    no_label = found.join(labels.select(case_id("path").alias("case_id")), "case_id", "left_anti")
    no_export = found.join(exports.select("fold", case_id("path").alias("case_id")), ["fold", "case_id"], "left_anti")
    violations = (
        several.select(F.lit("several folds").alias("reason"), "case_id")
        .unionByName(twice.select(F.lit("duplicate").alias("reason"), "case_id"))
        .unionByName(no_label.select(F.lit("no label").alias("reason"), "case_id"))
        .unionByName(no_export.select(F.lit("no export").alias("reason"), "case_id"))
    )
    if expect is not None:
        wanted = found.sparkSession.createDataFrame(list(expect.items()), "fold int, _wanted bigint")
        counts = found.groupBy("fold").agg(F.countDistinct("case_id").alias("_n")).join(wanted, "fold", "full")
        off = counts.where(~F.col("_n").eqNullSafe(F.col("_wanted")))
        violations = violations.unionByName(off.select(F.lit("count").alias("reason"), F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("case_id")))
    return cases, violations
