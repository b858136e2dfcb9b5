"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.functions.fixed import DOMAIN_NAMES, UNKNOWN_DOMAIN, UNKNOWN_GROUP, VOLUME_SUFFIX


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_missing(c: str | Column) -> Column:
    """NaN and both infinities become NULL, the only kind of missing the engine knows."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def known(df: DataFrame) -> DataFrame:
    """``df`` with NaN and infinities of its DOUBLE and FLOAT columns as NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns({c: norm_missing(F.col(f"`{c}`")).cast(t) for c, t in kinds.items()}) if kinds else df


def row_mean(*cols: str | Column) -> Column:
    """Mean over columns; missing as soon as one of them is."""
    return reduce(lambda a, b: a + b, [col(c) for c in cols]) / F.lit(float(len(cols)))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, missing for a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def relative_bias(pred: str | Column, ref: str | Column) -> Column:
    return safe_ratio(col(pred) - col(ref), ref)


def log_volume(v: str | Column) -> Column:
    return F.log10(F.lit(1.0) + col(v))


def log_millilitres(v: str | Column) -> Column:
    """log10 of a voxel count in millilitres (1 mm voxels); missing unless positive."""
    v = col(v)
    return F.when(v > 0, F.log10(v / F.lit(1000.0)))


def flag(condition: Column) -> Column:
    """A comparison where missing counts as False."""
    return F.coalesce(condition, F.lit(False))


def below(c: str | Column, t: float) -> Column:
    return flag(col(c) < F.lit(t))


def float_gt(p: str | Column, t: float | Column) -> Column:
    """Strict threshold in single precision: the threshold is rounded to FLOAT before comparing. NaN is above nothing."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    return (col(p) > t.cast("float")) & ~F.isnan(col(p))


def case_id(path: str | Column) -> Column:
    """File name without the volume suffix, or without its last extension."""
    name = F.element_at(F.split(col(path), "/"), -1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.lit(len(VOLUME_SUFFIX)))
    return F.when(name.endswith(VOLUME_SUFFIX), stem).otherwise(
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    )


def recode(c: str | Column, mapping: dict[str, str], default: str) -> Column:
    """Dictionary recode of a code column; the dictionary is a fixed, in-code constant."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(c)), F.lit(default))


def domain_of(code: str | Column) -> Column:
    """Display name of a case's group code: a case without a code is in the unknown group, a code without a name in
    the unknown domain."""
    return recode(F.coalesce(col(code), F.lit(UNKNOWN_GROUP)), DOMAIN_NAMES, UNKNOWN_DOMAIN)


def any_bit(bits: str | Column, k: int) -> Column:
    """Is bit ``k`` of a mask set?"""
    return col(bits).bitwiseAND(F.lit(1 << k)) != 0


def pack_bits(flags: list[Column]) -> Column:
    """Boolean columns -> one BIGINT mask, first flag in bit 0; missing counts as False."""
    if not 0 < len(flags) < 63:
        raise ValueError("between 1 and 62 flags fit one mask")
    terms = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, f in enumerate(flags)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)
