"""Ordered operators on groups of any size: average ranks, positions, running minima, quantiles.

A window over one group sorts that group in one task, and the exact percentile aggregate holds all
distinct values of a group in one buffer. Both fail when one group has a third of all rows. The input is
therefore stored and counted first. Up to ``SMALL_ROWS`` rows in all, a plain window or ``percentile`` is
the best plan. Beyond that the rows are range-partitioned by (group, value, tie-break), so a large group
is spread over many pieces; windows run inside a (group, piece), and per-piece totals -- at most one row
per group and partition -- carry positions and ties from piece to piece. Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lesionlens.functions.scalars import norm_missing
from lesionlens.operators.lookup import null_safe_join
from lesionlens.session import materialize

SMALL_ROWS = 1_000_000
PIECE = "_piece"
UP = Window.unboundedPreceding
DOWN = Window.unboundedFollowing


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def stored(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` and a bound on its number of rows; stored and counted unless the caller knows the bound."""
    if rows is not None:
        return df, rows
    df = materialize(df, "rows")
    return df, df.count()


def _pieces(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partition by ``keys`` and fix the partition number as a column.

    The result is written, so that all its readers see the same ranges even if executors are lost.
    """
    ranged = df.repartitionByRange(*keys).withColumn(PIECE, F.spark_partition_id())
    return materialize(ranged, "ranged")


def _upto_and_same(df: DataFrame, part: list[str], value: str, w: Column, weighted: bool) -> DataFrame:
    """Weight up to and including a row's value, and of the value itself, inside ``part``."""
    along = Window.partitionBy(*part).orderBy(value)
    df = df.withColumn("_upto", F.sum(w).over(along.rangeBetween(UP, 0)))
    if weighted:
        return df.withColumn("_same", F.sum(w).over(Window.partitionBy(*part, value)))
    return df.withColumn("_same", F.col("_upto") - F.rank().over(along) + 1)


def ranked(
    df: DataFrame,
    by: list[str],
    value: str,
    tiebreak: list[str] = (),
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``before``, ``ties`` and ``total`` to every row with a value.

    ``before`` is the weight of the rows of the group with a smaller value, ``ties`` the weight of
    those with the same value (itself included), ``total`` the weight of the group. Rows with a NULL
    value are dropped. ``tiebreak`` columns only spread equal values over partitions, they do not
    influence the result; NULL is a group like any other. ``rows`` is a known bound on the number of
    rows of a ``df`` that is already stored or cheap to read twice.
    """
    df, group = _grouped(df.where(F.col(value).isNotNull()), list(by))
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    weighted = weight is not None
    df, n = stored(df, rows)
    if n <= SMALL_ROWS:
        return (
            _upto_and_same(df, group, value, w, weighted)
            .withColumn("total", F.sum(w).over(Window.partitionBy(*group)))
            .withColumn("before", F.col("_upto") - F.col("_same"))
            .withColumn("ties", F.col("_same"))
            .drop("_all", "_upto", "_same")
        )

    pieces = _pieces(df, [*group, value, *tiebreak])
    local = _upto_and_same(pieces, [*group, PIECE], value, w, weighted)
    # one row per (group, piece): weight and the two edge values, the only ones shared with neighbours
    edges = (
        pieces.groupBy(*group, PIECE, F.col(value).alias("_v"))
        .agg(F.sum(w).alias("_n"))
        .groupBy(*group, PIECE)
        .agg(
            F.sum("_n").alias("_w"),
            F.min(F.struct("_v", "_n")).alias("_lo"),
            F.max(F.struct("_v", "_n")).alias("_hi"),
        )
    )
    along = Window.partitionBy(*group).orderBy(PIECE)
    same = Window.partitionBy(*group, "_e._v").orderBy(PIECE)
    zero = F.lit(0)
    carry = (
        edges.withColumn("_prior", F.coalesce(F.sum("_w").over(along.rowsBetween(UP, -1)), zero))
        .withColumn("_total", F.sum("_w").over(Window.partitionBy(*group)))
        .withColumn("_e", F.explode(F.array_distinct(F.array("_lo", "_hi"))))
        .withColumn("_earlier", F.coalesce(F.sum("_e._n").over(same.rowsBetween(UP, -1)), zero))
        .withColumn("_later", F.coalesce(F.sum("_e._n").over(same.rowsBetween(1, DOWN)), zero))
        .groupBy(*group, PIECE)
        .agg(
            F.first("_prior").alias("_prior"),
            F.first("_total").alias("_total"),
            F.first("_lo._v").alias("_vlo"),
            F.first("_hi._v").alias("_vhi"),
            F.max(F.when(F.col("_e._v") == F.col("_lo._v"), F.col("_earlier"))).alias("_earlier"),
            F.max(F.when(F.col("_e._v") == F.col("_hi._v"), F.col("_later"))).alias("_later"),
        )
    )
    at_lo = F.when(F.col(value) == F.col("_vlo"), F.col("_earlier")).otherwise(zero)
    at_hi = F.when(F.col(value) == F.col("_vhi"), F.col("_later")).otherwise(zero)
    return (
        null_safe_join(local, carry, [*group, PIECE])
        .withColumn("total", F.col("_total"))
        .withColumn("before", F.col("_prior") - at_lo + F.col("_upto") - F.col("_same"))
        .withColumn("ties", F.col("_same") + at_lo + at_hi)
        .drop(
            PIECE, "_all", "_upto", "_same", "_prior", "_total", "_vlo", "_vhi", "_earlier", "_later"
        )
    )


def average_rank(
    df: DataFrame,
    by: list[str],
    value: str,
    tiebreak: list[str] = (),
    weight: str | None = None,
    out: str = "avg_rank",
    rows: int | None = None,
) -> DataFrame:
    """Ranks 1..n per group, equal values sharing the mean rank; frequency-weighted with ``weight``."""
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    return ranked(df, by, value, tiebreak, weight, rows).withColumn(out, rank).drop("before", "ties", "total")


def row_position(
    df: DataFrame, by: list[str], order: str, out: str = "ordinal", rows: int | None = None
) -> DataFrame:
    """1-based position of each row in its group by a unique ``order`` column, plus group size ``n``."""
    return (
        ranked(df, by, order, rows=rows)
        .withColumn(out, (F.col("before") + 1).cast("bigint"))
        .withColumnRenamed("total", "n")
        .drop("before", "ties")
    )


def suffix_min(
    df: DataFrame, by: list[str], order: list[str], value: str, out: str = "suffix_min", rows: int | None = None
) -> DataFrame:
    """Per row the minimum of ``value`` over its group from this row on, in the order of ``order``.

    ``order`` must be unique per group: rows before a row do not count, even with equal first column.
    """
    df, group = _grouped(df, list(by))
    df, n = stored(df, rows)
    down = [F.col(c).desc() for c in order]
    if n <= SMALL_ROWS:
        whole = Window.partitionBy(*group).orderBy(*down).rowsBetween(UP, 0)
        return df.withColumn(out, F.min(value).over(whole)).drop("_all")
    pieces = _pieces(df, [*group, *order])
    inside = Window.partitionBy(*group, PIECE).orderBy(*down).rowsBetween(UP, 0)
    later = Window.partitionBy(*group).orderBy(F.col(PIECE).desc()).rowsBetween(UP, -1)
    carry = (
        pieces.groupBy(*group, PIECE)
        .agg(F.min(value).alias("_min"))
        .withColumn("_after", F.min("_min").over(later))
        .drop("_min")
    )
    return (
        pieces.withColumn("_here", F.min(value).over(inside))
        .transform(null_safe_join, carry, [*group, PIECE])
        .withColumn(out, F.least("_here", "_after"))
        .drop(PIECE, "_all", "_here", "_after")
    )


def quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probabilities: dict[str, float],
    tiebreak: list[str] = (),
    count: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: one column per entry of ``probabilities``.

    A quantile needs the values at two positions; they are picked by position out of the ranked rows.
    NaN and infinities are missing values; groups without a value are absent. ``count`` names a column for the group size.
    """
    names, qs = list(probabilities), [float(q) for q in probabilities.values()]
    extra = [c for c in dict.fromkeys(tiebreak) if c not in (*by, value)]
    df = df.select(*by, norm_missing(value).alias(value), *extra).where(F.col(value).isNotNull())
    df, n = stored(df, rows)
    keep = [F.col(count)] if count else []
    if n <= SMALL_ROWS:
        aggs = [F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("_q")]
        if count:
            aggs.append(F.count(value).alias(count))
        picked = df.groupBy(*by).agg(*aggs)
        if not by:
            picked = picked.where(F.col("_q").isNotNull())
        return picked.select(*by, *keep, *[F.col("_q")[k].alias(n) for k, n in enumerate(names)])

    aggs, outs, wanted = [], [], F.lit(False)
    first, last = F.col("before"), F.col("before") + F.col("ties")
    for k, (name, q) in enumerate(zip(names, qs)):
        at = (F.col("total") - 1) * F.lit(q)
        low, high = F.floor(at), F.ceil(at)
        hit_low = (first <= low) & (low < last)
        hit_high = (first <= high) & (high < last)
        wanted = wanted | hit_low | hit_high
        aggs += [
            F.max(F.when(hit_low, F.col(value))).alias(f"_l{k}"),
            F.max(F.when(hit_high, F.col(value))).alias(f"_h{k}"),
            F.max(at - low).alias(f"_f{k}"),
        ]
        outs.append((F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).alias(name))
    if count:
        aggs.append(F.max("total").alias(count))
    picked = ranked(df, by, value, extra, rows=n).where(wanted).groupBy(*by).agg(*aggs)
    return picked.select(*by, *keep, *outs)
