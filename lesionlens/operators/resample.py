"""Deterministic bootstrap resampling that does not depend on partitioning, by one definition for groups of any size.

Rows of a group are numbered from 0 in the order of a unique column and cut into chunks of ``CHUNK`` rows. A
replicate b of a group of n rows sends each of its n draws i to the chunk of row

    r = (h(b, i, salt + ROUTE[0]) * 2147483647 + h(b, i, salt + ROUTE[1])) mod n

and the j-th draw that a chunk receives takes, of its m rows, row

    h(b, j, salt + chunk * STEP) mod m

    h1 = (b*7919 + i*104729 + salt) mod 2147483647
    h2 = (h1*h1 + 12345) mod 2147483647
    h  = (h2*48271 + b) mod 2147483647               (b: replicate from 1, i and j: draws from 1)

All of a group of one chunk is routed to it, so only its second step is computed. Routing depends on n alone: it is a stage of its own, a task for
some replicates of one size, and gives the draws of each chunk; then a chunk is one task group, however large its group is.
The work of both stages is the number of draws. Only sums per (chunk, replicate) leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.functions.fixed import INTERVAL, REPLICATES, REPLICATES_SHORT, SEED
from lesionlens.functions.scalars import norm_missing, row_mean
from lesionlens.operators.lookup import null_safe_join, with_scalars
from lesionlens.operators.ordered import quantiles, row_position, stored

CHUNK = 32_768
MODULUS = 2_147_483_647
STEP = 32_452_843
ROUTE = (49_979_687, 67_867_967)
SECOND_SALT = 15_485_863  # prime, not a multiple of the draw step 104729
BLOCK_CELLS = 1 << 15  # draws made at a time: a few arrays of that length stay in a core's cache
TASK_DRAWS = 1 << 27  # draws routed at a time by a task, for groups below that size
TASKS, TASKS_OF_CHUNK = 64, 20  # tasks that small inputs are dealt to, and of them those of one chunk


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Bring unsigned x below 2**62 under 2**32 in place, keeping its remainder by MODULUS, a Mersenne prime."""
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_and(x, np.uint64(MODULUS), out=x)
    np.add(x, spare, out=x)


def _hash(b: np.ndarray, i: np.ndarray, salt: int) -> np.ndarray:
    """h for replicates ``b`` (column) and draw numbers ``i`` (row), in passes over one array; only the last is reduced in full."""
    b = b.astype(np.uint64)[:, None]
    x = b * np.uint64(7919) + np.uint64(salt) + (i.astype(np.uint64) * np.uint64(104729))[None, :]
    spare = np.empty_like(x)
    _fold(x, spare)
    np.multiply(x, x, out=x)
    np.add(x, np.uint64(12345), out=x)
    _fold(x, spare)
    np.multiply(x, np.uint64(48271), out=x)
    np.add(x, b, out=x)
    _fold(x, spare)  # below 2 * MODULUS: one difference is left, which wraps around where it must not be taken
    np.subtract(x, np.uint64(MODULUS), out=spare)
    return np.minimum(x, spare, out=x)


def _mod(x: np.ndarray, n: int) -> np.ndarray:
    """x mod n for one n: numpy divides by a scalar faster than it takes remainders."""
    if n & (n - 1) == 0:
        return np.bitwise_and(x, np.uint64(n - 1))
    q = np.floor_divide(x, np.uint64(n))
    np.multiply(q, np.uint64(n), out=q)
    return np.subtract(x, q, out=q)


def draws(b: np.ndarray, i: np.ndarray, n: int, salt: int) -> np.ndarray:
    """0-based draws from n rows for replicates ``b`` (column) and draw numbers ``i`` (row)."""
    return _mod(_hash(b, i, salt), n).view(np.int64)


def _routed_sizes(b: int, sizes: list[int], salt: int, size: int) -> list[np.ndarray]:
    """For one replicate and each group size, how many draws go to each chunk; the draws' numbers are made once for all sizes."""
    out = [np.zeros(-(-n // size), np.int64) for n in sizes]
    for start in range(1, max(sizes) + 1, BLOCK_CELLS):
        i = np.arange(start, min(start + BLOCK_CELLS, max(sizes) + 1))
        high, low = (_hash(np.array([b]), i, salt + s)[0] for s in ROUTE)
        high *= np.uint64(MODULUS)
        high += low
        for n, total in zip(sizes, out):
            if n >= start:
                to = _mod(high[: n - start + 1], n)
                total += np.bincount(np.floor_divide(to, np.uint64(size)).view(np.int64), minlength=len(total))
    return out


def routed(b: np.ndarray, n: int, salt: int, size: int = CHUNK) -> np.ndarray:
    """(replicates, chunks): how many of its n draws each replicate sends to each chunk of ``size`` rows."""
    if n <= size:
        return np.full((len(b), 1), n)
    return np.stack([_routed_sizes(int(k), [n], salt, size)[0] for k in b])


def _blocks(taken: np.ndarray) -> Iterator[slice]:
    step = max(1, BLOCK_CELLS // max(int(taken.max(initial=1)), 1))
    yield from (slice(at, at + step) for at in range(0, len(taken), step))


def _drawn(b: np.ndarray, taken: np.ndarray, rows: int, chunk: int, salt: int) -> tuple[np.ndarray, np.ndarray | None]:
    """:func:`chunk_draws` with None for ``valid`` where all columns are draws, as in blocks of one replicate."""
    i = np.arange(1, int(taken.max(initial=0)) + 1)
    valid = None if (taken == len(i)).all() else i[None, :] <= taken[:, None]
    return draws(b, i, rows, salt + chunk * STEP), valid


def chunk_draws(b: np.ndarray, taken: np.ndarray, rows: int, chunk: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws, valid): the rows of a chunk that replicates take, and which of a replicate's columns are draws."""
    picked, valid = _drawn(b, taken, rows, chunk, salt)
    return picked, np.ones(picked.shape, bool) if valid is None else valid


def chunk_multiplicities(
    n: int, chunk: int, replicates: int, salt: int, size: int = CHUNK, only: np.ndarray | None = None,
    taken: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (replicate numbers, how often each row of the chunk is drawn in each of them).

    ``only`` restricts the replicates 1..``replicates`` to some of them; ``taken`` are their draws in this chunk, if known.
    """
    numbers = np.arange(1, replicates + 1) if only is None else only
    taken = routed(numbers, n, salt, size)[:, chunk] if taken is None else taken
    mine = min(size, n - chunk * size)
    for part in _blocks(taken):
        picked, valid = _drawn(numbers[part], taken[part], mine, chunk, salt)
        flat = picked + (np.arange(len(picked)) * mine)[:, None]
        flat = flat.ravel() if valid is None else flat[valid]
        yield numbers[part], np.bincount(flat, minlength=len(picked) * mine).reshape(len(picked), mine)


def _chunked(df: DataFrame, by: list[str], order: str, rows: int | None, size: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with their unit, group sizes, group columns). A unit is a chunk, or as many small ones as make up ``CHUNK`` rows."""
    group = list(by) or ["_one"]
    if not by:
        df = df.withColumn("_one", F.lit(0))
    placed = row_position(df, group, order, "_ordinal", rows)
    sizes = df.groupBy(*[F.col(g).alias(g) for g in group]).agg(F.count(F.lit(1)).alias("n"))
    return placed.withColumn("_unit", F.floor((F.col("_ordinal") - 1) / F.lit(size * _per_unit(size))).cast("int")), sizes, group


def _per_unit(size: int) -> int:
    return max(1, CHUNK // size)


def _routes(sizes: DataFrame, replicates: int, salt: int, size: int, parts: int) -> DataFrame:
    """(n, _unit, replicate, taken) of every group size above one chunk: the routing stage, ``taken`` by chunk of the unit.

    Sizes of one order of magnitude share the draws' numbers. What a task costs does not show in the size of its rows, hence a fixed
    number of partitions that adaptive execution leaves alone.
    """
    alike = sizes.where(F.col("n") > size).groupBy(F.floor(F.log2("n"))).agg(F.sort_array(F.collect_set("n")).alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("bigint"), lambda a, n: a + n)
    block = F.greatest(F.lit(1), F.least(F.lit(100), F.floor(F.lit(TASK_DRAWS) / total))).cast("int")
    units = alike.select("ns", block.alias("block"))
    units = units.select("ns", "block", F.explode(F.sequence(F.lit(1), F.lit(replicates), F.col("block"))).alias("first"))
    per = _per_unit(size)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ns, width, first in zip(pdf["ns"], pdf["block"].tolist(), pdf["first"].tolist()):
                ns = [int(n) for n in ns]
                b = range(first, min(first + width, replicates + 1))
                taken = [_routed_sizes(k, ns, salt, size) for k in b]
                for at, n in enumerate(ns):
                    of_unit = [t[at][u : u + per] for t in taken for u in range(0, len(t[at]), per)]
                    units_of = len(of_unit) // len(b)
                    yield pd.DataFrame({"n": n, "_unit": np.tile(np.arange(units_of, dtype="int32"), len(b)), "replicate": np.repeat(np.array(b, "int32"), units_of), "taken": of_unit})

    return units.repartition(parts).mapInPandas(kernel, "n bigint, _unit int, replicate int, taken array<bigint>")


def _by_unit(
    placed: DataFrame, sizes: DataFrame, group: list[str], kernel, schema: T.StructType, replicates: int, salt: int, size: int, rows: int | None,
    width: int | None = None,
) -> DataFrame:
    """``kernel(rows by chunk in order, replicates, draws that the chunks take in each)`` over all units of all groups.

    Few rows make few units but as many draws for each; their replicates are dealt to several tasks then, of ``width`` replicates if that is
    given. Partitions are of a fixed number, because what a task costs does not show in the size of its rows.
    """
    tasks = max(1, min(TASKS_OF_CHUNK, replicates, TASKS * CHUNK // max(rows, 1))) if rows is not None else 1
    width = width or -(-replicates // tasks)
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*group, "_unit", "_task"]
    routes = sizes.where(F.col("n") > size).join(_routes(sizes, replicates, salt, size, parts).withColumnRenamed("n", "_n"), F.col("n") == F.col("_n"))
    routes = routes.withColumn("_task", F.floor((F.col("replicate") - 1) / F.lit(width)).cast("int"))
    placed = placed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // width) - 1))))

    def both(pdf: pd.DataFrame, route: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=schema.names)
        first = 1 + width * int(pdf["_task"].iloc[0])
        b = np.arange(first, min(first + width, replicates + 1))
        pdf = pdf.sort_values("_ordinal").reset_index(drop=True)
        taken = np.full((len(b), 1), len(pdf))
        if len(route):
            taken = np.zeros((len(b), -(-len(pdf) // size)), np.int64)
            taken[route["replicate"].to_numpy() - first] = np.stack(route["taken"].to_numpy())
        return kernel(pdf, b, taken)

    return placed.repartition(parts, *key).groupBy(*key).cogroup(routes.groupBy(*key)).applyInPandas(both, schema)


def _chunks_of(pdf: pd.DataFrame, taken: np.ndarray, size: int, per: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """(number of the chunk, its rows in the unit, draws it takes)."""
    first = int(pdf["_unit"].iloc[0]) * per
    for k in range(taken.shape[1]):
        yield first + k, slice(k * size, min((k + 1) * size, len(pdf))), taken[:, k]


def unit_multiplicities(first: int, rows: int, numbers: np.ndarray, taken: np.ndarray, replicates: int, salt: int, size: int) -> np.ndarray:
    """(rows, replicates): how often each row of a unit, whose first chunk is number ``first``, is drawn in each of the replicates ``numbers``."""
    out = np.empty((rows, len(numbers)), np.int32)
    for k in range(taken.shape[1]):
        at, chunk, done = slice(k * size, min((k + 1) * size, rows)), first + k, 0
        for b, times in chunk_multiplicities(chunk * size + at.stop - at.start, chunk, replicates, salt, size, numbers, taken[:, k]):
            out[at, done : done + len(b)] = times.T
            done += len(b)
    return out


def bootstrap_sums(
    df: DataFrame, by: list[str], values: list[str], order: str, replicates: int, salt: int = SEED,
    rows: int | None = None, size: int = CHUNK,
) -> DataFrame:
    """(by, replicate, sum_<v>, n_<v>): sums over each resample; missing values add to neither."""
    wanted = df.select(*by, order, *[F.col(v).cast("double").alias(v) for v in values])
    placed, sizes, group = _chunked(wanted, by, order, rows, size)
    per = _per_unit(size)
    schema = T.StructType(
        [placed.schema[g] for g in group]
        + [T.StructField("replicate", T.IntegerType())]
        + [T.StructField(f"sum_{v}", T.DoubleType()) for v in values]
        + [T.StructField(f"n_{v}", T.LongType()) for v in values]
    )

    def kernel(pdf: pd.DataFrame, b: np.ndarray, taken: np.ndarray) -> pd.DataFrame:
        table = pdf[values].to_numpy(float)
        known = ~np.isnan(table)
        table = np.where(known, table, 0.0)
        sums, counts = np.zeros((len(b), len(values))), np.zeros((len(b), len(values)), np.int64)
        for chunk, at, draws_of in _chunks_of(pdf, taken, size, per):
            columns = [np.ascontiguousarray(c) for c in table[at].T]
            there = [None if c.all() else c.astype(float) for c in known[at].T]
            for part in _blocks(draws_of):
                picked, valid = _drawn(b[part], draws_of[part], at.stop - at.start, chunk, salt)
                for j, (x, has) in enumerate(zip(columns, there)):
                    drawn = x[picked]
                    sums[part, j] += drawn.sum(axis=1) if valid is None else (drawn * valid).sum(axis=1)
                    if has is None:
                        counts[part, j] += draws_of[part]
                    else:
                        drawn = has[picked]
                        counts[part, j] += (drawn if valid is None else drawn * valid).sum(axis=1).astype(np.int64)
        out = pd.DataFrame({"replicate": b.astype("int32")})
        for j, v in enumerate(values):
            out[f"sum_{v}"], out[f"n_{v}"] = sums[:, j], counts[:, j]
        for g in group:
            out[g] = pdf[g].iloc[0]
        return out[schema.names]

    sums = _by_unit(placed, sizes, group, kernel, schema, replicates, salt, size, rows)
    return sums.groupBy(*by, "replicate").agg(
        *[F.sum(f"sum_{v}").alias(f"sum_{v}") for v in values], *[F.sum(f"n_{v}").alias(f"n_{v}") for v in values]
    )


def bootstrap_weights(
    df: DataFrame, by: list[str], order: str, replicates: int, salt: int = SEED, size: int = CHUNK
) -> DataFrame:
    """Rows of ``df`` once per replicate that draws them, with ``replicate`` and the multiplicity ``w``.

    ``by`` are the strata: every stratum is resampled to its own size.
    """
    placed, sizes, group = _chunked(df, by, order, None, size)
    per = _per_unit(size)
    extra = [T.StructField("replicate", T.IntegerType()), T.StructField("w", T.LongType())]
    schema = T.StructType([f for f in df.schema.fields] + extra)
    columns = df.columns

    def kernel(pdf: pd.DataFrame, numbers: np.ndarray, taken: np.ndarray) -> pd.DataFrame:
        parts = []
        for chunk, at, draws_of in _chunks_of(pdf, taken, size, per):
            for b, times in chunk_multiplicities(chunk * size + at.stop - at.start, chunk, replicates, salt, size, numbers, draws_of):
                r, c = np.nonzero(times)
                parts.append(pdf[columns].iloc[at].iloc[c].assign(replicate=b[r].astype("int32"), w=times[r, c]))
        return pd.concat(parts, ignore_index=True)[schema.names]

    return _by_unit(placed, sizes, group, kernel, schema, replicates, salt, size, None)


def percentile_interval(
    samples: DataFrame, by: list[str], value: str | Column, level: tuple[float, float] = INTERVAL
) -> DataFrame:
    """(by, ci_low, ci_high) of a statistic over replicates; a group has as many rows as replicates."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        samples.groupBy(*by)
        .agg(F.percentile(value, F.array(*[F.lit(q) for q in level])).alias("_q"))
        .select(*by, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"))
    )


def _mean(v: str) -> Column:
    return F.try_divide(F.col(f"sum_{v}"), F.col(f"n_{v}").cast("double"))


def _join(a: DataFrame, b: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    return null_safe_join(a, b, by, how) if by else with_scalars(a, b)  # one row each without groups


def bootstrap_mean(
    df: DataFrame, value: str, by: list[str], order: str, replicates: int = REPLICATES_SHORT, salt: int = SEED
) -> DataFrame:
    """(by, n, mean, ci_low, ci_high) of the finite values; a group without any has n 0 and is missing."""
    clean, n = stored(df.select(*by, order, norm_missing(value).alias("_v")))
    known = clean.where(F.col("_v").isNotNull())
    point = clean.groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"))
    ci = percentile_interval(bootstrap_sums(known, by, ["_v"], order, replicates, salt, n), by, _mean("_v"))
    return _join(point, ci, by)


def bootstrap_paired(
    df: DataFrame, left: str, right: str, by: list[str], order: str, replicates: int = REPLICATES, salt: int = SEED,
    size: int = CHUNK,
) -> DataFrame:
    """Mean and median of left - right over pairs with both sides finite, with a percentile interval.

    ``n_dropped_left`` / ``n_dropped_right`` count pairs where only that side is missing.
    """
    clean = df.select(*by, order, norm_missing(left).alias("_l"), norm_missing(right).alias("_r")).withColumn(
        "_d", F.col("_l") - F.col("_r")
    )
    clean, n = stored(clean)
    pairs = clean.where(F.col("_d").isNotNull())
    lost_l = F.col("_l").isNull() & F.col("_r").isNotNull()
    lost_r = F.col("_r").isNull() & F.col("_l").isNotNull()
    both = F.col("_d").isNotNull()
    point = clean.groupBy(*by).agg(
        F.count("_d").alias("n"),
        F.avg(F.when(both, F.col("_l"))).alias("left_mean"),
        F.avg(F.when(both, F.col("_r"))).alias("right_mean"),
        F.avg("_d").alias("mean_difference"),
        F.count_if(lost_l).alias("n_dropped_left"),
        F.count_if(lost_r).alias("n_dropped_right"),
    )
    middle = quantiles(pairs, by, "_d", {"median_difference": 0.5}, [order], rows=n)
    ci = percentile_interval(bootstrap_sums(pairs, by, ["_d"], order, replicates, salt, n, size), by, _mean("_d"))
    return _join(_join(point, middle, by), ci, by)


def bootstrap_independent(
    target: DataFrame, source: DataFrame, value: str, by: list[str], order: str,
    replicates: int = REPLICATES, salt: int = SEED,
) -> DataFrame:
    """Difference of two independent means (target - source), each side resampled on its own."""
    sides = {}
    for name, df, s in (("target", target, salt), ("source", source, salt + SECOND_SALT)):
        known, n = stored(df.select(*by, order, norm_missing(value).alias("_v")).where(F.col("_v").isNotNull()))
        point = known.groupBy(*by).agg(F.count("_v").alias(f"n_{name}"), F.avg("_v").alias(f"{name}_mean"))
        sums = bootstrap_sums(known, by, ["_v"], order, replicates, s, n)
        sides[name] = point, sums.select(*by, "replicate", _mean("_v").alias(f"_{name}"))
    samples = null_safe_join(sides["target"][1], sides["source"][1], [*by, "replicate"])
    ci = percentile_interval(samples, by, F.col("_target") - F.col("_source"))
    point = _join(sides["target"][0], sides["source"][0], by, "inner").withColumn(
        "mean_difference", F.col("target_mean") - F.col("source_mean")
    )
    return _join(point, ci, by)


def bootstrap_region_mean(
    target: DataFrame, source: DataFrame, values: list[str], order: str,
    replicates: int = REPLICATES, salt: int = SEED,
) -> DataFrame:
    """One row: difference of the means of the regions' means; regions of a case are drawn together."""
    sides = {}
    for name, df, s in (("target", target, salt), ("source", source, salt + SECOND_SALT)):
        clean, n = stored(df.select(order, *[norm_missing(v).alias(v) for v in values]))
        point = clean.agg(F.count(F.lit(1)).alias(f"n_{name}"), row_mean(*[F.avg(v) for v in values]).alias(f"{name}_mean"))
        sums = bootstrap_sums(clean, [], values, order, replicates, s, n)
        sides[name] = point, sums.select("replicate", row_mean(*[_mean(v) for v in values]).alias(f"_{name}"))
    samples = sides["target"][1].join(sides["source"][1], ["replicate"])
    ci = percentile_interval(samples, [], F.col("_target") - F.col("_source"))
    point = _join(sides["target"][0], sides["source"][0], []).withColumn(
        "mean_difference", F.col("target_mean") - F.col("source_mean")
    )
    return _join(point, ci, [])
