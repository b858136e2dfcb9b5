"""Rank statistics and tests on case tables of any size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.functions.fixed import FAILURE_PERCENTILES, REPLICATES_SHORT, SEED
from lesionlens.functions.scalars import norm_missing
from lesionlens.functions.tails import chi2_p_value, correlation_p_value, normal_p_value
from lesionlens.operators.ordered import quantiles, ranked, stored, suffix_min
from lesionlens.operators.resample import (
    CHUNK, _by_unit, _chunked, _per_unit, _routed_sizes, chunk_multiplicities, percentile_interval, unit_multiplicities,
)
from lesionlens.session import materialize

SINGULAR = 1e-12
BLOCK_ROWS = 8_000_000  # cases that a task may hold: about 200 bytes each, whatever the number of replicates
BLOCK_TASKS = 64
VECTOR = 100  # replicates whose weights of one value travel as one vector
PIECE_ROWS = 32_768  # vectors that a piece of the sorted values holds, about


def _long(df: DataFrame, keep: list, columns: list[str], name: str, value: str = "_v") -> DataFrame:
    """One row per column and row, missing values left out."""
    items = F.array(*[F.struct(F.lit(c).alias(name), norm_missing(c).alias(value)) for c in columns])
    return df.select(*keep, F.inline(items)).where(F.col(value).isNotNull())


def centred_rank(weighted: bool = False) -> Column:
    """Average rank minus the mean of all ranks, from the columns of :func:`ranked`."""
    return F.col("before") + (F.col("ties") - F.col("total")) / F.lit(2.0)


def pearson(df: DataFrame, x: str, y: str, by: list[str], p_value: bool = True) -> DataFrame:
    """(by, n, r[, p_value]) over complete pairs; missing for a constant column."""
    pairs = df.select(*by, norm_missing(x).alias("_x"), norm_missing(y).alias("_y")).dropna(subset=["_x", "_y"])
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r"),
    )
    return out.withColumn("p_value", correlation_p_value(F.col("r"), F.col("n") - 2)) if p_value else out


def _missing_patterns(df: DataFrame, columns: list[str], row: str) -> dict[str, tuple]:
    """For each column a key of the set of rows it is missing in; columns with the same set have the same key."""
    mark = F.xxhash64(row).cast("decimal(20,0)")
    one = df.agg(*[F.struct(F.count_if(F.col(c).isNull()), F.sum(F.when(F.col(c).isNull(), mark)), F.bit_xor(F.when(F.col(c).isNull(), F.xxhash64(F.lit(1), row)))).alias(c) for c in columns]).first()
    return {c: tuple(one[c]) for c in columns}


def spearman(
    df: DataFrame, features: list[str], outcomes: list[str], case: str = "case_id", p_value: bool = True
) -> DataFrame:
    """(feature, outcome, n, rho[, p_value]) for all feature x outcome pairs, pairwise deletion.

    A column is ranked once for each pattern of missing rows among its partners, not for each partner: without missing values a
    case is one row for each column. The ranks of a case meet again, and all correlations are sums of one aggregation.
    """
    columns = list(dict.fromkeys([*features, *outcomes]))
    base, n = stored(df.select(F.monotonically_increasing_id().alias("_row"), *[norm_missing(c).alias(c) for c in columns]))
    patterns = _missing_patterns(base, columns, "_row")
    number = {p: k for k, p in enumerate(dict.fromkeys(patterns.values()))}
    place = {c: number[p] for c, p in patterns.items()}
    shown = {k: c for c, k in reversed(place.items())}  # a column with that pattern
    due = dict.fromkeys([(f, place[o]) for f in features for o in outcomes] + [(o, place[f]) for f in features for o in outcomes])
    name = {(c, k): f"{columns.index(c)}/{k}" for c, k in due}
    items = F.array(*[F.struct(F.lit(name[c, k]).alias("_key"), F.when(F.col(shown[k]).isNotNull(), F.col(c)).alias("_v")) for c, k in due])
    rows, n = stored(base.select("_row", F.inline(items)).where(F.col("_v").isNotNull()))
    rows = ranked(rows, ["_key"], "_v", ["_row"], rows=n).select("_row", "_key", centred_rank().alias("_c"))
    cases = rows.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_c"))).alias("_ranks"))
    rank = lambda c, k: F.try_element_at("_ranks", F.lit(name[c, k]))
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(o).alias("outcome"), rank(f, place[o]).alias("_rx"), rank(o, place[f]).alias("_ry"))
        for f in features for o in outcomes
    ])
    out = cases.select(F.inline(pairs)).where("_rx is not null and _ry is not null").groupBy("feature", "outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(
            F.sum(F.col("_rx") * F.col("_ry")), F.sqrt(F.sum(F.pow("_rx", F.lit(2))) * F.sum(F.pow("_ry", F.lit(2))))
        ).alias("rho"),
    )
    return out.withColumn("p_value", correlation_p_value(F.col("rho"), F.col("n") - 2)) if p_value else out


def _condition(df: DataFrame, variables: int) -> DataFrame:
    """Add p<j>_<a>_<b>, the correlation of a and b given the first j controls (variables 2, 3, ...).

    One projection per control, so that no expression is written out more than once.
    """
    for j in range(variables - 2):
        z, left = 2 + j, [0, 1, *range(3 + j, variables)]
        r = {v: F.col(f"p{j}_{min(v, z)}_{max(v, z)}") for v in left}
        free = {v: 1 - r[v] * r[v] for v in left}
        df = df.withColumns({
            f"p{j + 1}_{a}_{b}": F.when(
                (free[a] >= SINGULAR) & (free[b] >= SINGULAR),
                (F.col(f"p{j}_{a}_{b}") - r[a] * r[b]) / F.sqrt(free[a] * free[b]),
            )
            for a, b in combinations(left, 2)
        })
    return df


def _partial_rho(df: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], case: str) -> DataFrame:
    """(label, n, n_controls, partial_rho) over complete rows."""
    variables = {h[0]: [h[1], h[2], *h[3]] for h in hypotheses}
    most = max(len(v) for v in variables.values())
    stacked = []
    for label, cols in variables.items():
        complete = F.lit(True)
        for c in cols:
            complete = complete & norm_missing(c).isNotNull()
        stacked += [
            F.when(complete, F.struct(F.lit(label).alias("label"), F.lit(k).alias("_k"), norm_missing(c).alias("_v")))
            for k, c in enumerate(cols)
        ]
    rows = df.select(case, F.inline(F.array_compact(F.array(*stacked))))
    rows = ranked(rows, ["label", "_k"], "_v", [case]).withColumn("_c", centred_rank())
    wide = rows.groupBy("label", case).agg(*[F.max(F.when(F.col("_k") == k, F.col("_c"))).alias(f"_c{k}") for k in range(most)])
    sums = wide.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"_c{a}") * F.col(f"_c{b}")).alias(f"_s{a}_{b}") for a, b in combinations_with_replacement(range(most), 2)],
    )
    return _rho_of_sums(sums, ["label"], variables)


def _rho_of_sums(sums: DataFrame, key: list[str], variables: dict[str, list[str]]) -> DataFrame:
    """(key, n, n_controls, partial_rho) from the sums of products of centred ranks, ``_s<a>_<b>`` with a <= b."""
    most = max(len(v) for v in variables.values())
    r = sums.withColumns({
        f"p0_{a}_{b}": F.try_divide(F.col(f"_s{a}_{b}"), F.sqrt(F.col(f"_s{a}_{a}")) * F.sqrt(F.col(f"_s{b}_{b}")))
        for a, b in combinations(range(most), 2)
    })
    given = F.create_map(*[F.lit(v) for label, cols in variables.items() for v in (label, len(cols) - 2)])
    r = _condition(r, most).withColumn("n_controls", F.element_at(given, F.col("label")))
    rho = F.coalesce(*[F.when(F.col("n_controls") == j, F.col(f"p{j}_0_1")) for j in range(most - 1)])
    return r.select(*key, "n", "n_controls", rho.alias("partial_rho"))


def partial_spearman(
    df: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], case: str = "case_id",
    dof: str = "reference", p_value: bool = True,
) -> DataFrame:
    """(label, feature, outcome, controls, n, partial_rho[, p_value]) over complete rows per hypothesis.

    ``dof="reference"`` uses n - 2 degrees of freedom, ``"adjusted"`` n - 2 - number of controls.
    Collinear controls give a missing value.
    """
    out = _partial_rho(df, hypotheses, case)
    names = F.array(*[
        F.struct(F.lit(h[0]).alias("label"), F.lit(h[1]).alias("feature"), F.lit(h[2]).alias("outcome"),
                 F.lit(",".join(h[3])).alias("controls"))
        for h in hypotheses
    ])
    named = df.sparkSession.range(1).select(F.inline(names))
    out = out.join(F.broadcast(named), "label").select(
        "label", "feature", "outcome", "controls", "n", "partial_rho", "n_controls"
    )
    if p_value:
        free = F.col("n") - 2 - (F.col("n_controls") if dof == "adjusted" else F.lit(0))
        out = out.withColumn("p_value", correlation_p_value(F.col("partial_rho"), free))
    return out.drop("n_controls")


def bootstrap_partial_spearman(
    df: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], strata: list[str],
    case: str = "case_id", replicates: int = REPLICATES_SHORT, salt: int = SEED, block_rows: int | None = None,
) -> DataFrame:
    """(label, ci_low, ci_high): rows resampled within strata, missing dropped after, ranks anew each time.

    Up to ``block_rows`` cases, by default ``BLOCK_ROWS``, a task takes all of them, as arrays, and its share of the replicates one after the
    other: what moves is the table once for each of ``BLOCK_TASKS``, not a rank for each case, variable and replicate. Beyond that
    vectors over replicates are ranked in pieces of the sorted values and no task sees all cases. Both ways draw the same rows and rank them alike.
    """
    used = list(dict.fromkeys(c for h in hypotheses for c in (h[1], h[2], *h[3])))
    keep, n = stored(df.select(case, *strata, *[norm_missing(c).alias(c) for c in used if c not in strata]))
    if n <= (BLOCK_ROWS if block_rows is None else block_rows):
        samples = _replicate_blocks(keep, hypotheses, strata, case, replicates, salt, n)
    else:
        samples = _replicate_pieces(keep, hypotheses, strata, case, replicates, salt, n)
    return percentile_interval(samples, ["label"], "partial_rho")


def _replicate_blocks(
    keep: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], strata: list[str],
    case: str, replicates: int, salt: int, n: int,
) -> DataFrame:
    """(label, replicate, partial_rho) with the replicates spread over tasks, for a checked number of cases."""
    tasks = max(1, min(replicates, BLOCK_TASKS))
    used = list(dict.fromkeys(c for h in hypotheses for c in (h[1], h[2], *h[3])))
    numbers = keep.select(*strata, case, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_v{k}") for k, c in enumerate(used)])
    placed, _, group = _chunked(numbers, strata, case, n, CHUNK)
    items = F.sort_array(F.collect_list(F.struct("_ordinal", *[f"_v{k}" for k in range(len(used))])))
    packed = placed.groupBy(*group, "_unit").agg(F.first("n").alias("n"), items.alias("_rows"))
    packed = materialize(packed.select("n", "_unit", *[F.col(f"_rows._v{k}").alias(f"_v{k}") for k in range(len(used))]), "packed")
    copies = packed.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    # a fixed number of partitions: what a task costs does not show in the size of its rows
    copies = copies.repartition(min(tasks, int(keep.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_task")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = np.arange(1 + int(pdf["_task"].iloc[0]), replicates + 1, tasks)
        chunks = list(zip(pdf["n"].tolist(), pdf["_unit"].tolist(), [len(v) for v in pdf["_v0"]]))
        x = {c: np.concatenate(pdf[f"_v{k}"].to_numpy()) for k, c in enumerate(used)}
        del pdf
        tests = WeightedRanks(x, hypotheses)
        sizes = sorted({rows for rows, _, _ in chunks})
        rho = {h[0]: np.empty(len(mine)) for h in hypotheses}
        times = np.empty(len(x[used[0]]))
        for k, b in enumerate(mine):
            sent = dict(zip(sizes, _routed_sizes(int(b), sizes, salt, CHUNK)))
            at = 0
            for rows, chunk, length in chunks:
                taken = sent[rows][chunk : chunk + 1]
                for _, t in chunk_multiplicities(rows, chunk, replicates, salt, only=mine[k : k + 1], taken=taken):
                    times[at : at + length] = t[0]
                at += length
            for label, value in tests.partial_rho(times).items():
                rho[label][k] = value
        return pd.concat([pd.DataFrame({"label": h, "replicate": mine.astype("int32"), "partial_rho": v}) for h, v in rho.items()], ignore_index=True)

    return copies.groupBy("_task").applyInPandas(kernel, "label string, replicate int, partial_rho double")


def _replicate_pieces(
    keep: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], strata: list[str],
    case: str, replicates: int, salt: int, n: int,
) -> DataFrame:
    """(label, replicate, n, n_controls, partial_rho) where no task sees all cases.

    A unit of cases tells how often each distinct value is drawn, as a vector over up to ``VECTOR`` replicates. The values of all units are
    sorted into pieces, where running sums of the vectors give the ranks in all replicates at once; these go back to the units as differences
    between the unit's neighbouring values, a byte or two for each replicate. A unit then multiplies ranks for its own rows. So what moves is
    two small vectors for each distinct value of a unit, and nothing for each replicate.
    """
    variables = {h[0]: [h[1], h[2], *h[3]] for h in hypotheses}
    used = list(dict.fromkeys(c for v in variables.values() for c in v))
    place = {c: k for k, c in enumerate(used)}
    pattern = _complete_patterns(keep, variables)
    wanted = list(dict.fromkeys((pattern[h], c) for h, v in variables.items() for c in v))
    complete = {pattern[h]: [place[c] for c in v] for h, v in variables.items()}
    numbers = keep.select(*strata, case, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_v{k}") for k, c in enumerate(used)])
    size, per = CHUNK, _per_unit(CHUNK)
    placed, sizes, group = _chunked(numbers, strata, case, n, size)
    width = min(replicates, VECTOR)
    unit = [placed.schema[g] for g in group] + [T.StructField(c, T.IntegerType()) for c in ("_unit", "_task")]
    keys = [f.name for f in unit]
    binary = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    number = lambda *names: [T.StructField(c, T.IntegerType()) for c in names]
    numbers_of = lambda task: np.arange(1 + width * task, min(width * (task + 1), replicates) + 1)

    def drawn(pdf: pd.DataFrame, b: np.ndarray, taken: np.ndarray) -> pd.DataFrame:
        x = pdf[[f"_v{k}" for k in range(len(used))]].to_numpy(float) + 0.0
        times = unit_multiplicities(int(pdf["_unit"].iloc[0]) * per, len(x), b, taken, replicates, salt, size)
        parts = [pd.DataFrame({"_p": [-1], "_v": [0.0], "_t": [taken.astype(np.int64).tobytes()], "_x": [x.tobytes()]})]
        for at, (k, c) in enumerate(wanted):
            full = ~np.isnan(x[:, complete[k]]).any(axis=1)
            v = x[full, place[c]]
            if len(v):
                order = np.argsort(v, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(v[order]) != 0])
                ties = np.add.reduceat(times[full][order], starts, axis=0, dtype=np.int64)
                parts.append(pd.DataFrame({"_p": at, "_v": v[order][starts], "_t": _vectors(ties), "_x": None}))
        out = pd.concat(parts, ignore_index=True)
        for g in keys:
            out[g] = pdf[g].iloc[0]
        return out[[*keys, "_p", "_v", "_t", "_x"]]

    schema = T.StructType([*unit, *number("_p"), T.StructField("_v", T.DoubleType()), *binary("_t", "_x")])
    tables = materialize(_by_unit(placed, sizes, group, drawn, schema, replicates, salt, size, n, width), "drawn")
    values, order = tables.where("_p >= 0").drop("_x"), ["_p", "_task", "_v"]
    parts = max(1, -(-values.count() // PIECE_ROWS))

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        piece = TaskContext.get().partitionId()
        for (p, task), run in pd.concat(frames, ignore_index=True).groupby(["_p", "_task"]):
            v = run["_v"].to_numpy()
            new = np.r_[True, np.diff(v) != 0]
            ties = np.add.reduceat(_stacked(run["_t"], len(numbers_of(task))), np.flatnonzero(new), axis=0)
            twice = 2 * np.cumsum(ties, axis=0) - ties  # of the weight before a value, and its own once: the mean rank, twice
            row = np.cumsum(new) - 1
            code = run.groupby([*group, "_unit"], dropna=False, sort=False).ngroup().to_numpy()
            by_unit = np.argsort(code, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(code[by_unit]) != 0, True])
            mine = [by_unit[a:z] for a, z in zip(bounds, bounds[1:])]
            out = run[[*keys, "_p"]].iloc[by_unit[bounds[:-1]]].reset_index(drop=True)
            out["_v"] = [v[i].tobytes() for i in mine]
            out["_first"] = [_small(twice[row[i[0]]]).tobytes() for i in mine]
            steps = [_small(np.diff(twice[row[i]], axis=0)) for i in mine]
            out["_bytes"] = [s.itemsize for s in steps]
            out["_t"] = [s.tobytes() for s in steps]
            total = out.iloc[:1].assign(_unit=-1, _v=b"", _t=b"", _first=[ties.sum(axis=0).tobytes()])
            yield pd.concat([out, total], ignore_index=True).assign(_piece=piece)[[*keys, "_p", "_piece", "_bytes", "_v", "_first", "_t"]]

    schema = T.StructType([*unit, *number("_p", "_piece", "_bytes"), *binary("_v", "_first", "_t")])
    pieces = materialize(values.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(running, schema), "pieces")

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_piece")
        here = _stacked(pdf["_first"], len(numbers_of(int(pdf["_task"].iloc[0]))))
        before = np.cumsum(here, axis=0) - here
        return pdf[["_p", "_task", "_piece"]].assign(_shift=[r.tobytes() for r in 2 * before - here.sum(axis=0)])

    totals = pieces.where("_unit < 0").select("_p", "_task", "_piece", "_first")
    shifts = totals.groupBy("_p", "_task").applyInPandas(carried, T.StructType([*number("_p", "_task", "_piece"), *binary("_shift")]))
    there = pieces.where("_unit >= 0").join(shifts, ["_p", "_task", "_piece"]).select(*keys, "_p", "_piece", "_bytes", "_v", "_first", "_t", "_shift")
    none = F.lit(b"")
    own = tables.where("_p < 0").select(
        *keys, "_p", *[F.lit(0).alias(c) for c in ("_piece", "_bytes")], F.col("_x").alias("_v"), none.alias("_first"), "_t", none.alias("_shift")
    )
    most = max(len(v) for v in variables.values())
    pairs = list(combinations_with_replacement(range(most), 2))

    def multiplied(pdf: pd.DataFrame) -> pd.DataFrame:
        b = numbers_of(int(pdf["_task"].iloc[0]))
        pdf = pdf.sort_values(["_p", "_piece"])
        first = pdf.iloc[0]
        x = np.frombuffer(first["_v"]).reshape(-1, len(used))
        taken = np.frombuffer(first["_t"], np.int64).reshape(len(b), -1)
        w = unit_multiplicities(int(first["_unit"]) * per, len(x), b, taken, replicates, salt, size).astype(float)
        centred = {}
        for at, run in pdf.iloc[1:].groupby("_p"):
            k, c = wanted[at]
            known = np.concatenate([np.frombuffer(v) for v in run["_v"]])
            first_of = _stacked(run["_first"], len(b))
            rank = np.concatenate([
                np.cumsum(np.vstack([f + np.frombuffer(s, np.int64), np.frombuffer(t, f"u{step}").reshape(-1, len(b))]), axis=0, dtype=np.int64) / 2.0
                for f, t, s, step in zip(first_of, run["_t"], run["_shift"], run["_bytes"])
            ])
            full = ~np.isnan(x[:, complete[k]]).any(axis=1)
            centred[k, c] = rank, np.searchsorted(known, x[full, place[c]])
        parts, done = [], {}
        for label, columns in variables.items():
            k = pattern[label]
            full = np.flatnonzero(~np.isnan(x[:, complete[k]]).any(axis=1))
            if not len(full):
                continue
            out = pd.DataFrame({"label": label, "replicate": b.astype("int32"), "n": w[full].sum(axis=0).astype(np.int64)})
            for i, j in pairs:
                name = tuple(sorted((columns[i], columns[j]))) if j < len(columns) else None
                if name and (k, name) not in done:
                    done[k, name] = _weighted_products(w, full, *[centred[k, c] for c in name])
                out[f"_s{i}_{j}"] = done[k, name] if name else np.nan
            parts.append(out)
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["label", "replicate", "n", *[f"_s{i}_{j}" for i, j in pairs]])

    schema = "label string, replicate int, n bigint, " + ", ".join(f"_s{i}_{j} double" for i, j in pairs)
    tasks = int(keep.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    products = own.unionByName(there).repartition(tasks, *keys).groupBy(*keys).applyInPandas(multiplied, schema)
    sums = products.groupBy("label", "replicate").agg(F.sum("n").alias("n"), *[F.sum(f"_s{i}_{j}").alias(f"_s{i}_{j}") for i, j in pairs])
    return _rho_of_sums(sums.where("n > 0"), ["label", "replicate"], variables)


def _complete_patterns(df: DataFrame, variables: dict[str, list[str]]) -> dict[str, int]:
    """A number for each label; labels whose complete rows are the same share it."""
    full = {}
    for label, columns in variables.items():
        full[label] = F.lit(True)
        for c in columns:
            full[label] = full[label] & norm_missing(c).isNotNull()
    labels = list(variables)
    apart = [(a, b) for b in range(len(labels)) for a in range(b)]
    counts = df.agg(F.lit(0), *[F.count_if(full[labels[a]] != full[labels[b]]) for a, b in apart]).first()
    same = {pair for pair, c in zip(apart, counts[1:]) if not c}
    return {label: next((a for a in range(b) if (a, b) in same), b) for b, label in enumerate(labels)}


def _small(a: np.ndarray) -> np.ndarray:
    """Counts in the shortest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _vectors(a: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in _small(a)]


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    """Counts of :func:`_vectors`, ``width`` in each, as rows of 64 bits; the length of a vector tells its type."""
    vectors = vectors.to_numpy()
    length = np.array([len(v) for v in vectors])
    out = np.empty((len(vectors), width), np.int64)
    for k in np.unique(length):
        at = np.flatnonzero(length == k)
        out[at] = np.frombuffer(b"".join(vectors[at]), f"u{k // width}").reshape(-1, width)
    return out


def _weighted_products(w: np.ndarray, rows: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per replicate the sum of weight x rank x rank over ``rows``; ranks are given by distinct value, with each row's value."""
    out = np.zeros(w.shape[1])
    for at in range(0, len(rows), 2048):
        part = slice(at, at + 2048)
        out += (w[rows[part]] * a[0][a[1][part]] * b[0][b[1][part]]).sum(axis=0)
    return out


class WeightedRanks:
    """Partial rank correlations of the same rows under many weights: values are sorted once, a weight costs sums by value."""

    def __init__(self, x: dict[str, np.ndarray], hypotheses: list[tuple[str, str, str, tuple[str, ...]]]):
        self.variables = {h[0]: [h[1], h[2], *h[3]] for h in hypotheses}
        self.rows, self.pattern, self.codes = [], {}, {}
        for label, columns in self.variables.items():
            full = ~np.logical_or.reduce([np.isnan(x[c]) for c in columns])
            known = (k for k, other in enumerate(self.rows) if np.array_equal(full, other))
            self.pattern[label] = k = next(known, len(self.rows))
            if k == len(self.rows):
                self.rows.append(full)
            for c in columns:
                if (c, k) not in self.codes:
                    values, code = np.unique(x[c][full], return_inverse=True)
                    self.codes[c, k] = len(values), code.astype(np.int32)

    def partial_rho(self, times: np.ndarray) -> dict[str, float]:
        out = {}
        for k, full in enumerate(self.rows):
            w = times[full]
            centred = {}
            for (c, of), (values, code) in self.codes.items():
                if of == k:
                    ties = np.bincount(code, weights=w, minlength=values)
                    centred[c] = (np.cumsum(ties) - ties + (ties - w.sum()) / 2.0)[code]
            cov = {}
            for label, columns in self.variables.items():
                if self.pattern[label] == k:
                    for pair in combinations_with_replacement(columns, 2):
                        a, b = sorted(pair)
                        if (a, b) not in cov:
                            cov[a, b] = np.array([np.sum(w * centred[a] * centred[b])])
                    size = range(len(columns))
                    out[label] = float(_partial({(a, b): cov[tuple(sorted((columns[a], columns[b])))] for a, b in combinations_with_replacement(size, 2)}, len(columns))[0])
        return out


def weighted_partial_rho(x: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Partial rank correlation of columns 0 and 1 given the others, one value per row of weights."""
    total = times.sum(axis=1, keepdims=True)
    centred = []
    for v in x.T:
        order = np.argsort(v, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(v[order]) != 0])
        ties = np.add.reduceat(times[:, order], starts, axis=1) if len(starts) else times[:, order]
        before = np.cumsum(ties, axis=1) - ties
        of_value = np.searchsorted(v[order][starts], v)
        centred.append((before + (ties - total) / 2.0)[:, of_value])
    k = len(centred)
    return _partial({(a, b): (times * centred[a] * centred[b]).sum(axis=1) for a in range(k) for b in range(a, k)}, k)


def _partial(cov: dict[tuple[int, int], np.ndarray], k: int) -> np.ndarray:
    """Partial correlation of variables 0 and 1 of ``k`` given the others, from sums of products of centred ranks."""
    r = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in combinations(range(k), 2):
            r[a, b] = cov[a, b] / (np.sqrt(cov[a, a]) * np.sqrt(cov[b, b]))
        for z in range(2, k):
            left = [0, 1, *range(z + 1, k)]
            get = {v: r[min(v, z), max(v, z)] for v in left}
            for a, b in combinations(left, 2):
                free_a, free_b = 1 - get[a] ** 2, 1 - get[b] ** 2
                value = (r[a, b] - get[a] * get[b]) / np.sqrt(free_a * free_b)
                r[a, b] = np.where((free_a >= SINGULAR) & (free_b >= SINGULAR), value, np.nan)
    return r[0, 1]


def partial_rho_table(
    df: DataFrame, hypotheses: list[tuple[str, str, str, tuple[str, ...]]], strata: list[str],
    case: str = "case_id", replicates: int = REPLICATES_SHORT, salt: int = SEED,
) -> DataFrame:
    """Point estimates joined with their stratified bootstrap intervals."""
    point = partial_spearman(df, hypotheses, case, p_value=False)
    return point.join(bootstrap_partial_spearman(df, hypotheses, strata, case, replicates, salt), "label", "left")


def _two_groups(df: DataFrame, by: list[str], case: str, p_value: bool, rows: int | None = None) -> DataFrame:
    """Mann-Whitney per key from rows (by, case, _v, _hit): _hit marks the first group."""
    r = ranked(df, by, "_v", [case], rows=rows)
    hit = F.col("_hit")
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    s = r.groupBy(*by).agg(
        F.count_if(hit).alias("n_failure"),
        F.count_if(~hit).alias("n_nonfailure"),
        F.coalesce(F.sum(F.when(hit, rank)), F.lit(0.0)).alias("_r1"),
        F.sum(F.col("ties").cast("double") * F.col("ties") - 1.0).alias("_tie"),
    )
    n1, n2 = F.col("n_failure").cast("double"), F.col("n_nonfailure").cast("double")
    n = n1 + n2
    s = s.withColumn("u_statistic", F.col("_r1") - n1 * (n1 + 1) / 2)
    s = s.withColumn("rank_biserial", F.try_divide(2 * F.col("u_statistic"), n1 * n2) - 1)
    if p_value:
        sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_tie"), n * (n - 1))))
        top = F.greatest(F.col("u_statistic"), n1 * n2 - F.col("u_statistic")) - n1 * n2 / 2 - 0.5
        s = s.withColumn("p_value", F.least(F.lit(1.0), normal_p_value(F.greatest(F.try_divide(top, sd), F.lit(0.0)))))
    return s.drop("_r1", "_tie")


def mann_whitney(
    df: DataFrame, failed: str | Column, features: list[str], eligible: str | Column = None,
    case: str = "case_id", p_value: bool = True,
) -> DataFrame:
    """(feature, n_failure, n_nonfailure, u_statistic, rank_biserial, medians[, p_value]) of eligible rows.

    p by the normal approximation with tie and continuity correction; tiny tie-free samples get no exact p.
    """
    failed = F.col(failed) if isinstance(failed, str) else failed
    keep = df if eligible is None else df.where(eligible)
    rows, n = stored(_long(keep.withColumn("_hit", failed), [case, "_hit"], features, "feature"))
    tests = _two_groups(rows, ["feature"], case, p_value, n)
    mid = quantiles(rows, ["feature", "_hit"], "_v", {"_m": 0.5}, [case], rows=n)
    mid = mid.groupBy("feature").agg(
        F.max(F.when(F.col("_hit"), F.col("_m"))).alias("failure_median"),
        F.max(F.when(~F.col("_hit"), F.col("_m"))).alias("nonfailure_median"),
    )
    return tests.join(mid, "feature", "left")


def failure_sensitivity(
    df: DataFrame, features: list[str], flags: dict[int, str] | None = None, eligible: str = "failure_eligible",
    case: str = "case_id", p_value: bool = True,
) -> DataFrame:
    """(percentile, feature, ...) rank-biserial effects at several failure cut-offs, all in one ranking.

    ``flags``: percentile -> flag column.
    """
    flags = flags or {p: f"failure_bottom{p:02d}" for p in FAILURE_PERCENTILES}
    cuts = F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(c).alias("_hit")) for p, c in flags.items()])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), norm_missing(c).alias("_v")) for c in features])
    rows = df.where(eligible).select(case, F.inline(items), cuts.alias("_cuts")).where(F.col("_v").isNotNull())
    rows = rows.select(case, "feature", "_v", F.inline("_cuts"))
    out = _two_groups(rows, ["percentile", "feature"], case, p_value)
    return bh_fdr(out, "p_value", ["percentile"], "feature", "p_fdr_within_percentile") if p_value else out


def kruskal(df: DataFrame, group: str, outcomes: list[str], case: str = "case_id", p_value: bool = True) -> DataFrame:
    """(outcome, n, groups, h_statistic[, p_value]): Kruskal-Wallis with tie correction."""
    r = ranked(_long(df, [case, group], outcomes, "outcome"), ["outcome"], "_v", [case])
    rank = F.col("before") + (F.col("ties") + 1) / F.lit(2.0)
    per_group = r.groupBy("outcome", group).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(rank).alias("_r"),
        F.sum(F.col("ties").cast("double") * F.col("ties") - 1.0).alias("_tie"),
    )
    s = per_group.groupBy("outcome").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"), F.sum("_tie").alias("_tie"),
    )
    n = F.col("n").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    s = s.withColumn("h_statistic", F.try_divide(h, 1 - F.try_divide(F.col("_tie"), n * n * n - n)))
    if p_value:
        s = s.withColumn("p_value", chi2_p_value(F.col("h_statistic"), F.col("groups") - 1))
    return s.drop("_q", "_tie")


def bh_fdr(df: DataFrame, p: str, family: list[str], test: str, out: str = "p_fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p values per family; a missing p stays missing and is not counted.

    ``test`` is unique within the family. Families of any size: rank and running minimum are both
    computed piecewise (see :mod:`lesionlens.operators.ordered`).
    """
    df, n = stored(df)
    r = ranked(df, family, p, [test], rows=n)
    raw = F.col(p) * F.col("total") / (F.col("before") + F.col("ties"))
    r = r.withColumn("_raw", raw).drop("before", "ties", "total")
    adj = suffix_min(r, family, [p, test], "_raw", out, n).withColumn(out, F.least(F.lit(1.0), F.col(out))).drop("_raw")
    none = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return adj.unionByName(none)
