"""Surface agreement on the dual grid of a voxel volume.

A dual-grid corner has eight voxels around it; it is a border element of a mask if some but not all of
them belong to the mask. An element is matched if the other mask has one within the tolerance. With a
weight table the elements count with the weight of their eight-voxel pattern, else with 1; numbers of
area-weighted tools therefore differ unless their table is given.

A volume is cut into cubes of ``tile`` corners a side. A voxel goes to the cube of its corners, one near a face to its
neighbours too (a halo of the tolerance and one voxel); a cube then has all it needs, and its sums are all that leaves
the task. Masks travel as one BIGINT bit set, so there is one shuffle of voxels for any number of mask pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.functions.scalars import pack_bits
from lesionlens.operators.components import TILE, whole_tiles

AXES = ("z", "y", "x")
CORNERS = list(product((0, 1), repeat=3))


def offsets_within(tolerance: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Grid steps (z, y, x) no longer than ``tolerance``."""
    reach = [range(-math.floor(tolerance / s), math.floor(tolerance / s) + 1) for s in spacing]
    return [
        o for o in product(*reach)
        if sum((d * s) ** 2 for d, s in zip(o, spacing)) <= tolerance**2 * (1 + 1e-12)
    ]


def border_elements(code: np.ndarray, bits: np.ndarray, steps: np.ndarray, n_masks: int, patterns: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corner, border, pattern) of the corners that are a border element of some mask, in ascending order.

    ``code`` and ``bits`` are the voxels' places and masks, ``steps`` the distances from a voxel to its eight corners; ``pattern``
    (elements, masks) holds one bit for each of the eight voxels.
    """
    corner, mask = (code[None, :] + steps[:, None]).ravel(), np.tile(bits, len(steps))
    order = np.argsort(corner, kind="stable")
    corner, mask = corner[order], mask[order]
    begin = np.flatnonzero(np.append(True, corner[1:] != corner[:-1])) if len(corner) else order
    if not len(begin):
        return corner, mask, np.zeros((0, n_masks), np.int64)
    some = np.bitwise_or.reduceat(mask, begin)
    every = np.where(np.diff(np.append(begin, len(corner))) == 8, np.bitwise_and.reduceat(mask, begin), 0)
    border = some & ~every
    keep = np.flatnonzero(border)
    pattern = np.zeros((len(keep), n_masks), np.int64)
    if patterns:
        tag = np.int64(1) << (order // len(code))
        for k in range(n_masks):
            pattern[:, k] = np.add.reduceat((mask >> k & 1) * tag, begin)[keep]
    return corner[begin][keep], border[keep], pattern


def surface_dice(
    vox: DataFrame,
    keys: list[str],
    pairs: dict[str, tuple[Column, Column]],
    tolerance: float = 1.0,
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0),
    weights: DataFrame | None = None,
    cases: DataFrame | None = None,
    tile: int = TILE,
) -> DataFrame:
    """One column per entry of ``pairs`` (prediction mask, reference mask): share of matched elements.

    Missing when both masks are empty, 0 when one is. ``weights`` has (code, weight), one row per pattern of eight voxels.
    """
    flags = [c for pair in pairs.values() for c in pair]
    steps = np.array([o for o in offsets_within(tolerance, spacing) if any(o)], np.int64).reshape(-1, 3)
    halo = [int(h) for h in np.abs(steps).max(axis=0, initial=0)]
    tiles = [f"_t{a}" for a in AXES]
    df = vox.select(*keys, *[F.col(a).cast("bigint").alias(a) for a in AXES], pack_bits(flags).alias("_m")).where("_m <> 0")
    for a, t, h in zip(AXES, tiles, halo):  # the cubes that own a corner within the halo of the voxel's two
        first, last = (F.floor((F.col(a) + d) / F.lit(tile)) for d in (-h, h + 1))
        df = df.withColumn(t, F.explode(F.sequence(first, last)))
    group = [*keys, *tiles]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what a cube costs does not show in the size of its rows
    look = None
    if weights is not None:  # at most 256 rows
        look = np.zeros(256)
        table = weights.select(F.col("code").cast("int"), F.col("weight").cast("double")).where("code between 0 and 255")
        for code, weight in table.groupBy("code").agg(F.max("weight")).collect():
            look[code] = weight
    n_pairs, n_masks = len(pairs), len(flags)
    names = [f"_{s}{k}" for k in range(n_pairs) for s in "nd"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = np.array([tile + 2 * h + 3 for h in halo], np.int64)
        stride = np.array([side[1] * side[2], side[2], 1], np.int64)
        for table, number in whole_tiles(batches, group, nulls=True):
            number = number - number[0]
            local = np.stack([table.column(a).to_numpy() - table.column(t).to_numpy() * tile + h + 1 for a, t, h in zip(AXES, tiles, halo)], axis=1)
            bits = table.column("_m").to_numpy()
            corner, border, pattern = border_elements(number * side.prod() + local @ stride, bits, np.array(CORNERS, np.int64) @ stride, n_masks, look is not None)
            near = border.copy()
            for step in steps @ stride:
                at = np.minimum(np.searchsorted(corner, corner + step), len(corner) - 1)
                near |= np.where(corner[at] == corner + step, border[at], 0)
            of, place = np.divmod(corner, side.prod())
            owned = np.ones(len(corner), bool)
            for k, h in enumerate(halo):
                c = place // stride[k] % side[k] - (h + 1)
                owned &= (c >= 0) & (c < tile)
            of, border, near, pattern = of[owned], border[owned], near[owned], pattern[owned]
            out, groups = [], int(number[-1]) + 1
            for k in range(n_pairs):
                p, r = 2 * k, 2 * k + 1
                wp, wr = (look[pattern[:, m]] if look is not None else 1.0 for m in (p, r))
                in_p, in_r, by_p, by_r = border >> p & 1, border >> r & 1, near >> p & 1, near >> r & 1
                out += [np.bincount(of, in_p * by_r * wp + in_r * by_p * wr, groups), np.bincount(of, in_p * wp + in_r * wr, groups)]
            begin = pa.array(np.flatnonzero(np.append(True, number[1:] != number[:-1])))
            owner = table.select(keys).take(begin).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(owner.column(c).combine_chunks() for c in keys), *(pa.array(x, pa.float64()) for x in out)], names=[*keys, *names])

    schema = T.StructType([*(df.schema[c] for c in keys), *(T.StructField(n, T.DoubleType()) for n in names)])
    found = df.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(sums, schema)
    found = found.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    out = found.select(*keys, *[F.try_divide(F.col(f"_n{k}"), F.col(f"_d{k}")).alias(name) for k, name in enumerate(pairs)])
    return out if cases is None else cases.select(*keys).join(out, keys, "left")
