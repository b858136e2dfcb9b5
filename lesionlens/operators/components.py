"""26-connected components of voxel masks: tile-local labelling, then a merge across tile faces.

A volume is cut into cubes of ``tile`` voxels a side. Rows of a cube meet in one task -- at most
``tile**3`` of them, however large the case -- and are labelled there for all masks at once. Pieces of
one component in different cubes meet over the face voxels only: such a voxel goes once to each of the neighbouring cubes ahead of it.
The resulting graph of pieces is solved a volume at a time where it has at most ``LOCAL_EDGES`` edges, else by star operations.

Masks travel as one BIGINT bit set per voxel, so ten thresholds cost one shuffle of the voxels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.operators.lookup import lookup
from lesionlens.session import discard, materialize

AXES = ("z", "y", "x")
TILE = 64
AXIS_BITS = 20
LOCAL_EDGES = 1_000_000  # edges of one volume and mask that a task may hold, about 100 bytes each
FORWARD = [
    (dz, dy, dx)
    for dz in (-1, 0, 1)
    for dy in (-1, 0, 1)
    for dx in (-1, 0, 1)
    if (dz, dy, dx) > (0, 0, 0)
]


def voxel_code(z: str | Column = "z", y: str | Column = "y", x: str | Column = "x") -> Column:
    """Voxel position as one BIGINT that sorts by (z, y, x); a position outside 0 to 2**20 - 1 is an error."""
    z, y, x = (F.col(a).cast("bigint") if isinstance(a, str) else a.cast("bigint") for a in (z, y, x))
    size = F.lit(1 << AXIS_BITS)
    inside = (F.least(z, y, x) >= 0) & (F.greatest(z, y, x) < size)
    return F.when(inside, (z * size + y) * size + x).otherwise(F.raise_error(F.lit("voxel position out of range")).cast("bigint"))


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of ``n`` nodes over undirected edges (a, b)."""
    label = np.arange(n)
    while a.size:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def _label_tiles(group: np.ndarray, zyx: np.ndarray, bits: np.ndarray, tile: int, n_masks: int) -> np.ndarray:
    """Row index of the first voxel of each voxel's tile-local component, per mask; -1 outside the mask.

    Rows are sorted by (group, z, y, x); ``group`` numbers the tiles of the batch.
    """
    n, side = len(bits), tile + 2
    local = zyx % tile + 1
    code = ((group * side + local[:, 0]) * side + local[:, 1]) * side + local[:, 2]
    first, second = [], []
    for dz, dy, dx in FORWARD:
        target = code + (dz * side + dy) * side + dx
        j = np.searchsorted(code, target)
        i = np.flatnonzero((j < n) & (code[np.minimum(j, n - 1)] == target))
        first.append(i)
        second.append(j[i])
    a, b = np.concatenate(first), np.concatenate(second)
    both = bits[a] & bits[b]
    out = np.full((n, n_masks), -1, dtype=np.int64)
    for k in range(n_masks):
        on = (both >> k) & 1 == 1
        inside = np.flatnonzero((bits >> k) & 1)
        place = np.zeros(n, dtype=np.int64)
        place[inside] = np.arange(inside.size)
        out[inside, k] = inside[_min_labels(inside.size, place[a[on]], place[b[on]])]
    return out


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str], nulls: bool = False) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup sorted record batches so that no tile is cut; yields rows with their tile number. ``nulls`` lets NULL be a key like any other."""
    rest: pa.Table | None = None

    def numbered(table: pa.Table) -> np.ndarray:
        step = np.zeros(table.num_rows, dtype=bool)
        for name in keys:
            c = table.column(name).combine_chunks()
            if c.null_count and not nulls:
                raise ValueError(f"key column {name} holds NULL; components need named volumes")
            step[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            if c.null_count:
                step[1:] |= pc.not_equal(c[1:].is_null(), c[:-1].is_null()).to_numpy(zero_copy_only=False)
        return np.cumsum(step)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        number = numbered(table)
        cut = int(np.searchsorted(number, number[-1]))  # the last tile may go on in the next batch
        if cut:
            yield table.slice(0, cut), number[:cut]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, numbered(rest)


@dataclass
class Fragments:
    """Tile-local pieces of components.

    ``voxels``: input rows plus ``frag``, an array with one piece id per mask (-1 outside the mask), and on request ``sizes``, an array with the
    voxels of the piece at its first voxel and 0 elsewhere.
    ``merged``: (keys, mask, frag, comp) for the pieces that continue in another tile, or None.
    """

    voxels: DataFrame
    merged: DataFrame | None
    keys: list[str]

    def resolve(self, df: DataFrame, frag: str = "frag", out: str = "comp", mask: str | Column = "mask") -> DataFrame:
        """Replace a piece id column of ``df`` (with the keys and a mask number) by the component id."""
        if self.merged is None:
            return df.withColumnRenamed(frag, out)
        mask = mask if isinstance(mask, Column) else F.col(mask)
        m = self.merged.select(
            *self.keys, F.col("mask").alias("_mask"), F.col("frag").alias("_frag"), F.col("comp").alias("_comp")
        )
        return (
            df.withColumn("_mask", mask.cast("int"))
            .withColumn("_frag", F.col(frag))
            .join(m.hint("merge"), [*self.keys, "_mask", "_frag"], "left")  # pieces pack too well for their files' size to tell
            .withColumn(out, F.coalesce("_comp", frag))
            .drop("_mask", "_frag", "_comp", *([frag] if frag != out else []))
        )


def label_fragments(
    vox: DataFrame, keys: list[str], bits: str, n_masks: int, payload: list[str] = (), tile: int = TILE,
    max_rounds: int = 50, sizes: bool = False,
) -> Fragments:
    """Label all masks of ``bits`` inside tiles and find which pieces belong together; ``sizes`` are counted where the tile is at hand.

    ``vox`` has one row per (keys, z, y, x) with axes >= 0 and no missing key. Component ids are the smallest voxel code of
    a component, hence independent of row order, partitioning and tile size.
    """
    tiles = [f"_t{a}" for a in AXES]
    rows = vox.where(F.col(bits) != 0).select(
        *keys, *[F.col(a).cast("int").alias(a) for a in AXES], F.col(bits).cast("bigint").alias("_bits"), *payload
    )
    for a, t in zip(AXES, tiles):
        rows = rows.withColumn(t, F.floor(F.col(a) / F.lit(tile)).cast("int"))
    tile_keys = [*keys, *tiles]
    # every level of nesting is sorted, so the tiles of a partition arrive one after the other
    rows = rows.repartition(*tile_keys).sortWithinPartitions(*tile_keys, *AXES)
    schema = T.StructType(
        [f for f in rows.drop(*tiles).schema.fields]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("frag", *(["sizes"] if sizes else []))]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches, tile_keys):
            zyx = np.stack([table.column(a).to_numpy().astype(np.int64) for a in AXES], axis=1)
            first = _label_tiles(number, zyx, table.column("_bits").to_numpy(), tile, n_masks)
            code = (zyx[:, 0] << 2 * AXIS_BITS) | (zyx[:, 1] << AXIS_BITS) | zyx[:, 2]
            frag = np.where(first >= 0, code[first], -1)
            offsets = np.arange(0, frag.size + 1, n_masks, dtype=np.int32)
            listed = lambda a: pa.ListArray.from_arrays(pa.array(offsets), pa.array(a.ravel()))
            out = table.drop_columns(tiles).append_column("frag", listed(frag))
            if sizes:
                counts = [np.bincount(of[of >= 0], minlength=len(first)) for of in first.T]
                out = out.append_column("sizes", listed(np.ascontiguousarray(np.stack(counts, axis=1), dtype=np.int64)))
            yield from out.combine_chunks().to_batches()

    labelled = materialize(rows.mapInArrow(kernel, schema), "fragments")
    return Fragments(labelled, _merge(labelled, keys, tile, max_rounds), list(keys))


def _merge(labelled: DataFrame, keys: list[str], tile: int, max_rounds: int) -> DataFrame | None:
    """Component id of every piece with a neighbour in another tile; None if there is no such piece."""
    far = labelled.agg(*[F.max(a).alias(a) for a in AXES]).first()
    if all(v is None or v < tile for v in far):
        return None  # one tile per volume
    on_face = F.lit(False)
    for a in AXES:
        on_face = on_face | (F.col(a) % tile).isin(0, tile - 1)
    face = labelled.where(on_face).select(*keys, *AXES, "frag")
    edges = materialize(_face_edges(face, keys, tile), "edges")
    if edges.isEmpty():
        return None
    return contract(edges, [*keys, "mask"], max_rounds).select(
        *keys, "mask", F.col("u").alias("frag"), F.col("v").alias("comp")
    )


def _face_edges(face: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """(keys, mask, u, v), u > v: pieces with neighbouring voxels in different tiles, distinct within a tile.

    A pair is found in the tile that comes later in (z, y, x); the earlier voxel is sent there once, however many of its
    neighbours are in it.
    """
    tiles = [f"_t{a}" for a in AXES]
    own = F.struct(*[F.lit(0).alias(t) for t in tiles])
    ahead = [own]
    for step in [o for o in ((z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1)) if o > (0, 0, 0)]:
        reach = F.lit(True)
        for a, d in zip(AXES, step):
            reach = reach & {0: F.lit(True), 1: F.col(a) % tile == tile - 1, -1: (F.col(a) % tile == 0) & (F.col(a) > 0)}[d]
        ahead.append(F.when(reach, F.struct(*[F.lit(d).alias(t) for t, d in zip(tiles, step)])))
    rows = face.withColumn("_to", F.explode(F.array_compact(F.array(*ahead))))
    home = F.lit(True)
    for t in tiles:
        home = home & (F.col(f"_to.{t}") == 0)
    rows = rows.select(
        *keys, *[(F.floor(F.col(a) / F.lit(tile)) + F.col(f"_to.{t}")).cast("int").alias(t) for a, t in zip(AXES, tiles)], *AXES,
        home.alias("_home"), "frag",
    )
    tile_keys = [*keys, *tiles]
    rows = rows.repartition(*tile_keys).sortWithinPartitions(*tile_keys, *AXES)
    schema = T.StructType([face.schema[k] for k in keys] + [T.StructField(n, t) for n, t in (("mask", T.IntegerType()), ("u", T.LongType()), ("v", T.LongType()))])
    every = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) != (0, 0, 0)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches, tile_keys):
            side = tile + 4  # the tile, one voxel beyond it, and one more that nothing is in
            corner = np.stack([table.column(t).to_numpy().astype(np.int64) for t in tiles], axis=1) * tile
            local = np.stack([table.column(a).to_numpy().astype(np.int64) for a in AXES], axis=1) - corner + 2
            code = ((number * side + local[:, 0]) * side + local[:, 1]) * side + local[:, 2]
            home = table.column("_home").to_numpy(zero_copy_only=False)
            frag = table.column("frag").combine_chunks()
            frag = (frag.chunk(0) if isinstance(frag, pa.ChunkedArray) else frag).flatten().to_numpy(zero_copy_only=False).reshape(len(code), -1)
            guests = np.flatnonzero(~home)
            first, second = [], []
            for dz, dy, dx in every:
                target = code[guests] + (dz * side + dy) * side + dx
                j = np.minimum(np.searchsorted(code, target), len(code) - 1)
                hit = (code[j] == target) & home[j]
                first.append(guests[hit])
                second.append(j[hit])
            a, b = np.concatenate(first), np.concatenate(second)
            fa, fb = frag[a], frag[b]
            at, mask = np.nonzero((fa >= 0) & (fb >= 0))
            if not len(at):
                continue
            u, v = np.maximum(fa[at, mask], fb[at, mask]), np.minimum(fa[at, mask], fb[at, mask])
            order = np.lexsort((v, u, mask, number[a[at]]))
            u, v, mask, row = u[order], v[order], mask[order], a[at][order]
            new = np.r_[True, (np.diff(u) != 0) | (np.diff(v) != 0) | (np.diff(mask) != 0) | (np.diff(number[row]) != 0)]
            out = table.select(keys).take(pa.array(row[new]))
            out = out.append_column("mask", pa.array(mask[new].astype(np.int32))).append_column("u", pa.array(u[new])).append_column("v", pa.array(v[new]))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(kernel, schema)


def contract(edges: DataFrame, keys: list[str], max_rounds: int = 50, local_edges: int | None = None) -> DataFrame:
    """(keys, u, v), u > v, of a stored table -> (node u, smallest node v of its component), one row a node.

    Graphs of up to ``local_edges`` edges, by default ``LOCAL_EDGES``, are solved whole, several in a task; larger ones by :func:`star_contraction`.
    """
    bound = LOCAL_EDGES if local_edges is None else local_edges
    large = materialize(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(*keys), "large")
    if large.isEmpty():
        return _contract_whole(edges, keys)
    small = _contract_whole(edges.join(large, keys, "left_anti"), keys)
    return small.unionByName(star_contraction(edges.join(large, keys, "left_semi").distinct(), keys, max_rounds))


def _contract_whole(edges: DataFrame, keys: list[str]) -> DataFrame:
    rows = edges.select(*keys, "u", "v").repartition(*keys).sortWithinPartitions(*keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_tiles(batches, keys):
            n = len(number)
            node = np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()])
            graph = np.concatenate([number, number])
            order = np.lexsort((node, graph))
            new = np.r_[True, (np.diff(node[order]) != 0) | (np.diff(graph[order]) != 0)]
            place = np.empty(2 * n, np.int64)
            place[order] = np.cumsum(new) - 1
            shown = order[new]  # a row of each node; nodes of a graph are numbered by size
            label = _min_labels(len(shown), place[:n], place[n:])
            at = np.flatnonzero(label != np.arange(len(shown)))
            out = table.select(keys).take(pa.array(shown[at] % n))
            out = out.append_column("u", pa.array(node[shown[at]])).append_column("v", pa.array(node[shown[label[at]]]))
            yield from out.combine_chunks().to_batches()

    return materialize(rows.mapInArrow(kernel, rows.schema), "contracted")


def _min_per_node(edges: DataFrame, node: list[str], salts: int) -> DataFrame:
    """Edges (u, v) with ``m``, the smallest v of their u; a node with very many edges is split by salt."""
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(salts)))
    least = edges.groupBy(*node).agg(F.min("v").alias("m"))
    copies = least.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies.hint("merge"), [*node, "_s"]).drop("_s")


def star_contraction(edges: DataFrame, keys: list[str], max_rounds: int = 50, salts: int = 8) -> DataFrame:
    """(keys, u, v) edges with u > v -> the star forest (node u, smallest node v of its component).

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). Each round is written to
    shared storage; the loop ends when a round changes nothing and raises after ``max_rounds``.
    """
    node = [*keys, "u"]
    seen = last = None
    for _ in range(max_rounds):
        both = edges.select(*keys, "u", "v").union(
            edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
        )
        large = _min_per_node(both, node, salts)
        # larger neighbours go to the smallest of the neighbourhood, the node itself included
        large = (
            large.where("v > u")
            .select(*keys, F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = _min_per_node(large, node, salts)
        small = small.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select(*keys, "u", F.col("m").alias("v"))
        ).where("u <> v").distinct()
        edges = materialize(small, "stars")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*node, "v").cast("decimal(38,0)"))
        ).first()
        discard(last)  # of the rounds so far only the newest is read again
        if seen == tuple(state):
            return edges
        seen, last = tuple(state), edges
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def connected_components(
    vox: DataFrame, keys: list[str], masks: dict[str, Column] | None = None, tile: int = TILE
) -> DataFrame:
    """(keys, [mask,] z, y, x, comp): component of every mask voxel.

    Without ``masks`` every row of ``vox`` is foreground and there is no mask column.
    """
    from lesionlens.functions.scalars import pack_bits

    named = masks or {"": F.lit(True)}
    frags = label_fragments(vox.withColumn("_m", pack_bits(list(named.values()))), keys, "_m", len(named), tile=tile)
    rows = frags.voxels.select(*keys, *AXES, F.posexplode("frag").alias("mask", "frag")).where("frag >= 0")
    comp = frags.resolve(rows)
    if not masks:
        return comp.drop("mask")
    names = F.array(*[F.lit(n) for n in named])
    return comp.withColumn("mask", F.element_at(names, F.col("mask") + 1))


def component_sizes(comp: DataFrame, keys: list[str]) -> DataFrame:
    return comp.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("size"))


def component_stats(comp: DataFrame, keys: list[str], min_size: int = 10, cases: DataFrame | None = None) -> DataFrame:
    """Number of components, of those with at least ``min_size`` voxels, voxels and largest fraction.

    Keys listed in ``cases`` but without foreground get zero counts and a missing fraction.
    """
    stats = component_sizes(comp, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("size") >= min_size).alias("components_large"),
        F.sum("size").alias("volume"),
        (F.max("size") / F.sum("size")).alias("largest_fraction"),
    )
    if cases is None:
        return stats
    return cases.select(*keys).join(stats, keys, "left").fillna(0, ["components", "components_large", "volume"])


def min_size_filter(comp: DataFrame, keys: list[str], min_voxels: int) -> DataFrame:
    """Voxels of components with at least ``min_voxels`` voxels; 1 or less keeps everything."""
    if min_voxels <= 1:
        return comp
    kept = component_sizes(comp, keys).where(F.col("size") >= min_voxels).select(*keys, "comp")
    # a component may hold most voxels of a case: split its rows by position
    return lookup(comp, kept, [*keys, "comp"], list(AXES), how="left_semi")


def lesion_match(pred: DataFrame, ref: DataFrame, keys: list[str], cases: DataFrame | None = None) -> DataFrame:
    """Lesion counts per key from two component tables (keys, z, y, x, comp).

    tp: reference components touched by any predicted voxel; fn: the others; fp: predicted components
    that touch no reference component. Any overlap counts, one component may touch several.
    """
    touch = pred.select(*keys, *AXES, F.col("comp").alias("_p")).join(
        ref.select(*keys, *AXES, F.col("comp").alias("_r")), [*keys, *AXES]
    ).select(*keys, "_p", "_r").distinct()
    sides = (
        pred.select(*keys, F.lit("p").alias("_side"), "comp", F.lit(0).alias("_hit"))
        .unionByName(ref.select(*keys, F.lit("r").alias("_side"), "comp", F.lit(0).alias("_hit")))
        .unionByName(touch.select(*keys, F.lit("p").alias("_side"), F.col("_p").alias("comp"), F.lit(1).alias("_hit")))
        .unionByName(touch.select(*keys, F.lit("r").alias("_side"), F.col("_r").alias("comp"), F.lit(1).alias("_hit")))
        .groupBy(*keys, "_side", "comp")
        .agg(F.max("_hit").alias("_hit"))
    )
    ref_side, pred_side, hit = F.col("_side") == "r", F.col("_side") == "p", F.col("_hit") == 1
    out = sides.groupBy(*keys).agg(
        F.count_if(ref_side & hit).alias("tp"),
        F.count_if(pred_side & ~hit).alias("fp"),
        F.count_if(ref_side & ~hit).alias("fn"),
    )
    if cases is None:
        return out
    return cases.select(*keys).join(out, keys, "left").fillna(0, ["tp", "fp", "fn"])
