"""Near-duplicates: MinHash with tensored banding, candidates confirmed on full shingle sets.

A document is the set of its distinct ``SHINGLE``-word shingles, ASCII lower-cased; a shorter text is one
shingle, a text without words is the empty set and linked with nothing. Documents are linked when
100 * intersection >= PERCENT * union.

*Tensoring.* Two collections of ``HALVES`` half keys, ``ROWS`` minima each, are computed for a document. Table
(i, j) is keyed by the pair of half key i of the first and j of the second, so that HALVES**2 tables of
2 * ROWS minima take 2 * HALVES * ROWS minima instead of HALVES**2 * 2 * ROWS. A pair of similarity s is missed
with probability 1 - (1 - (1 - s**ROWS)**HALVES)**2: 6.5e-6 at 0.8 and 3e-11 at 0.85 with the defaults, while
s = 0.3 meets with probability 0.03. Half keys that a single document has are dropped before they are paired.

*Classes.* Documents with equal sets are one class; its smallest id stands for it, so a group of copies of any size
is one node from here on.

*Links without all pairs.* In each bucket of a table every member is paired with one leader, the member that shares
most half keys in all; these pairs are confirmed and their components formed. What is left are pairs of members of one leader that are in
different components; a leader whose members are in one component has none, and an element that only members of one component
have leads to none, so a group that is connected through another leader is not listed again. One of the two is
not linked with the leader. For those the sets' differences from the leader's set decide: with S the sum of their sizes, z
and x are linked only if the differences D(z) and D(x) share at least (|D(z)| + |D(x)| - S / 9) / 2 shingles. This
is positive when z is not linked with the leader, so an overlap join of the differences, with prefix filtering
in order of rarity, finds every such pair; it is confirmed on the full sets. Every pair that shares a bucket is thus
confirmed, or excluded by a bound, or connected through its leader, without listing the pairs of a group.

Defined cases: a null text is empty; a row with a null id is linked with nothing and stays; repeated rows are
one node; rows with the same id and different texts are one node with the links of all of them; ids are
integers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lesionlens.llm import kernels
from lesionlens.llm.columns import unpacked, whole_row
from lesionlens.operators.components import star_contraction
from lesionlens.session import materialize

SHINGLE = 4  # of the query with a contract
STAGE_SHINGLE = 5
PERCENT = 80
HALVES = 24
ROWS = 4


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text by text in ascending order; n + 1 offsets)."""
    data, offsets = kernels.utf8(batch.column("text"))
    data = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, offsets)
    word = kernels.hashes(data, starts, ends)
    got, where = kernels.runs(word, first, k)
    at = np.searchsorted(where, first)
    sets = []
    for i, n in enumerate(np.diff(first)):
        if n >= k:
            mine = got[at[i] : at[i + 1]]
            mine.sort()
            sets.append(mine[np.append(True, mine[1:] != mine[:-1])])
        elif n:
            whole = (word[first[i] : first[i + 1]] * kernels.PLACES[:n]).sum() + np.uint64(n)
            sets.append(kernels.mix(np.array([whole], np.uint64)))
        else:
            sets.append(got[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else got[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=upto[1:])
    return upto[at[1:]] - upto[at[:-1]]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys): set size, 128-bit digest of the set, 2 * HALVES half keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = kernels.numbers(2 * HALVES * ROWS, 3)
        flips, factors = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
        salts = kernels.numbers(2 * HALVES, 4)
        for batch in kernels.pieces(batches):
            sets, at = shingle_sets(batch, shingle)
            full = np.flatnonzero(np.diff(at))
            keys = np.zeros((2 * HALVES, len(full)), np.uint64)
            if len(full):
                short, begin = (sets >> np.uint64(32)).astype(np.uint32), at[full]
                for half in range(2 * HALVES):
                    key = np.full(len(full), salts[half], np.uint64)
                    for row in range(half * ROWS, half * ROWS + ROWS):
                        least = np.minimum.reduceat((short ^ flips[row]) * factors[row], begin)
                        key = kernels.mix(key ^ least)
                    keys[half] = key
            ends = np.zeros(batch.num_rows + 1, np.int32)
            ends[full + 1] = 2 * HALVES
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(at)),
                pa.array(_sums(kernels.mix(sets ^ np.uint64(5)), at).view(np.int64)),
                pa.array(_sums(kernels.mix(sets + np.uint64(9)), at).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.T.reshape(-1).view(np.int64))),
            ], names=["doc_id", "n_shingles", "d1", "d2", "keys"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>")


def sets_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(node, shingles): the full sets of the documents in ``ids`` (node)."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            sets, at = shingle_sets(batch, shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))],
                names=["node", "shingles"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("node"), F.col(text).alias("text")).join(ids.hint("merge"), "node", "left_semi")
    return rows.mapInArrow(shingles, "node bigint, shingles array<bigint>")


def _tables(reps: DataFrame) -> DataFrame:
    """(key, node, n, leader): members of every bucket that has at least two, with the bucket's leader."""
    halves = reps.select("node", "n", F.posexplode("keys").alias("half", "hk"))
    shared = halves.groupBy("hk").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    alive = halves.join(shared.hint("merge"), "hk").groupBy("node", "n").agg(
        F.collect_set(F.when(F.col("half") < HALVES, F.col("hk"))).alias("a"),
        F.collect_set(F.when(F.col("half") >= HALVES, F.col("hk"))).alias("b"), F.sum("c").alias("shares"),
    )
    pairs = alive.withColumn("ka", F.explode("a")).withColumn("kb", F.explode("b"))
    members = materialize(pairs.select(F.xxhash64("ka", "kb").alias("key"), "node", "n", "shares"), "tables")
    # of the most shared the smallest id leads
    leads = members.groupBy("key").agg(
        F.max(F.struct("shares", (-F.col("node")).alias("minus"))).alias("lead"), F.count(F.lit(1)).alias("c")
    ).where("c > 1").select("key", (-F.col("lead.minus")).alias("leader"))
    return members.join(leads.hint("merge"), "key").select("key", "node", "n", "leader")


def _with_sets(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(a, b, x, y, both): each pair with its full sets and the size of their intersection."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(sets_of(docs, ids, doc_id, text, shingle), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").withColumn("both", F.size(F.array_intersect("x", "y")))


def _linked(both: Column, sizes: Column) -> Column:
    return F.lit(100) * both >= F.lit(PERCENT) * (sizes - both)


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def _overlapping(tried: DataFrame) -> DataFrame:
    """(a, b): pairs of members of one leader in different components, one of them not linked with it, that the differences leave possible.

    ``tried`` has (a, b, root, linked, n, differs): leader, member, its component, its set size and its difference from the
    leader's set. With slack = |D| - n / 9 a pair needs an overlap of (slack + slack) / 2.
    """
    part = 1 - PERCENT / 100
    part = part / (1 + PERCENT / 100)  # 1/9 at 80 %: the share of two linked sets' sizes that may differ
    tried = tried.withColumn("slack", F.size("differs") - F.col("n") * F.lit(part))
    least = tried.groupBy("a").agg(
        F.min("slack").alias("any"), F.min(F.when(~F.col("linked"), F.col("slack"))).alias("open"), F.min("root").alias("r1"), F.max("root").alias("r2")
    ).where("r1 <> r2 and open is not null").drop("r1", "r2")
    overlap = F.ceil((F.col("slack") + F.when(F.col("linked"), F.col("open")).otherwise(F.col("any"))) / 2 - F.lit(1e-6))
    rows = tried.join(least.hint("merge"), "a").withColumn("prefix", F.size("differs") - F.greatest(overlap, F.lit(1)) + 1).where("prefix > 0")
    items = materialize(rows.select("a", "b", "root", "linked", "n", "slack", "prefix", F.explode("differs").alias("e")), "differences")
    counts = items.groupBy("a", "e").agg(F.count(F.lit(1)).alias("df"), F.min("linked").alias("closed"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    counts = counts.where("r1 <> r2 and not closed").drop("r1", "r2")
    singles = items.groupBy("a", "b").agg(F.count(F.lit(1)).alias("all"))
    common = items.join(counts.hint("merge"), ["a", "e"]).join(singles.hint("merge"), ["a", "b"])
    rarest = Window.partitionBy("a", "b").orderBy("df", "e")
    many = F.count(F.lit(1)).over(Window.partitionBy("a", "b"))
    # the shingles that no partner shares come first in the order of rarity
    place = F.row_number().over(rarest) + F.col("all") - many
    columns = ("b", "root", "linked", "n", "slack", "all", "place")
    heads = materialize(common.withColumn("place", place).where("place <= prefix").select("a", "e", *columns), "heads")
    z, x = (heads.select("a", "e", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "zx")
    # the pair's own overlap has to fit behind the shared shingle on both sides
    need = F.greatest(F.ceil((F.col("slack_z") + F.col("slack_x")) / 2 - F.lit(1e-6)), F.lit(1))
    fits = (F.col("all_z") - F.col("place_z") + 1 >= need) & (F.col("all_x") - F.col("place_x") + 1 >= need)
    got = z.where("not linked_z").join(x.hint("merge"), ["a", "e"]).where("root_z <> root_x and (linked_x or b_z < b_x)").where(fits)
    got = got.where(F.lit(100) * F.least("n_z", "n_x") >= F.lit(PERCENT) * F.greatest("n_z", "n_x"))
    return got.select(F.least("b_z", "b_x").alias("a"), F.greatest("b_z", "b_x").alias("b")).distinct()


def links(docs: DataFrame, reps: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Links (u, v), u > v, between class representatives; their components are those of all links."""
    pairs = _tables(reps).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    full = _with_sets(docs, materialize(pairs, "pairs"), doc_id, text, shingle)
    away = F.concat(F.array_except("y", "x"), F.array_except("x", "y"))
    linked = _linked(F.col("both"), F.size("x") + F.size("y")).alias("linked")
    tried = materialize(full.select("a", "b", linked, F.size("y").alias("n"), away.alias("differs")), "tried")
    stars = star_contraction(_edges(tried.where("linked")), [])  # each node of a link with its root
    found = stars.where("u <> v").select("u", "v")
    rest = materialize(_overlapping(_rooted(tried, stars)), "rest")
    if rest.isEmpty():
        return found
    more = _with_sets(docs, rest, doc_id, text, shingle).where(_linked(F.col("both"), F.size("x") + F.size("y")))
    return materialize(found.union(_edges(more)).distinct(), "links")


def _rooted(tried: DataFrame, stars: DataFrame) -> DataFrame:
    """``tried`` with each member's ``root``; the difference sets of leaders whose members have one root are not read again."""
    roots = materialize(tried.select("a", "b", "linked").join(stars.select(F.col("u").alias("b"), "v").hint("merge"), "b", "left")
                        .select("a", "b", "linked", F.coalesce("v", "b").alias("root")), "roots")
    several = roots.groupBy("a").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("linked").alias("closed")).where("r1 <> r2 and not closed")
    alive = materialize(roots.join(several.select("a").hint("merge"), "a", "left_semi").drop("linked"), "alive")
    return tried.join(alive.hint("merge"), ["a", "b"])


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ``component_id`` is the smallest id reachable."""
    signed = materialize(signatures(docs, doc_id, text, shingle), "signatures")
    whole = ["n_shingles", "d1", "d2"]
    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(named.groupBy(*whole).agg(F.min("doc_id").alias("rep")), "classes")
    reps = named.join(classes.hint("merge"), [F.col("doc_id") == F.col("rep"), *[named[c] == classes[c] for c in whole]], "left_semi")
    reps = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "keys").dropDuplicates(["node", "n"])
    stars = star_contraction(links(docs, reps, doc_id, text, shingle), [])
    roots = classes.join(stars.withColumnRenamed("u", "rep").hint("merge"), "rep", "left").select(*whole, F.coalesce("v", "rep").alias("root"))
    out = signed.drop("keys").join(materialize(roots, "roots").hint("merge"), whole, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """One document of each component, with the columns of ``docs``. Repeated rows all stay or all go."""
    gone = components(docs, doc_id, text, shingle).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).cast("bigint").alias("_id"))
    return unpacked(rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti"), "row", docs.columns)
