"""Repeated byte strings: every byte inside a string of ``WINDOW`` bytes that also starts elsewhere is removed, found with
suffix arrays of shards that are sorted by bucket-pointer refinement.

*Shards by content.* A window is filed under its anchor, the run of ``GRAM`` bytes inside it with the smallest hash, so
equal windows meet under one anchor wherever they stand. Successive windows with one anchor form a segment. Segments of
anchors that occur once are dropped, equal segments become one with a weight; where an anchor has one segment only, all its
windows are repeated and nothing is left to sort. The bytes of the other segments are brought together by anchor and sorted
in shards of about ``SHARD_BYTES``.

*Suffix arrays.* The suffixes of a shard are put into buckets by their first ``Q`` bytes. Buckets are refined by sorting
their suffixes on the bucket pointers of later offsets: a suffix whose bucket shares h bytes is placed by the pointer at
offset h, which is as deep, so every round reuses the last one's pointers and doubles the depth; the last round takes the
offset at which both depths together make up a window. A suffix alone in its bucket is done and leaves. What is left at full depth are
the repeated windows.

Anchors above ``HOT`` occurrences would overfill a shard: their segments are cut into single windows, which are counted by hash in
a plain aggregation, so no passage and no border of one is a single task's work.

Segments and anchors are told apart by 64-bit hashes each (together 128 bits), texts by id and 64-bit hash.

Defined cases: a null text is empty; texts below WINDOW bytes lose nothing; matches never cross rows; repeated rows are
occurrences of their own; rows with the same id and different texts are kept apart; what is kept of a text need not be
valid UTF-8; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lesionlens.llm import kernels
from lesionlens.llm.columns import text_of
from lesionlens.session import discard, materialize

WINDOW = 200
GRAM = 64
PLACES = WINDOW - GRAM + 1  # of a gram in a window
SPARSE = np.uint64(2**60)  # one gram in 16 may be an anchor; a window without one is filed by itself
Q = 8
SHARD_BYTES = 4_000_000
HOT = 20_000


def _smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the leftmost smallest of values[begin:end], for ranges of at least one."""
    table, width = [np.arange(len(values))], end - begin
    while 2 ** len(table) <= int(width.max(initial=0)):
        half = 2 ** (len(table) - 1)
        a, b = table[-1][:-half], table[-1][half:]
        table.append(np.where(values[b] < values[a], b, a))
    out = np.zeros(len(begin), np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        a, b = row[begin[at]], row[end[at] - 2**k]
        out[at] = np.where(values[b] < values[a], b, a)
    return out


class Hashes:
    """64-bit hashes of any byte ranges of a piece, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = kernels.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(kernels.BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return kernels.mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return kernels.mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def segments_of(column: pa.Array) -> dict[str, np.ndarray]:
    """anchor, digest, row and at of the segments; at is 256 * first byte + windows."""
    data, offsets = kernels.utf8(column)
    found = Hashes(data)
    gram = found.grams(GRAM)
    places = np.flatnonzero(gram < SPARSE)
    values = gram[places]
    long = np.flatnonzero(np.diff(offsets) >= WINDOW)
    edges = np.concatenate([places + 1, places - (PLACES - 1), offsets[long], offsets[long + 1] - (WINDOW - 1)])
    edges = np.unique(edges[(edges >= 0) & (edges <= len(data))])
    begin, end = edges[:-1], edges[1:]
    row = np.searchsorted(offsets, begin, "right") - 1
    inside = begin + WINDOW <= offsets[np.minimum(row + 1, len(offsets) - 1)]
    begin, end, row = begin[inside], end[inside], row[inside]
    first, last = np.searchsorted(places, begin), np.searchsorted(places, begin + PLACES)
    some = first < last
    anchor = _smallest(values, first[some], last[some])
    b, e, r = begin[some], end[some], row[some]
    new = np.ones(len(b), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (b[1:] != e[:-1]) | (r[1:] != r[:-1])
    cut = np.flatnonzero(new)
    start, count, row_, place = b[cut], e[np.append(cut[1:], len(b)) - 1] - b[cut] if len(cut) else cut, r[cut], anchor[cut]
    label = kernels.mix(values[place] + np.uint64(1))
    digest = kernels.mix(found.of(start, count + (WINDOW - 1)) + (places[place] - start).astype(np.uint64))
    lone = kernels.spread(begin[~some], (end - begin)[~some])
    own = found.of(lone, WINDOW)
    start, count = np.concatenate([start, lone]), np.concatenate([count, np.ones(len(lone), np.int64)])
    row = np.concatenate([row_, np.repeat(row[~some], (end - begin)[~some])])
    label, digest = np.concatenate([label, kernels.mix(own + np.uint64(2))]), np.concatenate([digest, own])
    return {"anchor": label.view(np.int64), "digest": digest.view(np.int64), "row": row, "at": (start - offsets[row]) * 256 + count}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernels.pieces(batches):
        got = segments_of(batch.column("text"))
        ident = batch.column("ident").take(pa.array(got["row"]))
        yield pa.RecordBatch.from_arrays([pa.array(got["anchor"]), pa.array(got["digest"]), ident, pa.array(got["at"])], names=["anchor", "digest", "ident", "at"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted segment; of a hot one the hash of each window, with its place."""
    for batch in kernels.pieces(batches):
        data, offsets = kernels.utf8(batch.column("text"))
        wanted = batch.column("wanted")
        flat = wanted.flatten()
        at = flat.field("at").to_numpy()
        start, count = np.repeat(offsets[:-1], np.diff(wanted.offsets.to_numpy())) + at // 256, at % 256
        hot = flat.field("hot").to_numpy(zero_copy_only=False)
        fields = [flat.field(c).to_numpy() for c in ("anchor", "digest", "weight")]
        cold = np.flatnonzero(~hot)
        size = count[cold] + WINDOW - 1
        ends = np.cumsum(size)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cold), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data[kernels.spread(start[cold], size)])])
        nothing = pa.array(np.zeros(len(cold), np.int64))
        yield pa.RecordBatch.from_arrays([*(pa.array(f[cold]) for f in fields), nothing, nothing, raw.cast(pa.binary())], names=["anchor", "digest", "weight", "window", "place", "bytes"])
        if hot.any():
            single = kernels.spread(start[hot], count[hot])
            place = single - np.repeat(start[hot], count[hot])
            own = Hashes(data).of(single, WINDOW).view(np.int64)
            cut = [pa.array(np.repeat(f[hot], count[hot])) for f in fields]
            yield pa.RecordBatch.from_arrays([*cut, pa.array(own), pa.array(place), pa.nulls(len(single), pa.binary())], names=["anchor", "digest", "weight", "window", "place", "bytes"])


class BucketPointers:
    """Suffixes of a text in buckets of equal prefixes; ``pointer[p]`` is the bucket of suffix p, in lexicographic order, or -1
    once its prefix is known to occur once, weights counted. A suffix is as long as its segment goes on."""

    def __init__(self, data: np.ndarray, end: np.ndarray, weight: np.ndarray, q: int = Q):
        self.end, self.weight, self.depth = end, weight, q
        n = max(len(data) - q + 1, 0)
        code = np.zeros(n, np.uint64)
        for k in range(q):  # the first q bytes as a number
            code = (code << np.uint64(8)) | data[k : k + n]
        self.pointer = np.full(len(data), -1, np.int64)
        self._place(np.flatnonzero(np.arange(n) + q <= end[:n]), code)

    def _place(self, active: np.ndarray, key: np.ndarray) -> None:
        """New buckets of the active suffixes, by their keys; those alone leave."""
        order, begin = kernels.groups(key[active] if len(key) != len(active) else key)
        fresh = np.full(len(self.pointer), -1, np.int64)
        if len(begin):
            weight = np.add.reduceat(self.weight[active][order], begin)
            bucket = np.repeat(np.where(weight > 1, np.cumsum(weight > 1) - 1, -1), np.diff(np.append(begin, len(order))))
            fresh[active[order]] = bucket
        self.pointer = fresh

    def refine(self, offset: int) -> None:
        """Sorts every bucket on the pointers at ``offset``, at most the depth; the depth grows by it."""
        alive = np.flatnonzero(self.pointer >= 0)
        alive = alive[alive + offset + self.depth <= self.end[alive]]
        alive = alive[self.pointer[alive + offset] >= 0]
        n = int(self.pointer.max(initial=0)) + 1
        self._place(alive, self.pointer[alive] * n + self.pointer[alive + offset])
        self.depth += offset

    def refined(self, depth: int) -> np.ndarray:
        """The suffixes whose first ``depth`` bytes occur more than once."""
        while self.depth < depth:
            self.refine(min(self.depth, depth - self.depth))
        return np.flatnonzero(self.pointer >= 0)


def repeated(data: np.ndarray, bounds: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, end): runs of windows, by their places in a segment, that occur at least twice, weights counted."""
    sizes = np.diff(bounds)
    found = BucketPointers(data, np.repeat(bounds[1:], sizes), np.repeat(weight, sizes)).refined(WINDOW)
    owner = np.searchsorted(bounds, found, "right") - 1
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    first = found[begin] - bounds[owner[begin]]
    return owner[begin], first, first + np.diff(np.append(begin, len(found)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a shard ends at an anchor's border."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        anchor, digest, weight = (rows.column(c).to_numpy() for c in ("anchor", "digest", "weight"))
        data, offsets = kernels.utf8(rows.column("bytes").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
        order = np.lexsort((digest, anchor))  # a row that the table holds twice delivers its segments twice
        one = np.ones(len(order), bool)
        one[1:] = (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        order = order[one]
        sizes = np.diff(offsets)[order]
        owner, first, end = repeated(data[kernels.spread(offsets[order], sizes)], np.append(0, np.cumsum(sizes)), weight[order])
        which, begin = np.unique(owner, return_index=True)
        spans = pa.ListArray.from_arrays(pa.array(np.append(2 * begin, 2 * len(owner)).astype(np.int32)), pa.array(np.stack([first, end], 1).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(anchor[order[which]]), pa.array(digest[order[which]]), spans], names=["anchor", "digest", "spans"])

    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        total += batch.column("bytes").nbytes
        if total >= SHARD_BYTES:
            rows = pa.Table.from_batches(held)
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                yield shard(rows.slice(0, cut).to_batches())
                held = rows.slice(cut).combine_chunks().to_batches()
                total = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield shard(held)


def _cut(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """(bytes, removed bytes, removed runs, what is left) of each text."""
    data, offsets = kernels.utf8(batch.column("text"))
    found = batch.column("found")
    flat = found.flatten()
    base = np.repeat(offsets[:-1], np.diff(found.offsets.to_numpy()))
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, base + flat.field("first").to_numpy(), 1)
    np.add.at(change, base + flat.field("end").to_numpy() + (WINDOW - 1), -1)
    gone = np.cumsum(change)[:-1] > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[offsets[:-1][np.diff(offsets) > 0]] = gone[offsets[:-1][np.diff(offsets) > 0]]
    removed, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, opens))
    left, at = data[~gone].tobytes(), offsets - removed
    return np.diff(offsets).tolist(), np.diff(removed).tolist(), np.diff(runs).tolist(), [left[a:b] for a, b in zip(at[:-1], at[1:])]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, found): for each text with repeated windows the ranges of their first bytes, (first, end)."""
    rows = _rows(docs, doc_id, text)
    kind = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), rows.schema["ident"], T.StructField("at", T.LongType())])
    segments = materialize(rows.where(F.octet_length("text") >= WINDOW).mapInArrow(_segments, kind), "segments")
    anchors = materialize(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "anchors")
    members = materialize(segments.join(anchors.hint("merge"), "anchor"), "members")
    discard(segments)
    discard(anchors)
    groups = members.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("weight"), F.max("n").alias("n"), F.min(F.struct("ident", "at")).alias("one"))
    groups = materialize(groups, "groups")

    hot = (F.col("n") > HOT).alias("hot")
    wanted = groups.where("n > weight").select("one.ident", F.struct("anchor", "digest", "weight", "one.at", hot).alias("w"))
    wanted = materialize(wanted.groupBy("ident").agg(F.collect_list("w").alias("wanted")), "wanted")
    schema = "anchor bigint, digest bigint, weight bigint, window bigint, place bigint, bytes binary"
    contents = rows.join(wanted.hint("merge"), "ident").select("text", "wanted").mapInArrow(_contents, schema)
    contents = materialize(contents, "contents")

    cold = contents.where("bytes is not null")
    total = cold.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    sorted_ = cold.select("anchor", "digest", "weight", "bytes").repartition(shards, "anchor").sortWithinPartitions("anchor")
    searched = sorted_.mapInArrow(_search, "anchor bigint, digest bigint, spans array<bigint>")
    single = contents.where("bytes is null").select("anchor", "digest", "weight", "window", "place").distinct()
    twice = single.groupBy("window").agg(F.sum("weight").alias("times")).where("times > 1").select("window")
    counted = single.join(twice.hint("merge"), "window").groupBy("anchor", "digest").agg(F.flatten(F.collect_list(F.array("place", F.col("place") + 1))).alias("spans"))
    whole = groups.where("weight > 1").select("anchor", "digest", F.array(F.lit(0).cast("bigint"), F.col("one.at") % 256).alias("spans"))
    partly = searched.unionByName(counted).join(groups.where("weight = 1").select("anchor", "digest").hint("merge"), ["anchor", "digest"], "left_semi")
    decided = materialize(whole.unionByName(partly), "decided")
    discard(contents)

    found = members.join(decided.hint("merge"), ["anchor", "digest"])
    found = found.select("ident", F.floor(F.col("at") / 256).alias("start"), "spans")
    pairs = F.expr("transform(sequence(0, size(spans) div 2 - 1), i -> named_struct('first', start + spans[2 * i], 'end', start + spans[2 * i + 1]))")
    out = materialize(found.select("ident", pairs.alias("p")).groupBy("ident").agg(F.flatten(F.collect_list("p")).alias("found")), "found")
    for frame in (members, groups, wanted, decided):
        discard(frame)
    return out


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    ident = F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash")).alias("ident")
    return docs.select(ident, text_of(text).alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` is what is left, as bytes."""
    nothing = F.array().cast("array<struct<first:bigint,end:bigint>>")
    rows = _rows(docs, doc_id, text).join(repeats(docs, doc_id, text).hint("merge"), "ident", "left")
    rows = rows.select(F.col("ident.doc_id").alias("doc_id"), "text", F.coalesce("found", nothing).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            sizes, removed, runs, kept = _cut(batch)
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(kept, pa.binary()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], *fields, T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]))
