"""Repeated passages: windows of ``WINDOW`` words that also start elsewhere, found with FM-indexes over shards.

*Shards by content.* A window is filed under its anchor, the run of ``ANCHOR`` words inside it with the smallest hash, so
equal windows share an anchor, wherever they stand, and meet in one shard; no document is streamed past shards that
cannot hold its windows. Successive windows with one anchor form a segment. Anchors that occur once are dropped;
equal segments become one with a weight. Segments of anchors above ``HOT`` occurrences are cut into
single windows, filed each under its own hash and summed the same way, so that a passage in a third of all
documents is not one task's work.

*Index.* A shard's segments, spelt in runs of five words at stride five (five phases), are indexed: suffix order by
prefix doubling, Burrows-Wheeler transform, packed wavelet matrix. Every window of the shard is searched
backwards, all at once; its matching statistic is the number of steps after which it still occurs twice, weights
counted, and windows that keep this over their full length are reported. A shard holds about ``SHARD_WORDS`` words.

Words are compared by 64-bit hashes. A word covered by a repeated window is removed.

Defined cases: a null or empty text has no words; texts below WINDOW words lose nothing; repeated rows are occurrences
of their own and have the same result; rows with the same id and different texts are kept apart; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lesionlens.llm import kernels
from lesionlens.session import materialize

WINDOW = 35
ANCHOR = 5
STEPS = WINDOW // ANCHOR
SPAN = WINDOW - ANCHOR + 1  # places for an anchor in a window
SHARD_WORDS = 1_000_000
HOT = 20_000  # at least; never so few that more than HOT_MOST anchors are hot
HOT_MOST = 100_000


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * kernels.powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _hash_of(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return kernels.mix((prefix[stop] - prefix[start]) * kernels.powers(len(prefix))[1][start] + (stop - start).astype(np.uint64))


def _grams(word: np.ndarray) -> np.ndarray:
    n = max(len(word) - ANCHOR + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(ANCHOR):
        total += word[j : j + n] * kernels.PLACES[j]
    return kernels.mix(total)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for all i."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(counts) else starts


def segments_of(column: pa.Array, hot: np.ndarray) -> dict[str, np.ndarray]:
    """anchor, key, digest, row and at of the segments; at is 32 * first word + windows - 1. A key of 0 is the anchor."""
    data, offsets = kernels.utf8(column)
    starts, ends, first = kernels.words(data, offsets)
    word = kernels.hashes(data, starts, ends)
    g = _grams(word)
    limit = np.repeat(first[1:], np.diff(first))
    window = np.flatnonzero(np.arange(len(word)) + WINDOW <= limit)
    best = np.arange(len(g))
    for step in (1, 2, 4, 8, SPAN - 16):  # leftmost smallest of 2, 4, 8, 16, SPAN places
        a, b = best[:-step], best[step:]
        best = np.where(g[b] < g[a], b, a)
    anchor = best[window] if len(window) else window
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(window)))
    s, anchor = window[begin], anchor[begin]
    label = kernels.mix(g[anchor] + np.uint64(1)).view(np.int64) if len(s) else np.zeros(0, np.int64)
    key, prefix = np.zeros(len(s), np.uint64), _prefix(word)
    is_hot = np.isin(label, hot) if len(hot) else np.zeros(len(s), bool)
    if is_hot.any():
        single = _spread(s[is_hot], count[is_hot])
        of = np.repeat(label[is_hot], count[is_hot])
        own = kernels.mix(_hash_of(prefix, single, single + WINDOW) ^ of.view(np.uint64))
        s, count = np.concatenate([s[~is_hot], single]), np.concatenate([count[~is_hot], np.ones(len(single), np.int64)])
        anchor = np.concatenate([anchor[~is_hot], single])
        label, key = np.concatenate([label[~is_hot], of]), np.concatenate([key[~is_hot], own | np.uint64(1)])
    digest = kernels.mix(_hash_of(prefix, s, s + count + WINDOW - 1) + (anchor - s).astype(np.uint64))
    row = np.searchsorted(first, s, "right") - 1
    return {"anchor": label, "key": key.view(np.int64), "digest": digest.view(np.int64), "row": row, "at": (s - first[row]) * 32 + count - 1}


def _segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            got = segments_of(batch.column("text"), shared.value)
            ids = batch.column("ident").to_numpy()[got["row"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (got["anchor"], got["key"], got["digest"], ids, got["at"])], names=["anchor", "key", "digest", "ident", "at"]
            )

    return docs.select("ident", "text").mapInArrow(cut, "anchor bigint, key bigint, digest bigint, ident bigint, at bigint")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment, as hashes."""
    for batch in kernels.pieces(batches):
        data, offsets = kernels.utf8(batch.column("text"))
        starts, ends, first = kernels.words(data, offsets)
        word = kernels.hashes(data, starts, ends)
        wanted = batch.column("wanted")
        each = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        at = flat.field("at").to_numpy()
        begin = np.repeat(first[:-1], each) + at // 32
        count = at % 32 + WINDOW
        out = word[_spread(begin, count)]
        bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [flat.field("key"), flat.field("digest"), flat.field("weight"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.view(np.int64)))],
            names=["key", "digest", "weight", "words"],
        )


class WaveletMatrix:
    """Occurrences of a symbol in a prefix of a sequence, from one packed bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & below)
            at = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Counts patterns of up to ``depth`` symbols, each occurrence with the weight of its place. Symbol 0 separates."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth + 1:  # order of suffixes by their first span symbols
            then = np.zeros(n, np.int64)
            then[:-span] = rank[span:] + 1
            rank = np.unique(rank * (n + 2) + then, return_inverse=True)[1]
            span *= 2
        order = np.argsort(rank, kind="stable")
        self.symbols = int(text.max(initial=0)) + 1
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        self.matrix = WaveletMatrix(text[order - 1], max(1, (self.symbols - 1).bit_length()))
        names = np.arange(self.symbols)
        self.origin = self.matrix.descend(names, np.zeros(self.symbols, np.int64))

    def statistics(self, text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
        """For each pattern text[start : start + depth]: of how many of its last symbols a second occurrence is left."""
        out, live = np.zeros(len(starts), np.int64), np.arange(len(starts))
        last = text[starts + depth - 1]
        lo, hi = self.begin[last], self.begin[last + 1]
        for step in range(1, depth + 1):
            twice = self.weight[hi] - self.weight[lo] >= 2
            live, lo, hi = live[twice], lo[twice], hi[twice]
            out[live] = step
            if step == depth or not len(live):
                return out
            c = text[starts[live] + depth - 1 - step]
            base = self.begin[c] - self.origin[c]
            lo, hi = base + self.matrix.descend(c, lo), base + self.matrix.descend(c, hi)
        return out


def repeated(words: np.ndarray, bounds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each segment of a shard a bit set of its windows that occur at least twice, weights counted."""
    gram = _grams(words)
    sizes = np.diff(bounds)
    inside = _spread(bounds[:-1], sizes - ANCHOR + 1)  # places of runs of five words, none across a border
    owner = np.repeat(np.arange(len(sizes)), sizes - ANCHOR + 1)
    place = inside - bounds[:-1][owner]
    names = np.unique(gram[inside], return_inverse=True)[1] + 1
    order = np.lexsort((place, place % ANCHOR, owner))  # segment by segment, phase by phase
    owner, place, names = owner[order], place[order], names[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] % ANCHOR != place[:-1] % ANCHOR)
    spot = np.arange(len(owner)) + np.cumsum(new)  # a separator before each phase
    text, heavy = np.zeros(spot[-1] + 2, np.int64), np.zeros(spot[-1] + 2, np.int64)
    text[spot], heavy[spot] = names, weight[owner]
    window = place + WINDOW <= sizes[owner]
    found = FMIndex(text, heavy, STEPS).statistics(text, spot[window], STEPS) == STEPS
    out = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(out, owner[window][found], np.int64(1) << place[window][found])
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a shard ends at a key's border."""
    held: list[pa.RecordBatch] = []

    def shard(rows: pa.Table) -> pa.RecordBatch:
        key, digest, weight = (rows.column(c).to_numpy() for c in ("key", "digest", "weight"))
        order = np.lexsort((digest, key))  # a row that the table holds twice delivers its segments twice
        one = np.ones(len(order), bool)
        one[1:] = (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        rows = rows.take(order[one])
        words = rows.column("words").combine_chunks()
        at = words.offsets.to_numpy().astype(np.int64)
        mask = repeated(words.values.to_numpy().view(np.uint64), at, rows.column("weight").to_numpy())
        return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), rows.column("digest").combine_chunks(), pa.array(mask)], names=["key", "digest", "mask"])

    total = 0
    for batch in batches:
        held.append(batch)
        total += len(batch.column("words").flatten())
        if total >= SHARD_WORDS:
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield shard(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                total = sum(len(b.column("words").flatten()) for b in held)
    if held and sum(b.num_rows for b in held):
        yield shard(pa.Table.from_batches(held))


def _kept(batch: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    """(words, removed words, kept words joined by single spaces) of each text."""
    data, offsets = kernels.utf8(batch.column("text"))
    starts, ends, first = kernels.words(data, offsets)
    lists = batch.column("found")
    each = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    at, mask = flat.field("at").to_numpy(), flat.field("mask").to_numpy()
    change = np.zeros(len(starts) + WINDOW + 1, np.int64)
    base = np.repeat(first[:-1], each) + at // 32
    for o in range(SPAN):
        s = base[mask >> o & 1 == 1] + o
        np.add.at(change, s, 1)
        np.add.at(change, s + WINDOW, -1)
    gone = np.cumsum(change)[: len(starts)] > 0
    n = np.diff(first)
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (n > 0) if len(n) else n
    stay = np.flatnonzero(~gone)
    row = np.searchsorted(first, stay, "right") - 1
    more = np.append(row[1:] == row[:-1], False)[: len(stay)]  # a kept word of the same text follows
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts[stay], 1)
    np.add.at(edge, ends[stay] + more, -1)
    keep = np.cumsum(edge[:-1]) > 0
    out = data.copy()
    out[ends[stay[more]]] = 32
    size = np.concatenate([[0], np.cumsum(keep)])
    text, at = out[keep].tobytes(), size[offsets]
    return n.tolist(), removed.tolist(), [text[a:b] for a, b in zip(at[:-1], at[1:])]


def _identity(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("\u0001"), F.col(text))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, found): for each text with repeated windows its segments, (at, mask)."""
    rows = docs.select(_identity(doc_id, text).alias("ident"), F.col(text).alias("text"))
    anchors = _segments(rows, np.zeros(0, np.int64)).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    anchors = materialize(anchors, "anchors")
    bound = max(HOT, (anchors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_MOST)
    hot = np.sort(np.array([r[0] for r in anchors.where(F.col("n") > bound).select("anchor").collect()], np.int64))
    shared = _segments(rows, hot).join(anchors.hint("merge"), "anchor", "left_semi")
    key = F.when(F.col("key") == 0, F.col("anchor")).otherwise(F.col("key")).alias("key")
    members = materialize(shared.select(key, "digest", "ident", "at"), "members")
    groups = members.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("ident", "at")).alias("first"))
    wanted = groups.select(F.col("first.ident").alias("ident"), F.struct(F.col("first.at").alias("at"), "key", "digest", "weight").alias("w"))
    wanted = materialize(wanted.groupBy("ident").agg(F.collect_list("w").alias("wanted")), "wanted")
    contents = rows.join(wanted.hint("merge"), "ident").select("text", "wanted").mapInArrow(_contents, "key bigint, digest bigint, weight bigint, words array<bigint>")
    contents = materialize(contents, "contents")
    total = contents.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    masks = contents.repartition(shards, "key").sortWithinPartitions("key").mapInArrow(_search, "key bigint, digest bigint, mask bigint")
    masks = materialize(masks.where("mask <> 0"), "masks")
    found = members.join(masks.hint("merge"), ["key", "digest"]).select("ident", F.struct("at", "mask").alias("f")).distinct()
    return found.groupBy("ident").agg(F.collect_list("f").alias("found"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every row."""
    found = materialize(repeats(docs, doc_id, text), "found")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _identity(doc_id, text).alias("ident"))
    nothing = F.array().cast("array<struct<at:bigint,mask:bigint>>")
    rows = rows.join(found.hint("merge"), "ident", "left").select("doc_id", "text", F.coalesce("found", nothing).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            n, removed, texts = _kept(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    long, string = T.LongType(), T.StringType()
    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("kept_text", string), T.StructField("kept_sha256", string)]))
