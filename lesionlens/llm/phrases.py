"""Phrase collocations: runs of two to four words that occur together more than their parts explain.

*Shards.* A task turns its texts into a count transducer, an acyclic automaton whose paths are the n-grams met and whose
weights are their counts: the sorted n-grams of each piece of text are merged into it, so equal paths are one. Kept in
lexicographic order, the n-grams below a state are a range, and the state's weight is the sum over that range. A full
transducer is emitted in parts, each holding the paths of one range of (hashed) prefixes.

*Union.* The parts of one prefix range meet in one task, their union adds the weights of equal paths, and range sums give
the count of every phrase there: of two words in a first union, of three and four words in a second one whose prefix is three
words long, so that neither a frequent word nor a frequent pair is one task's work.

*Composition.* A phrase's score needs the counts of its first words and of the rest; candidates are cut at each place and
both parts are looked up in the joined output of the unions.

A phrase occurs at most as often as each of its parts. So words below ``least`` end a path in the first union, pairs below it
in the second one. The sets of frequent words and pairs are broadcast up to ``WORDS`` and ``PAIRS`` entries; beyond that paths
are not ended early, which costs larger transducers and changes no result.

Words are told apart by 63-bit hashes of language and word. All sums, products and quotients of counts are exact (products
as decimals of 38 digits).

Defined cases: a null text is empty; a null language counts as ``und``, with a language of that name; repeated rows count
each; an empty table gives an empty result; ids and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lesionlens.llm import kernels
from lesionlens.llm.columns import sized, text_of
from lesionlens.session import materialize

LONGEST = 4
LEAST = 30
KEPT = 2_000
SCALE = 2_000_000
CONTAINED = (100, 80)  # a phrase is dropped if 100 * f(longer) >= 80 * f(phrase)
UNKNOWN = "und"

WORDS, PAIRS = 4_000_000, 8_000_000  # entries that are broadcast, 8 bytes each
FULL = 1_000_000  # paths of a transducer that is emitted
PIECE = 2_000_000
RANGES = 4  # prefix ranges for each shuffle partition
SPREAD = 64

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[10, 11, 12, 13, *b".,;:!?"]] = True
BETWEEN = SEPARATOR.copy()
BETWEEN[[9, 32]] = True
END = -1  # after the last word of a shorter path


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(word, linked, (bytes, starts, ends), row) of all words; ``linked`` says whether the next one follows in the same piece."""
    data, offsets = kernels.utf8(batch.column("text"))
    data = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, offsets, BETWEEN)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    langs = batch.column("lang").dictionary_encode()
    raw, at = kernels.utf8(langs.dictionary.cast(pa.string()))
    salt = kernels.mix(kernels.hashes(raw, at[:-1], at[1:]) ^ np.uint64(kernels.GOLDEN))
    word = kernels.hashes(data, starts, ends)
    if len(word):
        word = kernels.mix(word + salt[langs.indices.to_numpy()[row]])
    cuts = np.concatenate([[0], np.cumsum(SEPARATOR[data])])
    linked = np.zeros(len(word), bool)
    linked[:-1] = (row[1:] == row[:-1]) & (cuts[starts[1:]] == cuts[ends[:-1]])
    return (word >> np.uint64(1)).astype(np.int64), linked, (data, starts, ends), row


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kernels.pieces(batches, limit=PIECE):
        word, _, (data, starts, ends), row = tokens(batch)
        order, begin = kernels.groups(word)
        one, count = order[begin], np.diff(np.append(begin, len(order)))
        langs = batch.column("lang").cast(pa.string()).take(pa.array(row[one]))
        yield pa.RecordBatch.from_arrays([langs, kernels.strings(data, starts[one], ends[one]), pa.array(word[one]), pa.array(count)], names=["lang", "word", "id", "f"])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kernels.mix(a.view(np.uint64) * np.uint64(kernels.BASE) + kernels.mix(b.view(np.uint64) + np.uint64(1)))


def _found(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, is there) of values in a sorted array."""
    at = np.minimum(np.searchsorted(sorted_, values), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == values if len(sorted_) else np.zeros(len(values), bool)


class CountTransducer:
    """Paths of up to ``order`` words in lexicographic order, each with its count; shorter paths end with ``END``."""

    def __init__(self, paths: np.ndarray, counts: np.ndarray):
        """``paths``: (n, order), in any order, repeats allowed."""
        key = np.zeros(len(paths), np.uint64)
        for column in paths.T:
            key = kernels.mix(key * np.uint64(kernels.BASE) + column.astype(np.int64).view(np.uint64))
        order, begin = kernels.groups(key)
        paths, counts = paths[order[begin]], np.add.reduceat(counts[order], begin) if len(begin) else counts
        order = np.lexsort(paths.T[::-1])
        self.paths, self.counts = paths[order], counts[order]

    def __len__(self) -> int:
        return len(self.paths)

    @staticmethod
    def union(parts: list[CountTransducer]) -> CountTransducer:
        return CountTransducer(np.concatenate([p.paths for p in parts]), np.concatenate([p.counts for p in parts]))

    def weights(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(prefixes, sums): every prefix of ``length`` words and the sum of the counts in its range."""
        if not len(self):
            return self.paths[:, :length], self.counts
        new = np.ones(len(self), bool)
        new[1:] = (self.paths[1:, :length] != self.paths[:-1, :length]).any(axis=1)
        begin = np.flatnonzero(new)
        sums, prefixes = np.add.reduceat(self.counts, begin), self.paths[begin, :length]
        whole = prefixes[:, length - 1] != END
        return prefixes[whole], sums[whole]

    def ranges(self, prefix: int, n: int) -> np.ndarray:
        """The range of each path: a hash of its first ``prefix`` words modulo n."""
        key = np.zeros(len(self), np.uint64)
        for column in self.paths[:, :prefix].T:
            key = kernels.mix(key * np.uint64(kernels.BASE) + column.astype(np.int64).view(np.uint64) + np.uint64(3))
        return (key % np.uint64(n)).astype(np.int64)


def _windows(ids: np.ndarray, linked: np.ndarray, shortest: int, longest: int) -> np.ndarray:
    """(n, longest) paths of at least ``shortest`` words, one for each word they can start at."""
    start = np.ones(len(ids), bool)
    for k in range(shortest - 1):
        start[: len(ids) - k] &= linked[k:]
        start[len(ids) - k :] = False
    at, alive = np.flatnonzero(start), None
    out = np.full((len(at), longest), END, ids.dtype)
    for k in range(longest):
        if k < shortest:
            out[:, k] = ids[at + k]
            continue
        alive = linked[at + k - 1] if alive is None else alive & linked[np.minimum(at + k - 1, len(ids) - 1)]
        out[alive, k] = ids[at[alive] + k]
    return out


def _shards(docs: DataFrame, shortest: int, longest: int, words: np.ndarray | None, pairs: np.ndarray | None, ranges: int) -> DataFrame:
    """(range, w1, ..., n): the transducers of the tasks, cut by prefix range; a path's words are places in ``words`` if there are any."""
    shared, narrow = docs.sparkSession.sparkContext.broadcast((words, pairs)), np.int32 if words is not None else np.int64
    columns = [f"w{k + 1}" for k in range(longest)]

    def emit(built: CountTransducer) -> pa.RecordBatch:
        of = built.ranges(shortest, ranges)
        order = np.argsort(of, kind="stable")
        begin = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1])) if len(order) else order
        bounds = pa.array(np.append(begin, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(built.paths[order, k].astype(narrow))) for k in range(longest)]
        counts = pa.ListArray.from_arrays(bounds, pa.array(built.counts[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(of[order][begin]), *lists, counts], names=["range", *columns, "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        held: list[CountTransducer] = []
        merged = 0
        for batch in kernels.pieces(batches, limit=PIECE):
            ids, linked, _, _ = tokens(batch)
            if words is not None:
                ids, known = _found(words, ids)
                linked[:-1] &= known[:-1] & known[1:]
            if pairs is not None:
                at = np.flatnonzero(linked)
                linked[at] = _found(pairs, _pair(ids[at], ids[at + 1]))[1]
            paths = _windows(ids.astype(narrow), linked, shortest, longest)
            held.append(CountTransducer(paths, np.ones(len(paths), np.int64)))
            if sum(map(len, held)) > 2 * max(merged, FULL // 2):
                held = [CountTransducer.union(held)]
                merged = len(held[0])
                if merged >= FULL:
                    yield emit(held[0])
                    held, merged = [], 0
        if held:
            yield emit(CountTransducer.union(held))

    kind = "int" if words is not None else "bigint"
    return docs.mapInArrow(build, ", ".join(["range bigint", *[f"{c} array<{kind}>" for c in columns], "n array<int>"]))


def _union(shards: DataFrame, shortest: int, longest: int, words: np.ndarray | None, least: int) -> DataFrame:
    """(phrase, f) of all phrases of ``shortest`` to ``longest`` words with f >= least; a phrase is an array of word ids."""
    shared = shards.sparkSession.sparkContext.broadcast(words)

    def phrases(parts: list[CountTransducer]) -> Iterator[pa.RecordBatch]:
        whole = CountTransducer.union(parts)
        for length in range(shortest, longest + 1):
            prefixes, sums = whole.weights(length)
            prefixes, sums = prefixes[sums >= least], sums[sums >= least]
            ids = prefixes.ravel() if shared.value is None else shared.value[prefixes.ravel()]
            bounds = pa.array((np.arange(len(sums) + 1) * length).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int64))), pa.array(sums)], names=["phrase", "f"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, of, size = [], None, 0
        for batch in batches:
            lists = [batch.column(f"w{k + 1}") for k in range(longest)]
            bounds = lists[0].offsets.to_numpy()
            flat = np.stack([x.values.to_numpy() for x in lists], axis=1)
            counts, ranges = batch.column("n").values.to_numpy().astype(np.int64), batch.column("range").to_numpy()
            for i, r in enumerate(ranges.tolist()):
                if of is not None and r != of:
                    yield from phrases(parts)
                    parts, size = [], 0
                part = CountTransducer.__new__(CountTransducer)  # sorted already
                part.paths, part.counts = flat[bounds[i] : bounds[i + 1]].copy(), counts[bounds[i] : bounds[i + 1]].copy()
                parts.append(part)
                of, size = r, size + len(part)
                if size > 2 * FULL:
                    parts = [CountTransducer.union(parts)]
                    size = len(parts[0]) // 2
        if parts:
            yield from phrases(parts)

    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "phrase array<bigint>, f bigint")


def _sorted_ids(frame: DataFrame, column: Column, limit: int) -> np.ndarray | None:
    """Up to ``limit`` ids, sorted; None if there are more."""
    if frame.count() > limit:
        return None
    return np.sort(frame.select(column.alias("x")).toArrow().column("x").to_numpy())


def _exact(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(18,0)")


def quotient(a: str, *parts: str) -> Column:
    """floor(SCALE * a / sum of parts)."""
    below = _exact(F.col(parts[0]))
    for p in parts[1:]:
        below = below + _exact(F.col(p))
    return F.call_function("div", _exact(SCALE) * _exact(F.col(a)), below).cast("bigint")


def covers(longer: str, a: str) -> Column:
    """Whether a longer phrase has so many occurrences that one within it is dropped; False where there is none."""
    whole, share = CONTAINED
    return F.coalesce(_exact(whole) * _exact(F.col(longer)) >= _exact(share) * _exact(F.col(a)), F.lit(False))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(lang, word, id, f) of all words, and (phrase, f) of all phrases of 2 to 4 words with f >= least."""
    spark = docs.sparkSession
    rows = docs.select(text_of(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = rows.mapInArrow(_words, "lang string, word string, id bigint, f bigint")
    vocabulary = materialize(counted.groupBy("lang", "word").agg(F.min("id").alias("id"), F.sum("f").alias("f")), "words")
    known = _sorted_ids(vocabulary.where(F.col("f") >= least), F.col("id"), words)
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    two = materialize(_union(_shards(rows, 2, 2, known, None, ranges), 2, 2, known, least), "pairs")
    linked = None
    if two.count() <= pairs:
        both = two.select(F.col("phrase")[0].alias("a"), F.col("phrase")[1].alias("b")).toArrow()
        a, b = (both.column(c).to_numpy() for c in ("a", "b"))
        if known is not None:
            a, b = np.searchsorted(known, a), np.searchsorted(known, b)
        linked = np.sort(_pair(a, b))
    more = materialize(_union(_shards(rows, 3, LONGEST, known, linked, ranges), 3, LONGEST, known, least), "longer")
    return vocabulary, two.unionByName(more)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, kept: int = KEPT, words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``kept`` phrases.

    A phrase of 2 to 4 words with a = f(phrase) >= least is a candidate. Cut after its first k words into parts of l and r
    occurrences, its score is floor(2,000,000 a / (l + r)), that of its lowest cut, ties to the smallest k. A candidate within a
    longer one that has at least 80 % of its occurrences is dropped. Order: score, then a, both descending, then phrase by bytes.
    """
    vocabulary, candidates = phrase_counts(docs, text, lang, least, words, pairs)
    frequent = vocabulary.where(F.col("f") >= least)
    parts = materialize(candidates.where(F.size("phrase") < LONGEST).unionByName(frequent.select(F.array("id").alias("phrase"), "f")), "parts")

    def looked_up(side: str) -> DataFrame:
        return sized(parts.select(F.col("phrase").alias(side), F.col("f").alias(side[0])))

    cut = candidates.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))
    cut = cut.join(looked_up("left"), "left").join(looked_up("right"), "right")
    scored = cut.groupBy("phrase", "a").agg(F.min(F.struct(quotient("a", "l", "r").alias("score"), "k", "l", "r")).alias("cut"))

    sub = F.explode(F.expr("flatten(transform(sequence(2, size(phrase) - 1), m -> transform(sequence(1, size(phrase) - m + 1), s -> slice(phrase, s, m))))"))
    within = candidates.where(F.size("phrase") > 2).select(sub.alias("inner"), "f").groupBy("inner").agg(F.max("f").alias("longer"))
    scored = scored.join(within, scored.phrase == within.inner, "left").where(~covers("longer", "a")).select("phrase", "a", "cut")

    names = sized(materialize(frequent.select(F.col("id"), "lang", "word"), "names"))
    spelt = scored.select("phrase", "a", "cut", F.posexplode("phrase").alias("at", "id")).join(names, "id")
    spelt = spelt.groupBy("phrase", "a", "cut").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    flat = spelt.select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    inner = Window.partitionBy("lang", "salt").orderBy(*order)
    best = flat.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= kept)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= kept)
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
