"""Ranked lexical search: many queries over all documents at once, with the sums that queries share computed once.

*Mining.* Terms that occur in exactly the same queries form one sum. Of the sums that are left, the pair that most
queries hold together becomes a sum of its own and takes the pair's place in all of them, again and again, until no two
queries share a pair. What results is a sharing DAG: its leaves are terms, an inner node is the sum of two nodes, and
each query is a list of nodes whose leaves are its terms, each once. Mining decides what is added when, never a result.

*Documents.* One pass turns each document into its length and the counts of the query terms in it; that table is
written. Document count, total length and document frequencies are aggregates of it. A second pass over that table
computes, for a batch of documents, the accumulators of all nodes level by level, each once, then the queries' scores from
their nodes; a task keeps the best ``depth`` documents of each query. Those meet in a window by query, in two steps.

Queries are taken in blocks of about ``BLOCK_TERMS`` terms; a block's terms and DAG are all that is broadcast or passes
through the driver. Every block is held against all documents.

A term is a run of ASCII letters, digits and characters above 0x7F; only A-Z are lower-cased. Scores are 64-bit
integers, see :func:`search`. Query terms are told apart by 64-bit hashes.

Defined cases: a null or empty text has no terms and is found by nothing, as a query it finds nothing; repeated rows of
documents are documents of their own; a document with a null id ranks before others of its score; repeated queries of one id
and text count once, those of one id and different texts are ranked apart; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lesionlens.llm import kernels
from lesionlens.session import materialize

DEPTH = 50
BLOCK_TERMS = 500_000
BATCH_CELLS = 4_000_000  # accumulators of a batch of documents
LONG_LIST = 400  # queries with more shared sums than this mine no pairs of their own
SPREAD = 64  # first step of the final ranking

BETWEEN = np.ones(256, bool)
BETWEEN[48:58] = BETWEEN[65:91] = BETWEEN[97:123] = BETWEEN[128:] = False


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first): the terms of text i are first[i] to first[i + 1]."""
    data, offsets = kernels.utf8(column)
    data = kernels.LOWER[data]
    starts, ends, first = kernels.words(data, offsets, BETWEEN)
    return kernels.hashes(data, starts, ends), first


@dataclass
class SharingDag:
    """Nodes 0 to len(terms) - 1 are the terms, sorted by hash; node len(terms) + i is the sum of left[i] and right[i]."""

    terms: np.ndarray
    left: np.ndarray
    right: np.ndarray
    queries: list[np.ndarray]

    @property
    def nodes(self) -> int:
        return len(self.terms) + len(self.left)

    def levels(self) -> list[np.ndarray]:
        """Inner nodes, those of a level only need levels before it."""
        level = np.zeros(self.nodes, np.int64)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            level[len(self.terms) + i] = 1 + max(level[a], level[b])
        inner = np.arange(len(self.terms), self.nodes)
        return [inner[level[inner] == k] for k in range(1, int(level.max(initial=0)) + 1)]

    def evaluate(self, leaves: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """(queries x documents) scores from (nodes x documents) accumulators whose first rows are filled."""
        for nodes in levels:
            at = nodes - len(self.terms)
            leaves[nodes] = leaves[self.left[at]] + leaves[self.right[at]]
        sizes = np.array([len(q) for q in self.queries])
        out = np.zeros((len(sizes), leaves.shape[1]), np.int64)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([self.queries[i] for i in some])
            out[some] = np.add.reduceat(leaves[flat], np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
        return out


def mine(queries: list[np.ndarray]) -> SharingDag:
    """The sharing DAG of queries, each an array of distinct term hashes."""
    terms = np.unique(np.concatenate([*queries, np.zeros(0, np.uint64)]))
    lists = [np.searchsorted(terms, np.unique(q)).tolist() for q in queries]
    holders: dict[int, list[int]] = defaultdict(list)
    for q, nodes in enumerate(lists):
        for t in nodes:
            holders[t].append(q)
    left: list[int] = []
    right: list[int] = []

    def total(a: int, b: int) -> int:
        left.append(a)
        right.append(b)
        return len(terms) + len(left) - 1

    together: dict[tuple[int, ...], int] = {}
    for t, held in holders.items():
        if len(held) > 1:
            key = tuple(held)
            together[key] = total(together[key], t) if key in together else t
    shared: list[set[int]] = [set() for _ in queries]
    for held, node in together.items():
        for q in held:
            shared[q].add(node)
    of_pair: dict[tuple[int, int], set[int]] = defaultdict(set)
    for q, nodes in enumerate(shared):
        if len(nodes) <= LONG_LIST:
            ordered = sorted(nodes)
            for i, a in enumerate(ordered):
                for b in ordered[i + 1 :]:
                    of_pair[a, b].add(q)
    heap = [(-len(held), pair) for pair, held in of_pair.items() if len(held) > 1]
    heapq.heapify(heap)
    while heap:
        n, pair = heapq.heappop(heap)
        held = of_pair.get(pair, set())
        if len(held) != -n:  # counted before another pair took one of its nodes
            if len(held) > 1:
                heapq.heappush(heap, (-len(held), pair))
            continue
        node, fresh = total(*pair), set()
        for q in sorted(held):
            shared[q] -= set(pair)
            for x in shared[q]:
                for old in pair:
                    of_pair[min(old, x), max(old, x)].discard(q)
                of_pair[x, node].add(q)
                fresh.add((x, node))
            shared[q].add(node)
        del of_pair[pair]
        for p in fresh:
            if len(of_pair[p]) > 1:
                heapq.heappush(heap, (-len(of_pair[p]), p))
    alone = [[t for t in nodes if len(holders[t]) == 1] for nodes in lists]
    rows = [np.array(sorted(s) + a, np.int64) for s, a in zip(shared, alone)]
    return SharingDag(terms, np.array(left, np.int64), np.array(right, np.int64), rows)


def _counts(docs: DataFrame, doc_id: str, text: str, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts) of every row: number of terms, and the wanted ones with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in kernels.pieces(batches):
            term, first = terms_of(batch.column("text"))
            n = np.diff(first)
            at = np.minimum(np.searchsorted(wanted, term), max(len(wanted) - 1, 0))
            hit = np.flatnonzero(wanted[at] == term) if len(wanted) else np.zeros(0, np.int64)
            row = np.searchsorted(first, hit, "right") - 1
            cells, counts = np.unique(row * max(len(wanted), 1) + at[hit], return_counts=True)
            row, which = np.divmod(cells, max(len(wanted), 1))
            bounds = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v.astype(k))) for v, k in ((which, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(count, T.StructType([rows.schema["doc_id"], *fields]))


def length_part(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """50 + 50 * n * N div L, also where the product passes 64 bits."""
    if len(n) and 50 * int(n.max()) * docs >= 2**63:
        return np.array([50 + 50 * int(x) * docs // length for x in n.tolist()], np.int64)
    return 50 + 50 * n * docs // max(length, 1)


class Best:
    """The best ``depth`` documents of each query so far: highest score, then smallest id, null first."""

    def __init__(self, queries: int, depth: int):
        self.depth, self.least = depth, np.ones(queries, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        query, at = np.nonzero(scores >= self.least[:, None])
        self.held.append((query, scores[query, at], ids[at]))
        self.size += len(query)
        if self.size > 20 * self.depth * len(self.least):
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, ident = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((ident, -score, query))
        query, score, ident = query[order], score[order], ident[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.depth
        last = place == self.depth - 1
        self.least[query[last]] = score[last]
        self.held = [(query[keep], score[keep], ident[keep])]
        self.size = int(keep.sum())
        return self.held[0]


NULL_FIRST = np.iinfo(np.int64).min  # stands for a null id inside a task


def _candidates(counted: DataFrame, dag: SharingDag, weight: np.ndarray, docs: int, length: int, depth: int) -> DataFrame:
    """(query, doc_id, score): the best documents of each task, query being its number in the block."""
    shared = counted.sparkSession.sparkContext.broadcast((dag, weight))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, weight = shared.value
        levels, step = dag.levels(), max(16, BATCH_CELLS // max(dag.nodes, 1))
        best = Best(len(dag.queries), depth)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                found, ids = batch.column("terms"), batch.column("doc_id").cast(pa.int64()).fill_null(NULL_FIRST).to_numpy()
                which, times = found.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
                m = length_part(batch.column("n").to_numpy(), docs, length)
                cells = np.zeros((dag.nodes, batch.num_rows), np.int64)
                cells[which, row] = weight[which] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
                best.add(dag.evaluate(cells, levels), ids)
        query, value, ident = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ident, pa.int64(), mask=ident == NULL_FIRST), pa.array(value)], names=["query", "doc_id", "score"])

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(score, "query bigint, doc_id bigint, score bigint")


def ranked(rows: DataFrame, by: list[str], depth: int) -> DataFrame:
    """The first ``depth`` rows of each group with their ``rank``, in two steps so that no task sees all rows of a group."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    inner = Window.partitionBy(*by, "salt").orderBy(*order)
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(inner)).where(F.col("rank") <= depth)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= depth).drop("salt")


def _query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, item, terms): distinct items, ``item`` being a key of id and text."""
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            term, first = terms_of(batch.column("text"))
            own = [np.unique(term[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "item", "terms"])

    fields = [T.StructField("item", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(cut, T.StructType([rows.schema["item_id"], *fields]))


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", depth: int = DEPTH, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item_id, item, rank, doc_id, score): the ``depth`` documents with the highest score above 0 of each item.

    With N documents that have a term, L terms in all, n in the document, df documents holding a term and tf occurrences:
    weight w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 50 + (50 n N div L), and the score is the sum of
    w ((1,000,000,000 tf) div (1000 tf + 20 m)) over the item's distinct terms. Ids of documents are integers.
    """
    queries = materialize(_query_terms(items, item_id, text), "queries")
    blocks = -(-(queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms)
    out = None
    for block in range(max(blocks, 1)):
        part = queries.where(F.pmod("item", F.lit(max(blocks, 1))) == block)
        found = _search_block(docs, part, doc_id, text, depth)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, part: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    rows = part.orderBy("item").toArrow()
    lists = rows.column("terms").combine_chunks()
    dag = mine([x.values.to_numpy().view(np.uint64) for x in lists])
    counted = materialize(_counts(docs, doc_id, text, dag.terms), "counted")
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = counted.where(F.size("terms") > 0)
    frequency = np.zeros(len(dag.terms), np.int64)
    for term, df in holding.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
        frequency[term] = df
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
    best = ranked(_candidates(holding, dag, weight, n_docs, length, depth), ["query"], depth)
    keys = rows.select(["item_id", "item"]).append_column("query", pa.array(np.arange(rows.num_rows)))
    field = T.StructType([part.schema["item_id"], T.StructField("item", T.LongType()), T.StructField("query", T.LongType())])
    names = docs.sparkSession.createDataFrame(keys.cast(pa.schema([(f.name, to_arrow_type(f.dataType)) for f in field])), field)
    return best.join(F.broadcast(names), "query").select("item_id", "item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
