"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, twice over at most. A packet's virtual finish time is the words of its
queue up to its end, divided by the source's target. All packets are sorted globally by that time and the mix is what
comes before the running total reaches the budget, which is the only thing that ends a queue; the packet at which the budget is
spent is split. A document is one packet, but for the one that its queue serves at virtual time 1, when a fair
server spends the budget: that one is cut into packets of ``QUANTUM`` words, so that a long document does not make its source miss its
target by its length. The one word that is half served at time 1 has the next number above 1 as its finish time, so of what is left
of the budget then, less than a word for each source, no source takes two words.

The shuffle is the order of md5(seed:doc_id). Cumulative sizes need no task that sees a whole source: rows are
grouped by the first digits of that digest, sums of groups give each group's start, and a window inside a
group the rest. The global running total is made the same way over the range partitions of the sort.

Defined cases: a null text has size 0; the null source is a source, ordered last; a document of size 0 is
never taken; repeated rows queue one behind the other, each in its own right; rows with a null id are ordered
first; an empty table gives an empty mix; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lesionlens.llm.columns import text_of, whole_row, word_count
from lesionlens.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
QUANTUM = 1  # words
AFTER = 1 + 2.0**-52


def queues(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, digits: int = 3
) -> DataFrame:
    """(doc_id, source, skey, size, place, start): every document with its place in its source's queue.

    ``start`` is the summed size of the documents before it. Groups of ``digits`` hex digits hold equal
    shares of a source, 4,096 by default.
    """
    name = F.col(source).cast("string")
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), name.alias("source"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("skey"),
        word_count(text_of(text)).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("place"),
    ), "sizes").withColumn("part", F.substring("place", 1, digits))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("skey", "part").agg(F.sum("size").alias("total"))
    parts = parts.select("skey", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("skey", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(parts.hint("merge"), ["skey", "part"])
    start = (F.col("base") + F.col("upto") - F.col("size")).alias("start")
    return placed.select("doc_id", "source", "skey", "size", "place", start)


def targets(queued: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(skey, source_size, target) of each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A
    target stops at ``passes`` times its source's size and the excess is shared again by weight: with
    sources in the order of limit by weight, those before the water level are at their limit. The table has
    a row for each source, so its windows are small.
    """
    sizes = queued.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    sizes = sizes.withColumn("turn", turn).withColumn("weight", F.get(cycle, F.col("turn") % len(weights)))
    sizes = sizes.withColumn("limit", F.col("source_size") * passes)
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "turn")
    done = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    sizes = sizes.withColumn("level", (budget - done) / left)
    sizes = sizes.withColumn("full", F.col("limit") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    return sizes.select(
        "skey", "source_size",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * level).alias("target"),
    )


def packets(queued: DataFrame, passes: int = PASSES, quantum: int = QUANTUM) -> DataFrame:
    """(skey, start, from, doc_id, size, turn, words, finish) of every packet of the queues, served ``passes`` times over."""
    served = queued.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
    served = served.withColumn("first", F.col("start") + F.col("turn") * F.col("source_size"))
    in_service = (F.col("first") < F.col("target")) & (F.col("first") + F.col("size") > F.col("target"))
    step = F.when(in_service, F.lit(quantum)).otherwise(F.col("size")).cast("bigint").alias("step")
    cut = served.select("*", step).withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("step"))))
    cut = cut.withColumn("words", F.least("step", F.col("size") - F.col("at"))).withColumn("from", F.col("first") + F.col("at"))
    half = (F.col("from") < F.col("target")) & (F.col("from") + F.col("words") > F.col("target"))
    cut = cut.withColumn("finish", F.when(half, F.lit(AFTER)).otherwise((F.col("from") + F.col("words")) / F.col("target")))
    return cut.select("skey", "start", "from", "doc_id", "size", "turn", "words", "finish")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(queued documents with source_size and target, the mix).

    The mix has a row for each packet taken: (skey, start, doc_id, size, turn, words, finish, position), in the order of ``finish``,
    the virtual finish time; ``position`` is the running total of words up to its end, the last one's being the budget.
    """
    queued = queues(docs, doc_id, text, source, seed)
    queued = materialize(queued.join(targets(queued, weights, share, passes), "skey"), "queues")
    order = ["finish", "skey", "from"]
    ranged = materialize(
        packets(queued, passes).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()), "ranged",
    )
    pieces = ranged.groupBy("piece").agg(F.sum("words").alias("total"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("piece", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    budget = queued.agg(F.floor(F.sum("size") * F.lit(share)).alias("b")).select("b").scalar()
    line = ranged.join(pieces, "piece").withColumn("before", F.col("base") + F.sum("words").over(inside) - F.col("words"))
    line = line.withColumn("words", F.least("words", budget - F.col("before"))).where("words > 0")
    line = line.withColumn("position", F.col("before") + F.col("words"))
    return queued, line.select("skey", "start", "doc_id", "size", "turn", "words", "finish", "position")


def taken(queued: DataFrame, line: DataFrame) -> DataFrame:
    """Every queued document with ``taken``, the words that the mix takes of it, repeats counted."""
    key = ["skey", "start", "size"]  # documents with words have a start of their own
    sums = line.groupBy(*key).agg(F.sum("words").alias("taken"))
    return queued.join(sums.hint("merge"), key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how
) -> DataFrame:
    """The documents that the mix takes, once each, with the columns of ``docs`` and ``taken``: the words of
    it that the mix holds, up to ``passes`` times its size. Of rows with equal id, source and size each takes one's share."""
    sums = taken(*mix(docs, doc_id, text, source, **how)).where("taken > 0")
    key = ["_id", "_source", "_size"]
    sums = sums.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("skey").alias("_source"), F.col("size").alias("_size"), "taken")
    shares = sums.groupBy(*key).agg(F.sort_array(F.collect_list("taken"), asc=False).alias("_shares"))
    name = F.col(source).cast("string")
    rows = docs.select(
        whole_row(docs).alias("row"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("_source"), word_count(text_of(text)).alias("_size"),
    ).join(shares.hint("merge"), key)
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.col(f"row.`{text}`"))))
    rows = rows.withColumn("_taken", F.get("_shares", turn - 1)).where(F.col("_taken").isNotNull())
    names = docs.columns
    extra = "taken" if "taken" not in names else "taken_by_mix"
    return rows.select(*[F.col("row")[c].alias(c) for c in names], F.col("_taken").alias(extra))
