"""Benchmark decontamination by template canonicalisation.

A text is rewritten to a template: numbers (digits or number words), units after a number, and names
(capitalised words inside a sentence) become typed placeholders; the rest is lower-cased and loses its
punctuation. Runs of ``WINDOW`` template words are compared by hash, items and documents at every position. Windows
with fewer than ``LITERALS`` ordinary words are no evidence: they name no document, but along an alignment that another
window has found they count. Documents with a hit are aligned with the values that the placeholders stand for.

*Whole items.* Items that windows with evidence need not find (short ones, those without spaces, those of few ordinary
words) are also looked for as a whole: all their words in a row, lower-cased, without punctuation, nothing replaced.
In scripts without spaces every character is a word there.

*Slots.* Along one alignment (difference of positions) the same value of the item is always the same value of the
document; different values of the item may coincide in the document. A consistent alignment counts whether or not
values were changed, so re-parameterised questions are caught; in an inconsistent one only windows with
unchanged values count.

A document is contaminated by an item when ``LEAST`` of the item's words, or all of a shorter item's, are covered.

Defined cases: null or empty texts and items, and those without a letter or digit, match nothing; an item of one word
is found wherever that word stands; whole items cover all their template words; repeated rows are reported once;
rows with a null id are never reported; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lesionlens.llm.columns import sized, text_of, unpacked, whole_row
from lesionlens.session import materialize

WINDOW = 8
LITERALS = 4
LEAST = 11
BROADCAST_ROWS = 1_000_000  # window hashes or ids, 8 bytes each
UNSPACED = "".join(rf"\p{{Is{x}}}" for x in "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()) + "ー"

NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
UNITS = (
    "mm cm m km in inch inches ft foot feet yards yard mile miles mg g kg gram grams lb lbs pound pounds ton tons ml l liter "
    "liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees mph kph hz khz mhz w kw v kb mb gb tb"
).split()


def template(text: Column) -> Column:
    """The template of a text, words separated by single spaces; a placeholder carries '=value'."""
    out = F.regexp_replace(F.translate(text, "#=$", "   "), r"(?<=[\p{Ll},;:)] )\p{Lu}[\p{Ll}'’]+", "#Name=$0")
    out = F.lower(out)
    out = F.regexp_replace(out, r"(?<![\p{L}#=])\d[\d.,:/]*", "#num=$0")
    out = F.regexp_replace(out, rf"(?<![\p{{L}}#=])(?:{'|'.join(NUMBER_WORDS)})(?![\p{{L}}\d])", "#num=$0")
    out = F.regexp_replace(out, rf"(#num\S*) ?(?<![\p{{L}}=])({'|'.join(UNITS)})(?![\p{{L}}\d])", "$1 #unit=$2")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}#=\s]+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _bare(valued: Column) -> Column:
    """The words of a template without values: what attached units, endings and hyphens leave is part of the value."""
    return F.split(F.regexp_replace(valued, r"=\S*", ""), " ")


def plain(text: Column) -> Column:
    """The words as they are, lower-cased, separated by single spaces; '' for a text without any."""
    out = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, rf"[{UNSPACED}]\p{{M}}*", " $0 "), " +", " "))


def _positions(words: str, n: int = WINDOW) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def _hashes(words: str, n: int = WINDOW) -> Column:
    return F.transform(_positions(words, n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))


def _covered(at: Column | str) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + (WINDOW - 1))))))


def _evidence(run: Column) -> Column:
    return F.size(F.filter(run, lambda w: ~w.startswith("#"))) >= LITERALS


def _consistent(slots: str) -> Column:
    return F.size(F.array_distinct(F.transform(slots, lambda s: s["i"]))) == F.size(slots)


def windows(rows: DataFrame, key: str, text: str, named: str) -> DataFrame:
    """(key, hash, evidence, named_at, named_slots, named_words): every window of each row with its placeholders' values."""
    words = rows.select(F.col(key), template(text_of(text)).alias("template"))
    words = words.select(key, F.split("template", " ").alias("valued"), _bare(F.col("template")).alias("bare"))

    def window(i: Column) -> Column:  # a long text's words are not repeated for each of its windows
        run = F.slice("bare", i + 1, WINDOW)
        slots = F.filter(F.slice("valued", i + 1, WINDOW), lambda w: w.startswith("#"))
        return F.struct(F.xxhash64(run).alias("hash"), i.alias("at"), slots.alias("slots"), _evidence(run).alias("evidence"))

    each = words.select(key, F.size("bare").alias(f"{named}_words"), F.explode(F.transform(_positions("bare"), window)).alias("w"))
    return each.select(
        key, F.col("w.hash").alias("hash"), F.col("w.evidence").alias("evidence"), F.col("w.at").alias(f"{named}_at"),
        F.col("w.slots").alias(f"{named}_slots"), f"{named}_words",
    )


def candidates(docs: DataFrame, indexed: DataFrame) -> DataFrame:
    """(doc_id) of the documents with a window of the index."""
    words = docs.select("doc_id", _bare(template(text_of("text"))).alias("bare"))
    rows = words.select("doc_id", F.explode(_hashes("bare")).alias("hash"))
    wanted = materialize(indexed.where("evidence").select("hash").distinct(), "wanted")
    return rows.join(sized(wanted, BROADCAST_ROWS), "hash", "left_semi").select("doc_id").distinct()


def whole_items(items: DataFrame) -> DataFrame:
    """(item_id, item_words, plain, probe, hash): items whose windows after the first word, which alone can be another template
    word in a document, are too little evidence; ``hash`` is that of their first ``probe`` plain words."""
    rows = items.where("item_id is not null").select("item_id", _bare(template(text_of("text"))).alias("bare"), plain(text_of("text")).alias("plain"))
    sure = F.filter(_positions("bare"), lambda i: (i > 0) & _evidence(F.slice("bare", i + 1, WINDOW)))
    enough = F.coalesce(_covered(sure), F.lit(0)) >= F.least(F.lit(LEAST), F.size("bare"))
    words = F.split("plain", " ")
    probe = F.least(F.lit(WINDOW), F.size(words))
    rows = rows.where(~enough & (F.col("plain") != "")).withColumn("probe", probe)
    return rows.select("item_id", F.size("bare").alias("item_words"), "plain", "probe", F.xxhash64(F.slice(words, 1, F.col("probe"))).alias("hash")).distinct()


def whole_matches(docs: DataFrame, whole: DataFrame, probes: list[int]) -> DataFrame:
    """(doc_id, item_id, covered, item_words, changed) of the documents that hold all words of an item in a row."""
    words = docs.select("doc_id", F.split(plain(text_of("text")), " ").alias("words"))
    runs = [_hashes("words", n) for n in probes]
    hashes = F.array_distinct(F.concat(*[F.coalesce(r, F.array().cast("array<bigint>")) for r in runs]))
    rows = words.select("doc_id", F.explode(hashes).alias("hash"))
    pairs = rows.join(sized(whole.select("hash", "item_id", "item_words", "plain"), BROADCAST_ROWS // 100), "hash").drop("hash").distinct()
    pairs = materialize(pairs.where("doc_id is not null"), "whole-pairs")
    texts = docs.join(sized(materialize(pairs.select("doc_id").distinct(), "whole-docs"), BROADCAST_ROWS), "doc_id", "left_semi")
    texts = texts.select("doc_id", plain(text_of("text")).alias("all"))
    spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    found = texts.join(pairs, "doc_id").where(F.contains(spaced("all"), spaced("plain")))
    return found.select("doc_id", "item_id", F.col("item_words").alias("covered"), "item_words", F.lit(False).alias("changed")).distinct()


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, covered, item_words, changed) of every contaminated pair.

    ``covered`` counts the item's template words inside matching windows, ``changed`` tells that values differ.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    indexed = materialize(windows(items, "item_id", "text", "item"), "items")
    hit = materialize(candidates(docs, indexed), "hit")
    near = windows(docs.join(sized(hit, BROADCAST_ROWS), "doc_id", "left_semi"), "doc_id", "text", "doc")
    shift = (F.col("doc_at") - F.col("item_at")).alias("shift")
    pairs = near.where("evidence").drop("evidence").join(indexed.where("evidence"), "hash")
    pairs = pairs.select("doc_id", "item_id", "item_words", "item_at", shift, "evidence", "item_slots", "doc_slots")
    poor = indexed.where("not evidence")
    if not poor.isEmpty():  # the other windows of the alignments found; each meets one place of the document
        pairs = materialize(pairs, "aligned")
        lines = pairs.select("doc_id", "item_id", "shift").distinct()
        due = lines.join(poor, "item_id").withColumn("doc_at", F.col("item_at") + F.col("shift"))
        more = due.join(near.where("not evidence").select("doc_id", "doc_at", "hash", "doc_slots"), ["doc_id", "doc_at", "hash"])
        pairs = pairs.unionByName(more.select(*pairs.columns))
    pairs = pairs.withColumn("slots", F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d")))
    pairs = pairs.withColumn("same", F.forall("slots", lambda s: s["i"] == s["d"]))
    gather = lambda column, where: F.collect_set(F.when(where, F.col(column)))
    evident, anywhere = F.col("evidence"), F.lit(True)
    aligned = pairs.groupBy("doc_id", "item_id", "item_words", "shift").agg(
        gather("item_at", anywhere).alias("all"), gather("item_at", evident).alias("evident"), gather("item_at", F.col("same")).alias("unchanged"),
        F.array_distinct(F.flatten(gather("slots", anywhere))).alias("all_slots"), F.array_distinct(F.flatten(gather("slots", evident))).alias("slots"),
    )
    differ = lambda slots: F.exists(slots, lambda s: s["i"] != s["d"])
    counted = aligned.select(
        "doc_id", "item_id", "item_words",
        F.when(_consistent("all_slots"), F.col("all")).when(_consistent("slots"), F.array_union("evident", "unchanged")).otherwise(F.col("unchanged")).alias("at"),
        F.when(_consistent("all_slots"), differ("all_slots")).otherwise(_consistent("slots") & differ("slots")).alias("changed"),
    )
    found = counted.groupBy("doc_id", "item_id", "item_words").agg(
        F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.max("changed").alias("changed")
    )
    found = found.withColumn("covered", _covered("at")).where(F.col("covered") >= F.least(F.lit(LEAST), "item_words"))
    found = found.select("doc_id", "item_id", "covered", "item_words", "changed")
    whole = materialize(whole_items(items), "whole")
    probes = sorted(r["probe"] for r in whole.select("probe").distinct().collect())
    if not probes:
        return found
    found = found.unionByName(whole_matches(docs, whole, probes)).groupBy("doc_id", "item_id", "item_words")
    return found.agg(F.max("covered").alias("covered"), F.max("changed").alias("changed")).select("doc_id", "item_id", "covered", "item_words", "changed")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that no item contaminates, with the columns of ``docs``."""
    leaks = materialize(matches(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).alias("_id"))
    return unpacked(rows.join(sized(leaks, BROADCAST_ROWS), F.col("_id") == F.col("_leak"), "left_anti"), "row", docs.columns)
