"""Column expressions and small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(text: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words: runs of characters other than ASCII white space. No array of matches is kept."""
    at_start = F.when(text.rlike(f"^{GAP}"), 1).otherwise(0)
    at_end = F.when(text.rlike(f"{GAP}$"), 1).otherwise(0)
    pieces = F.size(F.split(text, GAP)) - at_start - at_end
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(pieces, F.lit(0))).cast("bigint")


def held_out(doc_id: str, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that no model learns from. A null id counts as the text ''."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % folds == 0


def sized(keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of keys, marked for the join it is the right side of: counted, and broadcast up to ``rows`` rows of
    a few bytes, so that a large left side is not shuffled; beyond that sort-merge. Only the plan differs."""
    return F.broadcast(keys) if keys.count() <= rows else keys.hint("merge")


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that columns added next to it cannot clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(row)[c].alias(c) for c in names])
