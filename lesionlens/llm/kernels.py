"""Vectorised text kernels over Arrow string columns: cutting into pieces, words, hashes of words and of runs of words.

They work on the UTF-8 bytes of many texts at once. White space is ASCII only, so word borders in bytes are word
borders in characters. Memory is a fixed multiple of a piece: texts are processed ``PIECE`` bytes at a time,
a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GOLDEN = 0x9E3779B97F4A7C15  # splitmix64: increment and the two multipliers
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int = 0) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(GOLDEN))


BYTES = numbers(256, 1)
PLACES = numbers(64, 2) | np.uint64(1)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Record batches whose texts come to ``limit`` bytes at most, or hold one longer text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at] - sizes[at]
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte range of every word; words of text i are first[i] to first[i + 1]. ``space`` marks the bytes between words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    border = np.zeros(len(data) + 1, bool)  # a text begins here
    border[offsets] = True
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[0], before[1:] = True, ~solid[:-1] | border[1:-1]
    after[-1], after[:-1] = True, ~solid[1:] | border[1:-1]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial in the bytes' random numbers, from prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(max(len(data), 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(words_: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, where): hash of each run of k words inside one text, and the word it starts at."""
    n = len(words_) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words_[j : j + n] * PLACES[j]
    limit = np.repeat(first[1:], np.diff(first))[:n]
    where = np.flatnonzero(np.arange(n) + k <= limit)
    return mix(total[where]), where


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for all i."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): an order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    return order, np.flatnonzero(new)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings, which they must be in UTF-8."""
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[spread(starts, ends - starts)])).cast(pa.string())
