"""Repeated byte strings against a plain definition, the suffix sorting against a direct count, and odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lesionlens.llm import suffix_dedup
from test_operators import odd_rows, prose, table

N = suffix_dedup.WINDOW


def plain(rows):
    """Sorted (id, bytes, removed, runs, digest of what is left)."""
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[j : j + N] for _, b in raw for j in range(len(b) - N + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for j in range(len(b) - N + 1):
            if seen[b[j : j + N]] > 1:
                gone[j + 1 : j + 1 + N] = True
        left = bytes(x for p, x in enumerate(b) if not gone[p + 1])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    rows = frame.collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(1000 + k, 70) for k in range(3)] + ["ñandú, ".encode().decode() * 60, "z" * 450]
    for i in range(60):
        parts = [prose(seed * 100 + i, rng.randrange(1, 90), 5000)]
        for _ in range(rng.randrange(3)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage) - 230)
            parts += [passage[a : a + rng.randrange(190, 460)], prose(seed * 999 + i, rng.randrange(0, 9), 5000)]
        yield i, "".join(parts)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_repeats_equal_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = list(corpus(1))
    rows += [(70, rows[3][1]), (3, rows[3][1]), (3, rows[9][1] + "!"), (71, "a" * 199), (72, "b" * 200), (73, "b" * 200), (74, "c" * 201)]
    assert got(suffix_dedup.remove_repeats(table(spark, rows).repartition(5))) == plain(rows)


def test_odd_rows(spark):
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 9_000 else r[1][:9_000]) for r in odd_rows()]
    assert got(suffix_dedup.remove_repeats(table(spark, rows))) == plain(rows)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    long = suffix_dedup.remove_repeats(table(spark, [(1, "x " * 40_000), (2, "é" * 50_000)])).collect()
    assert all(r.n_removed == r.n_bytes > 0 and r.n_spans == 1 for r in long)


@given(st.lists(st.tuples(st.text("ab", max_size=30), st.integers(1, 2)), min_size=1, max_size=6), st.integers(1, 4), st.integers(4, 11))
@settings(max_examples=200, deadline=None)
def test_bucket_pointers(segments, q, depth):
    data = np.frombuffer("".join(s for s, _ in segments).encode(), np.uint8)
    sizes = np.array([len(s) for s, _ in segments])
    ends = np.repeat(np.cumsum(sizes), sizes)
    weight = np.repeat(np.array([w for _, w in segments]), sizes)
    seen = Counter()
    for s, w in segments:
        for j in range(len(s) - depth + 1):
            seen[s[j : j + depth]] += w
    expected = [p + len("".join(x for x, _ in segments[:k])) for k, (s, _) in enumerate(segments) for p in range(len(s) - depth + 1) if seen[s[p : p + depth]] > 1]
    sorting = suffix_dedup.BucketPointers(data, ends, weight, min(q, depth))
    assert sorting.refined(depth).tolist() == expected
    text = data.tobytes()
    by_bucket = sorted(expected, key=lambda p: sorting.pointer[p])
    assert [text[p : p + depth] for p in by_bucket] == sorted(text[p : p + depth] for p in expected)


def test_segments_hold_every_window_once_under_one_anchor():
    texts = [t for _, t in corpus(2)] + [None, "", "z" * 700, "ab" * 300]
    found = suffix_dedup.segments_of(pa.array(texts, pa.string()))
    windows, of = [], {}
    for label, row, at in zip(found["anchor"].tolist(), found["row"].tolist(), found["at"].tolist()):
        raw = texts[row].encode()
        for p in range(at // 256, at // 256 + at % 256):
            windows.append((row, p))
            assert of.setdefault(raw[p : p + N], label) == label
    assert sorted(windows) == [(r, p) for r, t in enumerate(texts) for p in range(len((t or "").encode()) - N + 1)]


def test_shards_end_at_anchors(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)
    a, b = bytes(range(256)), bytes(reversed(range(256)))
    rows = [(1, 1, a), (1, 2, b), (2, 3, a[:220] + b[:9]), (2, 4, a[:210] + b[:3]), (2, 5, b), (3, 6, a), (4, 7, b)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x]), pa.array([d]), pa.array([1]), pa.array([t], pa.binary())], names=["anchor", "digest", "weight", "bytes"]) for x, d, t in rows]
    out = {r["digest"]: r["spans"] for batch in suffix_dedup._search(iter(batches)) for r in batch.to_pylist()}
    assert out[3] == [0, 11] and out[4] == [0, 11]
