"""Phrase collocations against a plain definition, and their defined results for odd input."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lesionlens.llm import phrases
from llm_brute import LOWER
from test_operators import odd_rows, table


def grams(rows):
    """{lang: Counter of tuples of up to 4 words}."""
    out = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            out[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    return out


def plain(rows, least, kept):
    out = []
    for lang, f in grams(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in candidates.items():
            inside = any(len(h) > len(g) and 100 * c >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in candidates.items())
            if not inside:
                score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:kept])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    fixed = ["New York City hall", "ad hoc", "in spite of", "été 日本"]
    words = ["".join(rng.choices("abcdé", k=2)) for _ in range(14)]
    for i in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(1, 40))]
        yield i, "".join(p + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "!", "\x0b"]) for p in parts), rng.choice(["en", "de", None, "und"]), "s"


@pytest.mark.parametrize("words, pairs", [(phrases.WORDS, phrases.PAIRS), (phrases.WORDS, 0), (0, 0)])
def test_collocations_equal_plain(spark, monkeypatch, words, pairs):
    monkeypatch.setattr(phrases, "FULL", 200)  # several transducers a task
    monkeypatch.setattr(phrases, "PIECE", 500)
    rows = list(texts(1, 160))
    rows += rows[:30]
    got = phrases.collocations(table(spark, rows).repartition(5), least=6, kept=25, words=words, pairs=pairs)
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 25)


def test_odd_rows(spark):
    rows = [*odd_rows(), (90, ".,;:!?", "en", "s"), (91, "日本日本" * 10_000, "ja", "s")]
    got = phrases.collocations(table(spark, rows), least=2)
    assert sorted(map(tuple, got.collect())) == plain(rows, 2, phrases.KEPT)
    assert phrases.collocations(table(spark, [])).count() == 0


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-1, 3), st.integers(1, 9)), max_size=30), st.integers(1, 4))
@settings(max_examples=100, deadline=None)
def test_union_of_shards_is_the_transducer_of_all(rows, shards):
    def build(part):
        return phrases.CountTransducer(np.array([r[:2] for r in part], np.int64).reshape(-1, 2), np.array([r[2] for r in part], np.int64))

    whole, union = build(rows), phrases.CountTransducer.union([build(rows[i::shards]) for i in range(shards)])
    assert whole.paths.tolist() == union.paths.tolist() == sorted(map(list, {r[:2] for r in rows})) and whole.counts.tolist() == union.counts.tolist()
    first, pairs = Counter(), Counter()
    for a, b, n in rows:
        first[a] += n
        pairs[a, b] += n if b != phrases.END else 0
    assert dict(zip(*(x.ravel().tolist() for x in whole.weights(1)))) == dict(first)
    got = whole.weights(2)
    assert dict(zip(map(tuple, got[0].tolist()), got[1].tolist())) == {k: n for k, n in pairs.items() if k[1] != phrases.END}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**17
    row = spark.createDataFrame([(big, 10**18 - 1)], "a bigint, d bigint")
    got = row.select(phrases.quotient("a", "d").alias("score"), phrases.covers("a", "d").alias("inside")).first()
    assert got.score == 2_000_000 * big // (10**18 - 1) and got.inside == (100 * big >= 80 * (10**18 - 1))
