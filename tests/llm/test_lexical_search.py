"""Ranked lexical search against a plain definition, and its defined results for odd input."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lesionlens.llm import lexical_search as ls
from llm_brute import LOWER
from test_operators import odd_rows, prose, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, doc_id string, query string, score string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, depth):
    """{(item id, text): [(doc_id, score)]}; docs: [(id, text)]."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total, n_docs = sum(sum(b.values()) for _, b in bags), sum(bool(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if score > 0:
                scores.append((-score, (i is not None, i or 0), i))
        out[item, text or ""] = [(i, -s) for s, _, i in sorted(scores, key=lambda x: x[:2])[:depth]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.item, r.rank)):
        out.setdefault((r.item_id, r.item), []).append((r.rank, r.doc_id, r.score))
    assert all([x[0] for x in rows] == list(range(1, len(rows) + 1)) for rows in out.values())
    return sorted((str(k[0]), [x[1:] for x in v]) for k, v in out.items())


def expected(docs, items, depth):
    return sorted((str(k[0]), v) for k, v in plain(docs, items, depth).items() if v)


@pytest.mark.parametrize("block_terms", [ls.BLOCK_TERMS, 40])
def test_search_equals_plain(spark, block_terms):
    docs = [(i, prose(i, 5 + i * 7 % 90, 60)) for i in range(120)] + [(7, "w1 W2 w3"), (500, prose(3, 26, 60)), (None, "w1 w2"), (501, "w1 w2")]
    items = [(i, prose(1000 + i // 3, 12, 60) + f" w{i}") for i in range(25)] + [(3, "w4 w5"), (3, "w4 w5"), (None, "W1;w2"), (90, "nowhere"), (91, None)]
    rows = spark.createDataFrame([(*x, "d", "q", "s") for x in items], ITEMS)
    got = ls.search(table(spark, docs).repartition(7), rows, depth=6, block_terms=block_terms)
    assert found(got) == expected(docs, items, 6)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "a"), (2, "x É"), (3, "é" * 50), (4, ""), (5, None), (6, "null a-b")]
    frame = spark.createDataFrame([(*x, "d", "q", "s") for x in items], ITEMS)
    assert found(ls.search(table(spark, odd_rows()), frame)) == expected(rows, items, ls.DEPTH)
    assert ls.search(table(spark, []), frame).count() == 0 and ls.search(table(spark, odd_rows()), frame.where("false")).count() == 0


@given(st.lists(st.frozensets(st.integers(0, 30), max_size=14), max_size=12))
@settings(max_examples=150, deadline=None)
def test_the_dag_holds_each_term_of_a_query_once(queries):
    dag = ls.mine([np.array(sorted(q), np.uint64) for q in queries])
    leaves = [Counter([int(t)]) for t in dag.terms]
    for a, b in zip(dag.left, dag.right):
        leaves.append(leaves[a] + leaves[b])
    for q, nodes in zip(queries, dag.queries):
        assert sum((leaves[n] for n in nodes), Counter()) == Counter(q)


def test_shared_sets_are_summed_once():
    a, b, c = range(0, 10), range(10, 20), range(20, 30)
    dag = ls.mine([np.array([*x, own], np.uint64) for x, own in (([*a, *b], 90), ([*a, *b], 91), ([*b, *c], 92), ([*c, *a], 93))])
    assert [len(q) for q in dag.queries] == [2, 2, 3, 3]  # the first two share one sum of a and b
    assert len(dag.left) == 3 * 9 + 1


def test_length_part_beyond_64_bits():
    assert ls.length_part(np.array([10**9, 7]), 10**12, 10**14).tolist() == [50 + 50 * 10**9 * 10**12 // 10**14, 50 + 350 * 10**12 // 10**14]


def test_best_keeps_ties_by_id():
    best = ls.Best(2, 2)
    for _ in range(60):
        best.add(np.array([[5, 5, 5], [0, 1, 0]]), np.array([3, 1, 2]))
    query, score, ident = best.prune()
    assert list(zip(query.tolist(), score.tolist(), ident.tolist())) == [(0, 5, 1), (0, 5, 1), (1, 1, 1), (1, 1, 1)]
