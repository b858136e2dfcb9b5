"""Plain definitions of the corpus operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_components(docs, k=4):
    """{doc_id: (set size, smallest linked id)}; docs: [(id, text)], ids unique."""
    sets = {}
    for i, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in holders[s])
        for j, n in both.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(docs, n=35):
    """{id: (words, removed, digest of the kept words)}."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    seen = Counter(tuple(w[j : j + n]) for w in words.values() for j in range(len(w) - n + 1))
    out = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for p in range(j, j + n)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fair_shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: target} by handing out the excess again and again; sizes: {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total, left_now, left = sum(weight[s] for s in open_), left, 0.0
        for s in sorted(open_, key=str):
            target[s] += left_now * weight[s] / total
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def url_scores(sites, order=4, seen=3):
    """{site: mean log ratio}; sites: {site: 'allow', 'block' or None}, None for those not learnt from."""
    counts = {c: [defaultdict(Counter) for _ in range(order + 1)] for c in ("allow", "block")}
    pad = "\u0002" * order
    for site, label in sites.items():
        if label:
            text = pad + site + "\u0003"
            for p in range(order, len(text)):
                for n in range(order + 1):
                    counts[label][n][text[p - n : p]][text[p]] += 1

    def probability(label, context, char):
        p = 1 / 256
        for n in range(order + 1):
            followers = counts[label][n].get(context[len(context) - n :], Counter())
            total = sum(followers.values())
            if total >= (seen if n else 1):
                p = (followers[char] + len(followers) * p) / (total + len(followers))
        return p

    out = {}
    for site in sites:
        text = pad + site + "\u0003"
        ratios = [math.log(probability("allow", text[p - order : p], text[p]) / probability("block", text[p - order : p], text[p]))
                  for p in range(order, len(text))]
        out[site] = sum(ratios) / len(ratios)
    return out


def leaks(docs, items, n=8):
    """{(id, item)} with an equal run of n lower-cased words without punctuation."""
    clean = lambda t: re.sub(r"[^\w\s]|_", "", (t or "").lower()).split()
    index = defaultdict(set)
    for k, t in items:
        w = clean(t)
        for j in range(len(w) - n + 1):
            index[tuple(w[j : j + n])].add(k)
    return {(i, k) for i, t in docs for w in [clean(t)] for j in range(len(w) - n + 1) for k in index.get(tuple(w[j : j + n]), ())}


def edits(a, b):
    """Edit distance with swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]
