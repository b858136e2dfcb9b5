"""Toxicity: misspelt lexicon terms in context.

*Lexicon.* A short list of insults, and words and stems (written ``stem*``) that a bounded sample of labelled documents
marks as toxic: of the candidates with a large log-likelihood ratio those are taken that cover most toxic documents
not yet covered ``COVER`` times, at most ``MAX_TERMS``. Words near a term that the sample's clean documents use
(closer, crown) are no misspellings.

*Letters.* Texts and terms are read by code points; a word is a run of letters, marks and numbers of any script, so quotes and
dashes of any kind part words.

*Automaton.* The Levenshtein automata of all terms (one edit from five letters on, two from eight, a swap of neighbours
is one edit; stems match exactly and accept any ending) are intersected with the lexicon's trie and made deterministic once, on the driver; the table is a
function of the lexicon alone. Tasks run it over all words of a batch at once, one letter per step.

*Context.* A hit counts as quoted when quotation marks stand on both sides of it within ``WINDOW`` bytes; other hits
nearby make a window heavier. A text's counts of exact, misspelt and quoted hits, their density and its
heaviest window are the features of a logistic regression fitted on the same sample, so how far a quotation
excuses a term is learnt.

Defined cases: a null or empty text has no hit and gets the score of a text without hits; without rows of both
classes every score is the share of label 1 (0.5 without any); repeated rows are one row of the sample; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from lesionlens.llm import kernels
from lesionlens.session import materialize

FIT_ROWS = 3_000
MAX_TERMS = 60
MAX_CANDIDATES = 2_000
MAX_ORDINARY = 1_000
LEAST_SUPPORT, LEAST_RATIO, LEAST_G = 4, 5.0, 28.0
STEM, LONGEST_STEM = 4, 10  # letters
COVER, LEAST_GAIN = 3, 0.005  # terms for each toxic document; share of them that a term has to add to
WINDOW = 60
TERMS = "clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash vermin worthless".split()

QUOTE = np.zeros(256, bool)
QUOTE[[34, 39, 96]] = True  # and the bytes of typographic quotes, below
FEATURES = ("any", "exact", "misspelt", "quoted", "density", "heaviest", "any quoted only")


@dataclass(frozen=True)
class Automaton:
    step: np.ndarray  # states x letters -> state; 0 is the start, -1 rejects
    edits: np.ndarray  # edits of the best accepted term, -1 in other states
    term: np.ndarray
    ends: np.ndarray  # states in which a stem is complete
    longest: int
    alphabet: np.ndarray  # code point, either case -> letter number; 0 is any letter outside the lexicon, as are those beyond the end


@dataclass(frozen=True)
class Model:
    lexicon: list[str]
    automaton: Automaton
    ordinary: np.ndarray  # hashes of words that are no misspellings
    weights: np.ndarray  # of the bias and the features


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """(is it part of a word, its small letter) of every code point."""
    known = [unicodedata.category(chr(c)) for c in range(0x110000)]
    small = np.arange(0x110000, dtype=np.int32)
    for c, kind in enumerate(known):
        if kind in ("Lu", "Lt", "Nl", "So") and len(low := chr(c).lower()) == 1:
            small[c] = ord(low)
    small[ord("ς")], small[ord("İ")] = ord("σ"), ord("i")
    return np.array([kind[0] in "LMN" for kind in known]), small


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, characters begun before each byte, whether each byte is part of a word) of UTF-8 text."""
    lead = (data & 0xC0) != 0x80
    index = np.concatenate([[0], np.cumsum(lead)])
    code = data[lead].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    if len(wide):
        at = np.flatnonzero(lead)[wide]
        tail = np.append(data, np.zeros(3, np.uint8)).astype(np.int32) & 0x3F
        b, one, two, three = code[wide], tail[at + 1], tail[at + 2], tail[at + 3]
        long = (b & 0x07) << 18 | one << 12 | two << 6 | three
        code[wide] = np.where(b < 0xE0, (b & 0x1F) << 6 | one, np.where(b < 0xF0, (b & 0x0F) << 12 | one << 6 | two, np.minimum(long, 0x10FFFF)))
    inside = classes()[0][code]
    return code, index, inside[np.maximum(index[1:] - 1, 0)] if len(code) else np.zeros(len(data), bool)


def allowed(term: str) -> int:
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 8 else 2


def build(terms: list[str]) -> Automaton:
    """The deterministic intersection of the terms' Levenshtein automata with their trie.

    A position is (trie node, edits, swap): ``swap`` is the node that completes a swap of two letters, or None.
    """
    bound = list(map(allowed, terms))
    small = classes()[1]
    words = [[int(small[ord(x)]) for x in t.removesuffix("*")] for t in terms]
    letters = sorted({c for t in words for c in t})
    spelt = np.flatnonzero(np.isin(small, letters))
    alphabet = np.zeros(spelt.max(initial=0) + 2, np.int32)
    alphabet[spelt] = np.searchsorted(letters, small[spelt]) + 1
    children: list[dict[int, int]] = [{}]
    most, ends, stems = [0], {}, {}  # most edits of the terms below a node; term of a final node
    for k, term in enumerate(words):
        node = 0
        for b in term:
            most[node] = max(most[node], bound[k])
            if (c := int(alphabet[b])) not in children[node]:
                children[node][c] = len(children)
                children.append({})
                most.append(0)
            node = children[node][c]
        most[node] = max(most[node], bound[k])
        (stems if terms[k].endswith("*") else ends)[node] = k

    def closed(positions: set) -> frozenset:
        """With letters of the term left out; of positions at one node those with the fewest edits."""
        todo, best = list(positions), {}
        while todo:
            node, e, swap = todo.pop()
            if e > most[node] or best.get((node, swap), 99) <= e:
                continue
            best[node, swap] = e
            if swap is None:
                todo += [(child, e + 1, None) for child in children[node].values()]
        return frozenset((node, e, swap) for (node, swap), e in best.items())

    def moved(state: frozenset, letter: int) -> frozenset:
        out = set()
        for node, e, swap in state:
            if swap is not None:  # the first letter of a swapped pair is due
                first, second = swap
                if letter == first:
                    out.add((second, e, None))
                continue
            out.add((node, e + 1, None))
            for c, child in children[node].items():
                out.add((child, e if c == letter else e + 1, None))
                if letter in children[child] and letter != c:
                    out.add((node, e + 1, (c, children[child][letter])))
        return closed(out)

    start = closed({(0, 0, None)})
    number, order, step = {start: 0}, [start], []
    for state in order:
        row = []
        for letter in range(len(letters) + 1):
            to = moved(state, letter)
            if to and to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to] if to else -1)
        step.append(row)
    stem = [next((stems[n] for n, e, swap in s if swap is None and e == 0 and n in stems), -1) for s in order]
    best = [min(((e, ends[n]) for n, e, swap in s if swap is None and n in ends and e <= bound[ends[n]]), default=(-1, -1)) for s in order]
    best = [b if k < 0 else (0, k) for b, k in zip(best, stem)]
    return Automaton(
        np.array(step, np.int32).reshape(len(order), -1), np.array([b[0] for b in best], np.int32), np.array([b[1] for b in best], np.int32),
        np.array(stem) >= 0, max((len(w) + e for w, e in zip(words, bound)), default=0), alphabet,
    )


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of runs of letters and digits."""
    return _runs(offsets, characters(data)[2])


def _runs(offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return kernels.words(np.where(inside, np.uint8(120), np.uint8(32)), offsets)


def hits(column: pa.Array, a: Automaton, ordinary: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, token place in the text, edits, term, quoted, tokens of each text) of every lexicon hit."""
    data, offsets = kernels.utf8(column)
    code, index, inside = characters(data)
    starts, ends, first = _runs(offsets, inside)
    low = kernels.LOWER[data]
    letter = a.alphabet[np.minimum(code, len(a.alphabet) - 1)]
    at, size = index[starts], index[ends] - index[starts]
    alive = np.arange(len(size))
    state, got, final = np.zeros(len(alive), np.int32), [], []
    for step in range(a.longest + 1):
        done = (size[alive] == step) | a.ends[state]
        good = done & (a.edits[state] >= 0)
        got.append(alive[good])
        final.append(state[good])
        alive, state = alive[~done], state[~done]
        if not len(alive):
            break
        state = a.step[state, letter[at[alive] + step]]
        alive, state = alive[state >= 0], state[state >= 0]
    got, final = np.concatenate(got), np.concatenate(final)
    order = np.argsort(got, kind="stable")
    got, final = got[order], final[order]
    if len(ordinary):
        meant = (a.edits[final] == 0) | ~np.isin(kernels.hashes(low, starts[got], ends[got]), ordinary)
        got, final = got[meant], final[meant]
    text = np.searchsorted(first, got, "right") - 1
    # quotes not inside a word: ASCII ones, the three-byte typographic ones (E2 80 98..9F); and « »
    mark = np.zeros(len(data) + 1, np.int64)
    if len(data):
        ascii_ = QUOTE[data]
        before = np.append(False, inside[:-1])
        before[offsets[:-1][offsets[:-1] < len(data)]] = False  # the text before is no neighbour
        after = lambda n: np.append(inside[n:], np.zeros(min(n, len(inside)), bool)) & (np.repeat(offsets[1:], np.diff(offsets)) > np.arange(len(data)) + n)
        pair, triple = np.zeros(len(data), bool), np.zeros(len(data), bool)
        pair[:-1] = (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        triple[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x98) & (data[2:] <= 0x9F)
        mark[1:] = np.cumsum((ascii_ & ~(before & after(1))) | pair | (triple & ~(before & after(3))))
    left = np.maximum(starts[got] - WINDOW, offsets[text])
    right = np.minimum(ends[got] + WINDOW, offsets[text + 1])
    quoted = (mark[starts[got]] > mark[left]) & (mark[right] > mark[ends[got]])
    return text, got - first[text], a.edits[final], a.term[final], quoted, np.diff(first)


def features(column: pa.Array, a: Automaton, ordinary: np.ndarray) -> np.ndarray:
    text, place, edits, _, quoted, n = hits(column, a, ordinary)
    rows = len(n)
    count = lambda keep: np.bincount(text[keep], minlength=rows).astype(float)
    plain, out = ~quoted, np.zeros((rows, len(FEATURES)))
    exact, misspelt, cited = count(plain & (edits == 0)), count(plain & (edits > 0)), count(quoted)
    open_ = exact + misspelt
    heaviest = np.zeros(rows)
    where = text[plain].astype(np.int64) * 2**40 + place[plain]  # other open hits among the ten words before
    np.maximum.at(heaviest, text[plain], np.arange(1, len(where) + 1) - np.searchsorted(where, where - 10))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = open_ > 0, np.log1p(exact), np.log1p(misspelt), np.log1p(cited)
    out[:, 4], out[:, 5] = np.minimum(1, 20 * open_ / np.maximum(n, 1)), np.log1p(heaviest)
    out[:, 6] = (open_ == 0) & (cited > 0)
    return out


def _candidates(sample: DataFrame) -> DataFrame:
    """(place, label, c): the words of each document, written ``word``, and the stems of its words, ``stem*``."""
    words = sample.select("place", "label", F.explode(F.array_distinct(F.split(F.lower(F.translate("text", "İ", "i")), r"[^\p{L}\p{M}\p{N}]+"))).alias("w"))
    words = words.where(F.length("w").between(STEM, 30))
    sizes = F.sequence(F.lit(STEM), F.least(F.length("w"), F.lit(LONGEST_STEM)))
    stems = F.transform(sizes, lambda n: F.concat(F.substring("w", F.lit(1), n), F.lit("*")))
    return words.select("place", "label", F.explode(F.concat(F.array("w"), stems)).alias("c")).distinct()


def lexicon(sample: DataFrame, terms: list[str] = TERMS, most: int = MAX_TERMS) -> list[str]:
    """The given terms and what the sample marks as toxic.

    Spark counts; the driver gets MAX_CANDIDATES candidates and, for them, the toxic documents of the bounded sample.
    """
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return sorted(set(terms))
    rows = materialize(_candidates(sample), "terms")
    t, c = F.col("t"), F.col("f")
    counts = rows.groupBy("c").agg(F.sum(F.col("label").cast("double")).alias("t"), F.sum(F.lit(1.0) - F.col("label")).alias("f")).where(t >= LEAST_SUPPORT)
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(0.0)
    g = 2 * (part(t, toxic / (toxic + clean)) + part(c, clean / (toxic + clean)))
    ratio = (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))
    strong = counts.withColumn("g", g).where((F.col("g") >= LEAST_G) & (ratio >= LEAST_RATIO)).orderBy(F.col("g").desc(), "c").limit(MAX_CANDIDATES)
    where = rows.where("label = 1").join(F.broadcast(strong.select("c")), "c").select("c", "place").collect()
    number = {p: i for i, p in enumerate(sorted({r["place"] for r in where}))}
    docs: dict[str, list[int]] = {}
    for r in where:
        docs.setdefault(r["c"], []).append(number[r["place"]])
    need, picked = np.full(len(number), COVER), []
    open_ = {k: np.array(v) for k, v in sorted(docs.items())}
    while open_ and len(picked) < most:
        gain = {k: int((need[v] > 0).sum()) for k, v in open_.items()}
        best = max(open_, key=lambda k: (gain[k], not k.endswith("*"), len(k), k))  # of equals whole words, then long stems
        if gain[best] < max(2, LEAST_GAIN * toxic):
            break
        picked.append(best)
        need[open_[best]] -= 1
        stem = best.removesuffix("*")
        open_ = {k: v for k, v in open_.items() if not k.startswith(stem) and not stem.startswith(k.removesuffix("*"))}
    return sorted({*terms, *picked})


def ordinary(sample: DataFrame, automaton: Automaton, most: int = MAX_ORDINARY) -> np.ndarray:
    """Hashes of words of clean documents that the automaton takes for misspelt terms, the most frequent words."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            data, offsets = kernels.utf8(batch.column("text"))
            starts, ends, first = tokens(data, offsets)
            text, place, edits, *_ = hits(batch.column("text"), automaton)
            at = (first[text] + place)[edits > 0]
            word = kernels.hashes(kernels.LOWER[data], starts[at], ends[at]).view(np.int64)
            pairs = sorted(set(zip(text[edits > 0].tolist(), word.tolist())))
            labels = batch.column("label").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([labels[t] for t, _ in pairs], pa.int32()), pa.array([w for _, w in pairs], pa.int64())], names=["label", "w"])

    toxic, clean = F.sum("label"), F.sum(1 - F.col("label"))
    found = sample.select("label", "text").mapInArrow(near, "label int, w bigint").groupBy("w").agg(toxic.alias("t"), clean.alias("c"))
    rows = found.where("c >= 2 and t < c").orderBy(F.col("c").desc(), "w").limit(most).collect()
    return np.sort(np.array([r["w"] for r in rows], np.int64).view(np.uint64))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps of a ridge logistic regression, both classes weighing the same."""
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return np.append(np.log((share + 1e-3) / (1 - share + 1e-3)), np.zeros(x.shape[1]))
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, pull = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (y - p)) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: DataFrame, terms: list[str] = TERMS) -> Model:
    """Fit on a bounded sample (label, place, text)."""
    sample = materialize(sample, "sample")
    words = lexicon(sample, terms)
    automaton = build(words)
    known = ordinary(sample, automaton)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.pieces(batches):
            x = features(batch.column("text"), automaton, known)
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), *map(pa.array, x.T)], names=["place", "label", *[f"x{i}" for i in range(x.shape[1])]])

    schema = "place bigint, label int, " + ", ".join(f"x{i} double" for i in range(len(FEATURES)))
    rows = sample.select("place", "label", "text").mapInArrow(extract, schema).toArrow()
    rows = rows.take(pc.sort_indices(rows, [("place", "ascending")]))
    x = np.column_stack([rows.column(f"x{i}").to_numpy() for i in range(len(FEATURES))])
    return Model(words, automaton, known, _fit(x, rows.column("label").to_numpy()))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in kernels.pieces(batches):
            x = features(batch.column("text"), m.automaton, m.ordinary)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-(x @ m.weights[1:] + m.weights[0]))))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
