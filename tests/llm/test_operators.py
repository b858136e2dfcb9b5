"""Each operator against a plain definition, and its defined results for odd input."""

import random
import string
import zlib

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lesionlens.llm import decontaminate, exact_dedup, kernels, language_id, mixing, near_dup, quality, substring_dedup, token_counts, toxicity, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, keep_id string, row string"
ODD = [None, "", " ", "\t\n\x0b", "a", "A b", "\x00", "é" * 50, "x " * 40_000, "!?", "a" * 5_000]


def table(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, lang, source]); the other columns' names clash with names used inside."""
    full = [(*r, None, None)[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(*r, "k", "r") for r in full], schema)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=3)) if rng.random() < 0.02 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def odd_rows():
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    return [*rows, rows[4], rows[8], (None, "null id", None, None), (None, None, None, None), (None, "null id", None, None)]


# kernels


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\x0bé", max_size=12)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offsets = kernels.utf8(pa.array(texts, pa.string()))
    starts, ends, first = kernels.words(data, offsets)
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    expected = [brute.WORD.findall(t or "") for t in texts]
    assert got == sum(expected, [])
    assert np.diff(first).tolist() == list(map(len, expected))
    hashes = kernels.hashes(data, starts, ends).tolist()
    assert len(set(hashes)) == len(set(got)) and len({*zip(hashes, got)}) == len(set(got))


def test_pieces_cover_slices():
    column = pa.array(["aa", None, "b" * 50, "", "cc"])
    batch = pa.RecordBatch.from_arrays([column], names=["text"]).slice(1)
    assert [p.column("text").to_pylist() for p in kernels.pieces([batch], limit=10)] == [[None], ["b" * 50], ["", "cc"]]


# exact deduplication


def test_exact_verdicts_over_batches(spark):
    index = exact_dedup.new_index(spark, 4)
    first = exact_dedup.verdicts(table(spark, [(1, "a"), (5, "a"), (2, "b"), (3, None), (4, "")]), index).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first} == {(1, 5, 2, False), (5, 5, 2, True), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True)}
    again = exact_dedup.verdicts(table(spark, [(1, "a"), (5, "a"), (2, "b"), (3, None), (4, "")]), index).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))
    later = exact_dedup.verdicts(table(spark, [(9, "a"), (8, "c")]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in later} == {(9, 5, False), (8, 8, True)}
    assert index.table().count() == 4
    assert exact_dedup.DigestIndex(spark, index.path.rpartition("/")[0]).buckets == 4
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, index.path.rpartition("/")[0], 8)


def test_exact_anti_join_reads_the_index_without_a_shuffle(spark):
    index = exact_dedup.new_index(spark, 8)
    exact_dedup.verdicts(table(spark, [(1, "a")]), index)
    fresh = spark.createDataFrame([("x", 1)], "digest string, keep_id bigint").repartition(8, "digest")
    plan = fresh.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("hashpartitioning") <= 1


def test_exact_odd_rows(spark):
    rows = odd_rows()
    out = exact_dedup.deduplicate(table(spark, rows), exact_dedup.new_index(spark, 4))
    assert out.columns == ["doc_id", "text", "lang", "source", "keep_id", "row"]
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows})
    assert exact_dedup.deduplicate(table(spark, []), exact_dedup.new_index(spark, 4)).count() == 0


# near duplicates


def check_near(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(table(spark, rows)).collect()}
    assert got == brute.near_components(rows)


def test_near_groups_of_edited_copies(spark):
    rows, rng = [], random.Random(3)
    for g in range(12):
        base = prose(g, rng.choice((30, 120, 300)))
        rows += [(0, base)] if g == 0 else [(len(rows), base)]
        rows += [(len(rows) + i, edited(base, 100 * g + i, rng.choice((0.0, 0.01, 0.03, 0.05, 0.08)))) for i in range(25)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    check_near(spark, rows)


def test_near_truncated_copies_link_without_their_leader(spark):
    base = prose(77, 400).split(" ")
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 400 - 9 * i])) for i in range(1, 30)]
    rows += [(100 + i, " ".join(base[:200]) + " " + prose(1000 + i, 20 * i + 10)) for i in range(12)]
    check_near(spark, rows)


def test_near_odd_rows(spark):
    out = near_dup.components(table(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    named = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(r.n_shingles == 0 and r.component_id == i and r.kept for i, r in named.items() if not (ODD[i] or "").split())
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    kept = near_dup.deduplicate(table(spark, odd_rows()))
    assert kept.columns == ["doc_id", "text", "lang", "source", "keep_id", "row"] and kept.count() == len(odd_rows())
    assert near_dup.components(table(spark, [])).count() == 0
    assert near_dup.components(table(spark, [(1, "")])).collect()[0].kept


def cousins(n):
    """2n close variants of one text and n of another that shares about 60 % of its shingles with the first."""
    base = [f"b{k}" for k in range(200)]
    other = base[:150] + [f"c{k}" for k in range(50)]
    docs = []
    for kind, (text, many) in enumerate(((base, 2 * n), (other, n))):
        for i in range(many):
            words = list(text)
            words[(7 * i + 3) % 148] = f"v{kind}x{i}"
            docs.append((kind * 10_000 + i, " ".join(words)))
    return docs


def test_pairs_of_connected_groups_are_not_listed_again(spark, monkeypatch):
    counts, plain = [], near_dup._overlapping

    def counted(tried):
        out = plain(tried)
        counts.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "_overlapping", counted)
    for n in (15, 45):
        docs = cousins(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.components(table(spark, docs)).collect()}
        assert got == brute.near_components(docs)
    assert counts[0] <= 15 and counts[1] <= 45, counts


def test_stages_take_five_words(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(115)]
    for _ in range(20):  # scattered edits that four-word shingles bear and five-word ones do not
        edit = list(words)
        for p in rng.sample(range(5, 105), 3):
            edit[p] = "edited"
        docs = [(1, " ".join(words)), (2, " ".join(edit))]
        four, five = (len({c for _, c in brute.near_components(docs, k).values()}) for k in (4, 5))
        if (four, five) == (1, 2):
            break
    assert (four, five) == (1, 2)
    assert {r.doc_id for r in near_dup.deduplicate(table(spark, docs)).collect()} == {1, 2}
    assert {r.doc_id for r in near_dup.deduplicate(table(spark, docs), shingle=4).collect()} == {1}


# language


def test_language_held_out_accuracy(spark):
    tongues = {"aa": "abcdefgh", "bb": "defghijk", "cc": "ghijklmn", "zz": "éèàüöß"}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(tongues[x], k=rng.randint(2, 7))) for _ in range(rng.randint(3, 40))), x, "s")
            for i, x in enumerate(rng.choices(list(tongues), k=600))]
    docs = table(spark, rows)
    model = language_id.train(docs.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark):
    model = language_id.train(table(spark, [*odd_rows(), (50, "hello there", "en", "s"), (51, "bonjour là", None, "s")]))
    out = language_id.predict(table(spark, odd_rows()), model).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        if r.doc_id is not None:
            known = any(map(str.isalpha, ODD[r.doc_id] or ""))
            assert (r.lang_pred == "und") == (not known) and (known or r.score == 0)
    empty = language_id.train(table(spark, []))
    assert {r.lang_pred for r in language_id.predict(table(spark, [(1, "words")]), empty).collect()} == {"und"}
    assert language_id.predict(table(spark, []), model).count() == 0
    kept = language_id.identified(table(spark, [(1, "hello", "en", "s"), (2, "hello there", "en", "s"), (3, "12", "en", "s"), (4, None, "en", "s")]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "lang", "source", "keep_id", "row"]


# toxicity


@given(st.sampled_from(toxicity.TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abeist0"), st.sampled_from("dist")), max_size=3))
@settings(max_examples=150, deadline=None)
def test_automaton_accepts_exactly_the_near_words(term, changes):
    automaton = AUTOMATON
    word = list(term)
    for at, letter, kind in changes:
        at = min(at, len(word) - 1) if word else 0
        if kind == "d" and word:
            del word[at]
        elif kind == "i":
            word.insert(at, letter)
        elif kind == "s" and word:
            word[at] = letter
        elif word and at + 1 < len(word):
            word[at], word[at + 1] = word[at + 1], word[at]
    word = "".join(word)
    best = [(brute.edits(word, t), t) for t in toxicity.TERMS]
    best = min([d for d, t in best if d <= toxicity.allowed(t)], default=None)
    got = toxicity.hits(pa.array([f"so {word.upper()}, there"]), automaton)
    mine = [int(e) for place, e in zip(got[1], got[2]) if place == 1]
    if word:
        assert mine == ([] if best is None else [best])


AUTOMATON = toxicity.build(toxicity.TERMS)


def test_toxicity_quotes_and_exceptions():
    texts = pa.array(['he said "you idiot" to me', None, "", "idiot", "closer now", "don't, idoit", "Zorbling", "zorb", "zor"])
    automaton = toxicity.build([*toxicity.TERMS, "zorb*"])
    text, place, edits, term, quoted, n = toxicity.hits(texts, automaton)
    assert text.tolist() == [0, 3, 4, 5, 6, 7] and quoted.tolist() == [True] + [False] * 5 and edits.tolist() == [0, 0, 1, 1, 0, 0]
    assert n.tolist()[1:4] == [0, 0, 1]
    data, offsets = kernels.utf8(pa.array(["closer"]))
    known = kernels.hashes(data, np.array([0]), np.array([6]))
    assert toxicity.hits(texts, automaton, known)[0].tolist() == [0, 3, 5, 6, 7]


def test_toxicity_reads_code_points():
    automaton = toxicity.build([*toxicity.TERMS, "дурак", "βλάκας", "sétû", "笨蛋", "größ*", "idiota"])
    texts = ["Ты ДУРАК, да", "дурка", "ΒΛΆΚΑΣ", "SÉTÛ", "笨蛋", "Größenwahn", "“idiot” — «loser»", "scum…", "dumb—ass", "don’t", "дом", "笨", "idióta"]
    text, _, edits, _, quoted, n = toxicity.hits(pa.array(texts), automaton)
    assert text.tolist() == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 12] and edits.tolist() == [0, 1] + [0] * 8 + [1]
    assert quoted.tolist()[6:8] == [True, True] and n.tolist() == [3, 1, 1, 1, 1, 1, 2, 1, 2, 2, 1, 1, 1]


def test_toxicity_learns_other_alphabets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words, toxic = prose(i, 60).split(" "), i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["дурак", "«мразь»", "ΒΛΆΚΑΣ"])
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.train(labelled(spark, rows[:300]))
    got = {r.doc_id: r.score for r in toxicity.predict(table(spark, [(i, t) for i, t, _ in rows]), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows[300:])


def labelled(spark, rows):
    return spark.createDataFrame([(i, y, i * 7919 % 1009, t) for i, t, y in rows], "doc_id bigint, label int, place bigint, text string")


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    insults = ["idiot", "moron", "zorbnik", "scum"]
    rows = []
    for i in range(400):
        words, toxic = prose(i, 60).split(" "), i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(insults)
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.train(labelled(spark, rows[:300]))
    assert any(t.startswith("zorb") for t in model.lexicon)
    docs = table(spark, [(i, t.replace("moron", "morron")) for i, t, _ in rows])
    got = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows[300:])


def test_toxicity_and_quality_odd_rows(spark):
    for module in (toxicity, quality):
        for fit in ([], [(1, "good words", 1)], [(1, None, 0), (2, "", 1), (3, "x y", 0)]):
            model = module.train(labelled(spark, fit))
            out = module.predict(table(spark, odd_rows()), model).collect()
            assert len(out) == len(odd_rows()) and all(0 <= r.score <= 1 for r in out)
        assert module.predict(table(spark, []), model).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words, good = prose(i, rng.randint(5, 80)).split(" "), i % 5 > 0
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    model = quality.train(labelled(spark, rows[:300]))
    got = {r.doc_id: r.score for r in quality.predict(table(spark, [r[:2] for r in rows]), model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in rows[300:])


# repeated passages


def check_repeats(spark, rows):
    out = substring_dedup.remove_repeats(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.without_repeats(rows)


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    passage, rng = prose(9, 60), random.Random(9)
    rows = [(i, f"{prose(i, rng.randint(0, 50))} {' '.join(passage.split()[rng.randint(0, 10):rng.randint(40, 60)])}\n{prose(500 + i, rng.randint(0, 90))}") for i in range(40)]
    rows += [(100, passage + "  " + passage), (101, prose(1, 34)), (102, prose(2, 35)), (103, prose(2, 35)), (104, "same " * 200), (105, passage.replace(" ", "\t"))]
    check_repeats(spark, rows)


def test_repeats_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    check_repeats(spark, [(i, prose(i // 3, 100) + " " + prose(50 + i, 10)) for i in range(30)])


def test_repeats_odd_rows(spark):
    out = substring_dedup.remove_repeats(table(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    repeated = [r for r in out if r.doc_id == 8]
    assert len(repeated) == 2 and all((r.n_words, r.n_removed, r.kept_text) == (40_000, 40_000, "") for r in repeated)
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 4, 300), 0)
    weight = np.ones(301, np.int64)
    index = substring_dedup.FMIndex(text, weight, 3)
    starts = np.array([s for s in range(298) if text[s : s + 3].all()])
    got = index.statistics(text, starts, 3)
    for s, g in zip(starts, got):
        for n in (1, 2, 3):
            tail = text[s + 3 - n : s + 3].tolist()
            twice = sum(text[j : j + n].tolist() == tail for j in range(301 - n + 1)) >= 2
            assert (g >= n) == twice


# token counts


def test_ledger(spark, tmp_path):
    tokenizer = token_counts.Tokenizer()
    ledger = token_counts.TokenLedger(spark, str(tmp_path), tokenizer)
    schema = "doc_id bigint, text string, source string, lang string, gone boolean, sign string"
    put = lambda name, rows: ledger.apply(name, spark.createDataFrame([(*r, "x") for r in rows], schema), F.col("gone"))
    count = lambda t: len(token_counts.encoding(tokenizer).encode_ordinary(t))
    total = lambda: {(r.source, r.lang): (r.docs, r.tokens) for r in ledger.rollup().collect()}
    assert total() == {}
    assert put("a", [(1, "one two", "s", "en", False), (2, "three", "s", "en", False), (None, "x", "t", None, False), (3, None, "t", "de", False)])
    first = total()
    assert first == {("s", "en"): (2, count("one two") + count("three")), ("t", None): (1, 1), ("t", "de"): (1, 0)}
    assert not put("a", [(7, "not again", "s", "en", False)]) and total() == first
    assert put("b", [(1, "one two three", "u", "en", False), (2, None, None, None, True), (9, None, None, None, True)])
    assert total() == {("u", "en"): (1, count("one two three")), ("t", None): (1, 1), ("t", "de"): (1, 0)}
    assert put("none", []) and put("c", [(1, None, None, None, True)])
    assert total() == {("t", None): (1, 1), ("t", "de"): (1, 0)}
    # a batch that was interrupted before its mark is not read, and can be applied
    (tmp_path / "totals" / ledger._folder("totals", "c").rpartition("/")[2] / "_SUCCESS").unlink()
    assert ("u", "en") in total()
    assert put("c", [(1, None, None, None, True)]) and ("u", "en") not in total()


def test_a_deletion_takes_a_document_out_of_every_version(spark, tmp_path):
    one = token_counts.TokenLedger(spark, str(tmp_path))
    two = token_counts.TokenLedger(spark, str(tmp_path))
    schema = "doc_id bigint, text string, source string, lang string, gone boolean"

    class Second(token_counts.Tokenizer):
        version = "second"

    two.tokenizer = Second()
    put = lambda ledger, name, rows: ledger.apply(name, spark.createDataFrame(rows, schema), F.col("gone"))
    docs = lambda: {(r.tokenizer == "second", r.docs) for r in one.rollup().collect()}
    put(one, "a", [(1, "x y", "s", "en", False), (2, "z", "s", "en", False)])
    put(two, "b", [(1, "x y", "s", "en", False), (2, "z", "s", "en", False)])
    assert docs() == {(False, 2), (True, 2)}
    put(two, "c", [(1, None, None, None, True), (2, "z z z", "s", "en", False)])  # the revision is one of its own version
    assert docs() == {(False, 1), (True, 1)}


def test_a_compacted_ledger_goes_on(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path))
    put = lambda name, rows: ledger.apply(name, table(spark, rows), F.col("row") == "gone")
    total = lambda: sorted((r.source or "", r.lang or "", r.docs, r.tokens) for r in ledger.rollup().collect())
    ledger.compact()
    assert total() == []
    put("a", [*odd_rows(), (50, "a" * 300_000, "en", "s")])
    first = total()
    for _ in range(2):
        ledger.compact()
        assert total() == first and not put("a", [(99, "again", "en", "s")]) and total() == first
    assert put("b", [(50, "short", "en", "t"), (4, None, "en", "s")])
    rows = ledger.documents().where("doc_id in (4, 50)").collect()
    assert {(r.doc_id, r.source, r.tokens, r.sign) for r in rows} == {(50, "t", 1, 1), (4, "s", 0, 1)}
    after = total()
    ledger.compact()
    assert total() == after and ledger._read("rows", token_counts.ROWS).where("sign < 0").count() == 0
    assert len(list((tmp_path / "snapshots").iterdir())) == 1 and not list((tmp_path / "rows").glob("batch-*"))


# URLs


URLS = [None, "", "no scheme", "http://", "HTTP://Sub.EXAMPLE.org", "http://a.org/x?q#f", "http://example.org/en/12", "http://m.example.org/es/1", "http://example.org/es",
        "https://b.com/de/1?x=/fr/", "https://b.com#/fr/", "ftp://x.net/fr/1", "http://borg/x", "http://a.org", "a://b://c.org/d"]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(rows).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("", "", None), 4: ("sub.example.org", "", None), 5: ("a.org", "/x", "org/"),
        6: ("example.org", "/en/12", "example.org/en/1"), 7: ("m.example.org", "/es/1", "example.org/es/"), 8: ("example.org", "/es", "org/"),
        9: ("b.com", "/de/1", "com/de/"), 10: ("b.com", "", None), 11: ("x.net", "/fr/1", None), 12: ("borg", "/x", None), 13: ("a.org", "", None), 14: ("b:", "//c.org/d", None)}
    assert [got[i].verdict for i in (5, 6, 7, 8, 9)] == ["allow", "block", "block", "allow", "block"]
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(rows.where("page_id < 0")).count() == 0


def test_url_ratio(spark):
    rng = random.Random(2)
    urls = [f"http://{rng.choice(('good', 'fine', 'casino'))}{rng.randrange(30)}.{rng.choice(('org', 'com', 'net'))}/{rng.choice(('fr', 'de', 'en'))}/{rng.randrange(99)}" for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.judge(rows).collect()
    learnt = lambda site: zlib.crc32(site.encode()) % 5 != 0
    sites = {r.host + r.path: (r.verdict if r.rule and learnt(r.host + r.path) else None) for r in got}
    expected = brute.url_scores(sites)
    for r in got:
        assert r.score == pytest.approx(expected[r.host + r.path], abs=1e-9)


# benchmark


ITEMS = [(1, "Once Tom Baker had 5 apples and gave Ann three of them, then walked 12 km home with 5 friends."), (2, "too short"), (3, None), (4, "")]


def flagged(spark, texts, items=ITEMS):
    docs = table(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}


def test_reparameterised_items_are_found(spark):
    got = flagged(spark, [
        "Intro here. Once Bob Miller had 7 apples and gave Eve four of them, then walked 30 km home with 7 friends. More.",
        "Once Bob Miller had 7 apples and gave Eve four of them, then walked 30 km home with 8 friends.",  # 5 is 7 and 8
        ITEMS[0][1].upper().replace(",", ""),  # capitals hide names, the windows without names still match
        "then walked 12 km home", None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "x " * 30_000,
    ])
    assert set(got) == {(0, 1), (2, 1)} and got[0, 1].changed and not got[2, 1].changed and got[0, 1].covered == got[0, 1].item_words


def test_leaks_in_prose(spark):
    items = [(i, prose(i, 30)) for i in range(6)]
    texts = [prose(100 + i, 40 + i) + " " + " ".join(items[i % 6][1].split()[: 12 + i]) + " " + prose(200 + i, 9) for i in range(18)] + [prose(300 + i, 80) for i in range(10)]
    got = flagged(spark, texts, items)
    assert set(got) == brute.leaks(enumerate(texts), items, 11)


def test_attached_units_ordinals_hyphens_and_compound_names_are_found(spark):
    around = "we saw that {} had been left beside the gate"
    words = ["5kg of rice", "twenty-five of them", "pages 10-20 of it", "the 2nd and 12th of them", "a 3x and 3D thing", "songs of the 1980s", "a 5-year-old child", "old McDonald and Mary-Jane"]
    items = [(i, around.format(w)) for i, w in enumerate(words)]
    got = flagged(spark, [around.format(w) for w in words], items)
    assert {(i, i) for i in range(len(words))} <= set(got) and all(not got[i, i].changed and got[i, i].covered == got[i, i].item_words for i in range(len(words)))
    assert set(flagged(spark, [around.format("7kg of rice")], items[:1])) == {(0, 0)}


def test_runs_are_found_at_every_position(spark):
    items = [(0, "green boats sail past seven small quiet islands"), (1, "mix 1 2 3 4 red green blue 5 then stir")]
    texts = [" ".join(["pad"] * k + [t, "end"]) for _, t in items for k in range(4)]
    # of the longer item's windows some have too few ordinary words
    longer = [(2, "1 2 3 4 5 6 red green blue white black pink gold slate brown tan"), (3, "stop mix 1 2 3 4 5 red green blue 6 then stir well or leave")]
    partial = ["so 4 5 6 red green blue white black pink gold slate end", "pad mix 1 2 3 4 5 red green blue 6 then end"]
    assert set(flagged(spark, texts, items)) == {(i, i // 4) for i in range(8)}
    got = flagged(spark, partial, longer)
    assert set(got) == {(0, 2), (1, 3)} and {got[0, 2].covered, got[1, 3].covered} == {11}


def test_items_that_windows_cannot_find_are_found_whole(spark):
    items = [(0, "What is the capital of France?"), (1, "法国的首都是哪里"), (2, "1 2 3 plus 4 5 6 makes 21 and 7"), (3, "Tom walks past the old gate every day"), (4, "?!"), (5, "ไทยคือที่ไหน")]
    texts = ["Quiz: what is the capital of france, they said", "请问法国的首都是哪里？谢谢", "so 1 2 3 plus 4 5 6 makes 21, and 7", "now Tom walks past the old gate every day",
             "what is the capital of Frances", "法国的首都在哪里", "1 2 3 plus 4 5 6 makes 21 and 8", "?!", "ถามว่าไทยคือที่ไหนครับ", None, ""]
    got = flagged(spark, [*texts, texts[0]], items)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (8, 5), (11, 0)}
    assert all(r.covered == r.item_words and not r.changed for r in got.values())


def test_new_values_may_coincide(spark):
    pears = "Then Anna bought {} apples and {} pears at the market and carried all {} of them home in {} bags"
    got = flagged(spark, [pears.format(4, 4, 8, 4), pears.format(7, 9, 16, 3)], [(0, pears.format(3, 5, 8, 2))])
    assert set(got) == {(0, 0), (1, 0)} and all(r.changed and r.covered == r.item_words for r in got.values())


def test_clean_keeps_columns_and_odd_rows(spark):
    docs = table(spark, [*odd_rows(), (90, ITEMS[0][1], "en", "s")])
    out = decontaminate.clean(docs, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert out.columns == docs.columns and out.count() == len(odd_rows())
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == len(odd_rows()) + 1
    assert decontaminate.clean(table(spark, []), spark.createDataFrame(ITEMS, "item_id bigint, text string")).count() == 0


# mixing


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(i, rng.randint(0, 60)), "en", rng.choice([None, "a", "b", "b", "b", "b", "c", "d", "é"])) for i in range(300)]
    queued, line = mixing.mix(table(spark, rows))
    got = mixing.taken(queued, line).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken <= 2 * r.size and r.size == len((rows[r.doc_id][1] or "").split())
    expected = brute.fair_shares(sizes)
    for s, t in expected.items():
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(t) and abs(sum(r.taken for r in mine) - mine[0].target) < 1
    order = line.orderBy("position").collect()
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    assert sum(r.words for r in order) == order[-1].position == 3 * sum(sizes.values()) // 2
    again = mixing.taken(*mixing.mix(table(spark, rows[::-1]).repartition(7)))
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in got}


def test_the_truncation_alone_ends_the_mix(spark):
    """In the order of finish times, what comes before the budget; all packets together are every queue twice."""
    rows = [(i, prose(i, 1 + i * 37 % 50), "en", "abc"[i % 7 % 3]) for i in range(60)]
    docs = table(spark, rows)
    queued, line = mixing.mix(docs)
    every = sorted(((r.finish, r.skey, r["from"], r.start, r.words) for r in mixing.packets(queued).collect()))
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert sum(p[-1] for p in every) == 2 * total
    left, expected = 3 * total // 2, {}
    for _, skey, _, start, words in every:
        if (words := min(words, left)) > 0:
            expected[skey, start] = expected.get((skey, start), 0) + words
            left -= words
    got = {(r.skey, r.start): r.taken for r in mixing.taken(queued, line).collect() if r.taken}
    assert got == expected and sum(got.values()) < 2 * total


def test_mixed_keeps_null_and_repeated_ids(spark):
    rows = [(None, "a b c", "en", "s"), (None, "d e", "en", None), (1, "x y", "en", "s"), (1, "x y", "en", "s"), (1, "other words", "en", "s"), (2, "z " * 9, "en", "t")]
    docs = table(spark, rows).withColumn("taken", F.lit("x"))
    queued, line = mixing.mix(docs)
    shares = sorted((r.doc_id or 0, r.source or "", r.size, r.taken) for r in mixing.taken(queued, line).collect() if r.taken)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "taken_by_mix"]
    assert sorted((r.doc_id or 0, r.source or "", len(r.text.split()), r.taken_by_mix) for r in out.collect()) == shares


def test_mix_odd_rows(spark):
    out = mixing.taken(*mixing.mix(table(spark, odd_rows()))).collect()
    assert len(out) == len(odd_rows()) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.taken(*mixing.mix(table(spark, []))).count() == 0
    assert {r.taken for r in mixing.taken(*mixing.mix(table(spark, [(1, None), (2, "")]))).collect()} == {0}
    kept = mixing.mixed(table(spark, [(1, "a b"), (2, "")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "keep_id", "row", "taken"] and [r.doc_id for r in kept.collect()] == [1]
