"""The registered corpus queries on the smallest tables: against SQL where there is some, else a plain definition."""

import os
import zlib

import check_oracles
import corpus_pipeline
import llm_brute as brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lesionlens.llm import token_counts
from lesionlens.llm.queries import ORACLES, QUERIES

SF = os.environ.get("LESIONLENS_TEST_SF", "/root/testdata/sf0.001")
LABELLED = os.environ.get("LESIONLENS_TEST_LABELLED", "/root/testdata/sf0.01")  # the smallest has 19 held-out labels only
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.partition("_")[0] for q in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem = check_oracles.compare(spark, check_oracles.connect(SF), SF, name)[1]
    assert problem is None, problem


def test_near_dup(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_near_dup"](spark, SF).collect()}
    assert got == brute.near_components([(r.doc_id, r.text) for r in rows])


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    assert all(r.held_out == fold(i) and 0 <= r.score <= 1 for i, r in got.items()) and len(got) == len(rows)
    held = [r for r in rows if fold(r.doc_id)]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


@pytest.mark.parametrize("name, label, least, share", [("op4_toxicity", "toxic", 0.5, 0.85), ("op10_quality", "quality", 0.3, 0.95)])
def test_classifiers(spark, name, label, least, share):
    got = {r.doc_id: r for r in QUERIES[name](spark, LABELLED).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{LABELLED}/documents.parquet").count() and all(r.held_out == fold(i) and r.predicted == int(r.score >= least) for i, r in got.items())
    held = [i for i in labels if i in got and fold(i)]
    assert sum(got[i].predicted == labels[i] for i in held) >= share * len(held)


def test_token_counts(spark, rows):
    encode = token_counts.encoding(token_counts.Tokenizer()).encode_ordinary
    expected = {}
    for r in rows:
        docs, tokens = expected.get((r.source, r.lang), (0, 0))
        expected[r.source, r.lang] = docs + 1, tokens + len(encode(r.text or ""))
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in QUERIES["op6_token_counts"](spark, SF).collect()} == expected


def test_url_filter(spark):
    got = QUERIES["op7_url_filter"](spark, SF).collect()
    labels = {r.host + r.path: r.verdict if r.rule and zlib.crc32((r.host + r.path).encode()) % 5 else None for r in got}
    scores = brute.url_scores(labels)
    assert all(r.score == pytest.approx(scores[r.host + r.path], abs=1e-9) for r in got)
    free = [r for r in got if r.rule is None]
    assert max([r.score for r in free if r.verdict == "block"], default=-9) < min([r.score for r in free if r.verdict == "allow"], default=9)


def test_decontamination(spark, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert got == brute.leaks([(r.doc_id, r.text) for r in rows], items, 11)


def test_pipeline_equals_its_stages_in_plain_form(spark, rows):
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    left = [r for r in rows if any(map(str.isalpha, r.text or ""))]
    newest = {r.text: r.doc_id for r in sorted(left, key=lambda r: r.doc_id)}
    left = [r for r in left if newest[r.text] == r.doc_id]
    groups = brute.near_components([(r.doc_id, r.text) for r in left], 5)
    left = [r for r in left if groups[r.doc_id][1] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, _ in brute.leaks([(r.doc_id, r.text) for r in left], items, 11)}
    left = [r for r in left if r.doc_id not in leaky]
    sizes = {}
    for r in left:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.WORD.findall(r.text))
    targets = brute.fair_shares(sizes)
    by_source = {s: sum(got.get(r.doc_id, 0) for r in left if r.source == s) for s in sizes}
    assert set(got) <= {r.doc_id for r in left}
    assert all(abs(by_source[s] - targets[s]) <= 1 for s in sizes)


def test_stages_keep_the_columns_of_documents_and_work_on_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and (out.columns == docs.columns or name == "mixing")
        out = stage(spark, docs.where("false"), SF)
        assert out.count() == 0
