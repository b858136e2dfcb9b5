import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lesionlens.functions.fixed import SEED
from lesionlens.functions.tails import chi2_p, correlation_p, log_beta_tail, normal_p
from lesionlens.operators import binning, embed, ordered, ranks, resample, scores
from lesionlens.operators.resample import MODULUS, chunk_multiplicities
from lesionlens.session import materialize


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(11)
    n = 400
    size = rng.integers(0, 60, n).astype(float)
    pdf = pd.DataFrame({
        "case_id": np.arange(n), "fold": np.arange(n) % 4, "domain": np.array(list("abc"))[rng.integers(0, 3, n)],
        "size": size, "ratio": rng.integers(0, 20, n) / 20.0, "noise": rng.random(n),
    })
    pdf["score"] = np.round(np.tanh(size / 40) + rng.normal(0, 0.2, n), 1)
    for c, share in (("ratio", 0.05), ("score", 0.08)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, cases):
    return spark.createDataFrame(cases.astype(object).where(cases.notna(), None), "case_id long, fold int, domain string, size double, ratio double, noise double, score double").cache()


HYPOTHESES = [("one", "ratio", "score", ("size",)), ("two", "noise", "score", ("size", "ratio"))]


def partial(pdf, f, o, controls):
    r = pdf[[f, o, *controls]].dropna().rank()
    d = np.column_stack([np.ones(len(r)), r[list(controls)]])
    res = [r[c] - d @ np.linalg.lstsq(d, r[c], rcond=None)[0] for c in (f, o)]
    return np.corrcoef(*res)[0, 1]


def test_tail_golden_values():
    # rho, n, p of a published table: n - 2 degrees of freedom
    for rho, n, p in (
        (0.48315363516866716, 1343, 1.7465225144082916e-79), (-0.03921616871068022, 1343, 0.15089769228921215),
        (0.34962820297573943, 1318, 3.44821633103976e-39), (-0.25910111974976796, 1343, 4.833922836353555e-22),
    ):
        assert correlation_p(rho, n - 2) == pytest.approx(p, rel=1e-9)
    assert normal_p(1.959963984540054) == pytest.approx(0.05)
    assert chi2_p(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_p(10.0, 4) == pytest.approx(math.exp(-5) * 6)
    assert math.exp(log_beta_tail(0.3, 2, 5)) == pytest.approx(0.579825)


def test_adjusted_golden_values(spark):
    rows = [("f", "a", 1.7465225144082916e-79), ("f", "b", 0.15089769228921215), ("f", "c", 3.44821633103976e-39), ("f", "d", 4.833922836353555e-22), ("f", "e", None)]
    got = {r["t"]: r["p_fdr"] for r in ranks.bh_fdr(spark.createDataFrame(rows, "family string, t string, p double"), "p", ["family"], "t").collect()}
    assert got["a"] == pytest.approx(6.986090057633166e-79) and got["b"] == pytest.approx(0.15089769228921215)
    assert got["c"] == pytest.approx(6.89643266207952e-39) and got["d"] == pytest.approx(6.445230448471406e-22) and got["e"] is None


@pytest.mark.parametrize("small", [True, False])
def test_bh_monotone_and_direct(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(ordered, "SMALL_ROWS", 0)
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300) ** 2, 2)
    fam = rng.integers(0, 2, 300)
    d = spark.createDataFrame(pd.DataFrame({"f": fam, "t": np.arange(300), "p": p}))
    got = ranks.bh_fdr(d, "p", ["f"], "t").toPandas().set_index("t").p_fdr
    for k in (0, 1):
        i = np.flatnonzero(fam == k)
        o = i[np.argsort(p[i], kind="stable")]
        want = np.minimum.accumulate((p[o] * len(o) / np.arange(1, len(o) + 1))[::-1])[::-1].clip(max=1)
        assert np.allclose(got.loc[o], want)


def test_spearman_and_pearson(df, cases):
    got = ranks.spearman(df, ["size", "ratio"], ["score"]).toPandas().set_index("feature")
    for f in ("size", "ratio"):
        sub = cases[[f, "score"]].dropna()
        want = np.corrcoef(sub.rank(), rowvar=False)[0, 1]
        assert got.rho[f] == pytest.approx(want) and got.n[f] == len(sub)
        assert got.p_value[f] == pytest.approx(correlation_p(want, len(sub) - 2))
    row = ranks.pearson(df, "size", "score", []).first()
    sub = cases[["size", "score"]].dropna()
    assert row["r"] == pytest.approx(np.corrcoef(sub, rowvar=False)[0, 1])
    constant = df.withColumn("k", F.lit(3.0))
    assert ranks.pearson(constant, "k", "score", [], p_value=False).first()["r"] is None
    assert ranks.spearman(constant, ["k"], ["score"], p_value=False).first()["rho"] is None


def test_partial_spearman(df, cases):
    got = ranks.partial_spearman(df, HYPOTHESES).toPandas().set_index("label")
    adjusted = ranks.partial_spearman(df, HYPOTHESES, dof="adjusted").toPandas().set_index("label")
    for label, f, o, controls in HYPOTHESES:
        want = partial(cases, f, o, controls)
        n = len(cases[[f, o, *controls]].dropna())
        assert got.partial_rho[label] == pytest.approx(want) and got.n[label] == n
        assert got.p_value[label] == pytest.approx(correlation_p(want, n - 2))
        assert adjusted.p_value[label] == pytest.approx(correlation_p(want, n - 2 - len(controls)))
    twice = df.withColumn("again", F.col("size") * 2)
    assert ranks.partial_spearman(twice, [("x", "ratio", "score", ("size", "again"))], p_value=False).first()["partial_rho"] is None


def test_routing_is_dealt_to_fixed_partitions(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 1000), ("c", 25)], "g string, n long")
    routes = resample._routes(sizes, 300, SEED, 20, 4).withColumn("part", F.spark_partition_id()).toPandas()
    assert routes.part.nunique() == 4  # adaptive execution merged the few small rows into one task
    per = resample._per_unit(20)
    for n, rows in routes.groupby("n"):
        want = resample.routed(np.array([1, 300]), n, SEED, 20)
        for b, counts in zip((1, 300), want):
            mine = rows[rows.replicate == b].sort_values("_unit")
            assert np.array_equal(np.concatenate(mine.taken.to_numpy()), counts) and len(mine) == -(-len(counts) // per)


def test_small_chunks_share_a_task(spark, monkeypatch):
    n = 250
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "k": np.arange(n), "v": np.where(np.arange(n) % 7, np.arange(n) / 8.0, np.nan)})).withColumn("v", F.nanvl("v", F.lit(None)))
    alone = resample.bootstrap_sums(df, ["g"], ["v"], "k", 9, size=20)
    monkeypatch.setattr(resample, "CHUNK", 20)
    apart = resample.bootstrap_sums(df, ["g"], ["v"], "k", 9, size=20)
    a, b = (x.toPandas().sort_values(["g", "replicate"]).to_numpy(float) for x in (alone, apart))
    assert len(a) == 18 and np.array_equal(a, b)


def test_bootstrap_partial_same_on_both_ways(df, cases, monkeypatch):
    blocks = ranks.bootstrap_partial_spearman(df, HYPOTHESES, ["fold"], replicates=12).toPandas().set_index("label").sort_index()
    monkeypatch.setattr(ranks, "BLOCK_ROWS", 0)
    keyed = ranks.bootstrap_partial_spearman(df, HYPOTHESES, ["fold"], replicates=12).toPandas().set_index("label").sort_index()
    assert np.allclose(blocks, keyed)
    want = {h[0]: [] for h in HYPOTHESES}
    for b in range(1, 13):
        parts = []
        for _, stratum in cases.groupby("fold"):
            parts.append(stratum.iloc[resample.draws(np.array([b]), np.arange(1, len(stratum) + 1), len(stratum), SEED)[0]])
        sample = pd.concat(parts, ignore_index=True)
        for label, *h in HYPOTHESES:
            want[label].append(partial(sample, *h))
    for label, v in want.items():
        assert np.allclose(blocks.loc[label, ["ci_low", "ci_high"]].to_numpy(float), np.quantile(v, [0.025, 0.975]))


def test_keyed_bootstrap_makes_no_row_for_each_replicate(spark, cases, monkeypatch):
    """Vectors over replicates are ranked in pieces; several chunks, pieces and blocks of replicates give what whole tables give."""
    monkeypatch.setattr(resample, "CHUNK", 64)
    monkeypatch.setattr(ranks, "CHUNK", 64)
    monkeypatch.setattr(ranks, "PIECE_ROWS", 100)
    monkeypatch.setattr(ranks, "VECTOR", 7)
    stored_rows = {}

    def counted(df, name="stage"):
        out = materialize(df, name)
        stored_rows[name] = max(stored_rows.get(name, 0), out.count())
        return out

    pdf = pd.concat([cases, cases.assign(case_id=cases.case_id + 1000, size=cases["size"] - 1)], ignore_index=True)
    pdf["fold"] = np.where(pdf.case_id % 5 == 0, None, (pdf.case_id % 3 % 2).astype(str))
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    drawn = resample.bootstrap_weights(df, ["fold"], "case_id", 15, size=64).select("case_id", "replicate", "w").toPandas()
    want = {h[0]: [] for h in HYPOTHESES}
    for _, rows in drawn.groupby("replicate"):
        sample = pdf.set_index("case_id").loc[np.repeat(rows.case_id, rows.w)]
        for label, *h in HYPOTHESES:
            want[label].append(partial(sample, *h))
    monkeypatch.setattr(ranks, "materialize", counted)
    monkeypatch.setattr(ordered, "materialize", counted)
    got = ranks.bootstrap_partial_spearman(df, HYPOTHESES, ["fold"], replicates=15, block_rows=0).toPandas().set_index("label")
    for label, v in want.items():
        assert len(v) == 15 and np.allclose(got.loc[label, ["ci_low", "ci_high"]].to_numpy(float), np.quantile(v, [0.025, 0.975]))
    vectors = 3 * len(pdf) * sum(2 + len(h[3]) for h in HYPOTHESES)  # at most one for each case, variable and block of replicates
    assert max(stored_rows.values()) <= vectors  # the rows were 15 times as many before


def test_a_task_holds_one_replicate_at_a_time(cases):
    rng = np.random.default_rng(3)
    x = {c: cases[c].to_numpy(float) for c in ("size", "ratio", "noise", "score")}
    times = rng.integers(0, 4, (5, len(cases)))
    tests = ranks.WeightedRanks(x, HYPOTHESES)
    for label, f, o, controls in HYPOTHESES:
        table = np.column_stack([x[c] for c in (f, o, *controls)])
        full = ~np.isnan(table).any(axis=1)
        want = ranks.weighted_partial_rho(table[full], times[:, full])
        assert np.allclose([tests.partial_rho(t.astype(float))[label] for t in times], want, rtol=1e-12)
    assert not hasattr(ranks, "BLOCK_CELLS")  # no matrix of weights whose rows grow with the table


def test_mann_whitney_and_sensitivity(df, cases):
    flagged = binning.quantile_flags(df, "score")
    cut = {p: cases.score.quantile(p / 100) for p in (5, 10, 20)}
    ok = cases[cases.score.notna()]
    got = ranks.mann_whitney(flagged, "failure_bottom10", ["size", "ratio"], "failure_eligible").toPandas().set_index("feature")
    sens = ranks.failure_sensitivity(flagged, ["size", "ratio"]).toPandas().set_index(["percentile", "feature"])
    for f in ("size", "ratio"):
        for p in (5, 10, 20):
            x, y = (ok[(ok.score <= cut[p]) == hit][f].dropna().to_numpy() for hit in (True, False))
            u = (x[:, None] > y[None, :]).sum() + 0.5 * (x[:, None] == y[None, :]).sum()
            assert sens.loc[(p, f), "u_statistic"] == u
            assert sens.loc[(p, f), "rank_biserial"] == pytest.approx(2 * u / (len(x) * len(y)) - 1)
            if p == 10:
                assert got.u_statistic[f] == u and got.failure_median[f] == pytest.approx(np.median(x))
                t = pd.Series(np.r_[x, y]).value_counts().to_numpy(float)
                n1, n2, n = len(x), len(y), len(x) + len(y)
                sd = math.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
                z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
                assert got.p_value[f] == pytest.approx(min(1.0, normal_p(z)))
    assert (sens.p_fdr_within_percentile >= sens.p_value - 1e-12).all()


def test_kruskal(df, cases):
    row = ranks.kruskal(df, "domain", ["score"]).first()
    sub = cases[["domain", "score"]].dropna()
    r, n = sub.score.rank(), len(sub)
    q = sum(r[sub.domain == d].sum() ** 2 / (sub.domain == d).sum() for d in "abc")
    t = sub.score.value_counts().to_numpy(float)
    h = (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    assert row["h_statistic"] == pytest.approx(h) and row["p_value"] == pytest.approx(math.exp(-h / 2))


def test_draw_formula_and_totals():
    b, times = next(chunk_multiplicities(30, 0, 5, SEED))
    for k, row in zip(b, times):
        want = np.zeros(30, int)
        for i in range(1, 31):
            h1 = (int(k) * 7919 + i * 104729 + SEED) % MODULUS
            h2 = (h1 * h1 + 12345) % MODULUS
            want[(h2 * 48271 + int(k)) % MODULUS % 30] += 1
        assert (row == want).all()
    parts = [np.concatenate([t for _, t in chunk_multiplicities(1000, c, 40, 7, size=300)]) for c in range(4)]
    whole = np.concatenate(parts, axis=1)
    assert whole.shape == (40, 1000) and (whole.sum(axis=1) == 1000).all()
    assert 0.6 < (whole > 0).mean() < 0.66


def plain_draws(n, b, salt, size):
    """The rows that replicate b of a group of n rows takes, by the definition alone."""
    def h(i, s):
        h1 = (b * 7919 + i * 104729 + s) % MODULUS
        return ((h1 * h1 + 12345) % MODULUS * 48271 + b) % MODULUS

    chunks = -(-n // size)
    sent = [0] * chunks
    for i in range(1, n + 1):
        sent[(h(i, salt + resample.ROUTE[0]) * MODULUS + h(i, salt + resample.ROUTE[1])) % n // size if chunks > 1 else 0] += 1
    return [c * size + h(j, salt + c * resample.STEP) % min(size, n - c * size) for c, m in enumerate(sent) for j in range(1, m + 1)]


@pytest.mark.parametrize("size", [7, 50, 300])
def test_one_definition_at_every_size(spark, size):
    rows = [(g, k, float(k * k % 17) if k % 5 else None) for g, n in (("a", 50), ("b", 51), (None, 7), ("c", 120), ("d", 51)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(5)
    got = {(r.g, r.replicate): (r.sum_v, r.n_v) for r in resample.bootstrap_sums(df, ["g"], ["v"], "id", 30, size=size, rows=len(rows)).collect()}
    drawn = {(r.g, r.replicate): (r.s, r.w) for r in resample.bootstrap_weights(df, ["g"], "id", 30, size=size)
             .groupBy("g", "replicate").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("w")).collect()}
    for g in ("a", "b", "c", "d", None):
        v = [x for k, _, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])]
        for b in range(1, 31):
            sample = [v[d] for d in plain_draws(len(v), b, SEED, size)]
            known = [x for x in sample if x is not None]
            assert got[g, b] == (pytest.approx(sum(known)), len(known)) and drawn[g, b] == (pytest.approx(sum(known)), len(v))


def test_a_row_beyond_the_chunk_leaves_its_stream():
    for n in (resample.CHUNK, resample.CHUNK + 1):
        b = np.arange(1, 4)
        taken = resample.routed(b, n, SEED)
        picked, valid = resample.chunk_draws(b, taken[:, 0], resample.CHUNK, 0, SEED)
        whole = resample.draws(b, np.arange(1, picked.shape[1] + 1), resample.CHUNK, SEED)
        assert (picked == whole).all() and (valid.sum(axis=1) == taken[:, 0]).all() and (taken.sum(axis=1) == n).all()
    assert (resample.CHUNK - taken[:, 0] < 8).all()


def test_routing_is_even():
    taken = resample.routed(np.arange(1, 201), 40_000, 7, size=1_000)
    assert (taken.sum(axis=1) == 40_000).all()
    chi2 = ((taken - 1_000) ** 2 / 1_000).sum(axis=1)  # 39 degrees of freedom
    assert 36 < chi2.mean() < 42 and 60 < chi2.var() < 100


def test_bootstrap_mean_over_several_chunks(spark):
    n = 20_000
    pdf = pd.DataFrame({"id": np.arange(n), "v": np.random.default_rng(1).normal(5, 2, n)})
    wide = resample.bootstrap_mean(spark.createDataFrame(pdf).repartition(16), "v", [], "id", 400).first()
    again = resample.bootstrap_mean(spark.createDataFrame(pdf).coalesce(1), "v", [], "id", 400).first()
    assert wide["ci_low"] == pytest.approx(again["ci_low"], rel=1e-12)
    se = pdf.v.std() / math.sqrt(n)
    assert (wide["ci_high"] - wide["ci_low"]) / (2 * 1.96 * se) == pytest.approx(1, abs=0.15)
    assert wide["ci_low"] < pdf.v.mean() < wide["ci_high"]


def test_bootstraps_on_missing_and_infinite(spark):
    rows = [("a", 1, 1.0, 0.5), ("a", 2, float("inf"), 0.5), ("a", 3, 3.0, None), ("a", 4, 2.0, 1.0), ("b", 1, None, None)]
    d = spark.createDataFrame(rows, "g string, id int, l double, r double")
    got = {r["g"]: r for r in resample.bootstrap_paired(d, "l", "r", ["g"], "id", 50).collect()}
    assert (got["a"]["n"], got["a"]["n_dropped_left"], got["a"]["n_dropped_right"]) == (2, 1, 1)
    assert got["a"]["mean_difference"] == pytest.approx(0.75) and got["b"]["n"] == 0 and got["b"]["ci_low"] is None
    gap = scores.source_target_gap(d.where("g = 'a'"), d.where("g = 'a'"), {"l": "L", "r": "R"}, "id", 50).toPandas().set_index("region")
    assert gap.mean_difference["MEAN"] == pytest.approx(0) and gap.n_target["MEAN"] == 4 and gap.n_target["L"] == 3


def test_qcut_matches_pandas(df, cases):
    got = binning.qcut(df, "size", 12, "drop").toPandas().set_index("case_id").bin.sort_index()
    want = pd.qcut(cases["size"], 12, duplicates="drop", labels=False)
    assert (got.to_numpy() == want.to_numpy()).all()
    lumpy = df.withColumn("lump", F.when(F.col("case_id") < 200, 1.0).otherwise(F.col("size")))
    with pytest.raises(Exception, match="not unique"):
        binning.qcut(lumpy, "lump", 5).collect()
    rate = binning.binned_rate(binning.quantile_flags(df, "score").where("failure_eligible"), "noise", "failure_bottom10").toPandas()
    assert rate["count"].sum() == cases.score.notna().sum()


def test_flags_ignore_missing(df, cases):
    got = binning.quantile_flags(df, "score").toPandas().set_index("case_id").sort_index()
    assert (got.failure_eligible == cases.score.notna()).all()
    assert (got.failure_bottom20 == (cases.score <= cases.score.quantile(0.2))).all()


def test_embedding(df, cases):
    cols = ["size", "ratio", "noise", "score"]
    filled = embed.impute_median(df, cols)
    scaled = embed.standardize(filled, cols)
    x = cases[cols].fillna(cases[cols].median())
    x = ((x - x.mean()) / x.std(ddof=0)).to_numpy()
    explained, points = embed.pca(scaled, cols)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    ratios = explained.toPandas().sort_values("component").explained_ratio.to_numpy()
    assert np.allclose(ratios, s**2 / (s**2).sum())
    got = points.toPandas().set_index("case_id").sort_index()
    want = x @ vt[0]
    want *= np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert np.allclose(got.pca1, want)


def test_domain_summary_masks_ineligible(df, cases):
    flagged = binning.quantile_flags(df, "score")
    got = scores.domain_summary(flagged, "domain", outcomes=("score", "failure_bottom10"), replicates=50).toPandas().set_index("domain")
    for d, part in cases.groupby("domain"):
        assert got.n[d] == len(part) and got.score_n[d] == part.score.notna().sum() == got.failure_bottom10_n[d]
        assert got.score_mean[d] == pytest.approx(part.score.mean())


def test_spearman_ranks_once_per_missing_pattern(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 90
    pdf = pd.DataFrame({c: rng.integers(0, 12, n).astype(float) for c in ("f1", "f2", "f3", "o1", "o2", "o3")})
    pdf.loc[:9, "o2"] = np.nan
    pdf.loc[:9, "o3"] = np.nan  # the same cases as o2
    pdf.loc[20:25, "f3"] = np.nan
    pdf["case_id"] = [7] * n  # ids need not be unique
    seen, plain = [], ranks.ranked
    monkeypatch.setattr(ranks, "ranked", lambda frame, *a, **k: (seen.append(frame.count()), plain(frame, *a, **k))[1])
    got = {(r.feature, r.outcome): (r.n, r.rho) for r in ranks.spearman(spark.createDataFrame(pdf), ["f1", "f2", "f3"], ["o1", "o2", "o3"], p_value=False).collect()}
    for f in ("f1", "f2", "f3"):
        for o in ("o1", "o2", "o3"):
            both = pdf[[f, o]].dropna()
            assert got[f, o] == (len(both), pytest.approx(both[f].rank().corr(both[o].rank())))
    assert len(seen) == 1 and seen[0] < 12 * n  # two patterns on either side, 9 pairs of two columns would be 18 rows a case
    empty = ranks.spearman(spark.createDataFrame(pdf).where("false"), ["f1"], ["o1"]).collect()
    assert empty == []
