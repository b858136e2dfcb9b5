"""Catalogue, case part: score tables, feature statistics and resampling, with the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lesionlens.functions.fixed import DOMAIN_NAMES, ET_FAILURE_BELOW, FAILURE_PERCENTILES, REPLICATES, REPLICATES_SHORT, SEED, UNKNOWN_GROUP, WT_FAILURE_BELOW
from lesionlens.functions.scalars import (
    below, domain_of, log_millilitres, log_volume, norm_missing, recode, relative_bias, row_mean, safe_ratio,
)
from lesionlens.operators import binning, embed, guards, ordered, ranks, resample, scores as sc
from lesionlens.operators.lookup import lookup
from lesionlens.plans.check_sql import GRID, SALT2, bootstrap_ctes, correlation_p, digits, drawn_ctes, fx, interval, normal_p, with_
from lesionlens.plans.fixtures import fixture, table
from lesionlens.session import materialize
from lesionlens.sources import readers

METRICS = ("dsc_et", "dsc_tc", "dsc_wt")
CONTRASTS = {"c2_minus_c1": ("c2", "c1"), "c4_minus_c3": ("c4", "c3"), "c3_minus_c1": ("c3", "c1"), "c5_minus_c4": ("c5", "c4"), "c6_minus_c5": ("c6", "c5")}
FEATURES = ("wt_volume", "et_volume", "et_wt_ratio", "largest_fraction", "n_large")
OUTCOMES = ("mean_dice", "wt_dice", "tc_dice", "et_dice")
HYPOTHESES = [
    ("volume", "et_volume", "mean_dice", ("wt_volume",)),
    ("ratio", "et_wt_ratio", "mean_dice", ("et_volume", "wt_volume")),
    ("largest", "largest_fraction", "mean_dice", ("et_volume", "wt_volume")),
    ("large", "n_large", "mean_dice", ("et_volume", "wt_volume")),
]
DOMAIN_CODES = {"BUILDING": "Domain A", "MACHINERY": "Domain B", "AUTOMOBILE": "Domain C"}


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "scores")


def features(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "features")


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return binning.quantile_flags(materialize(features(spark, sf), "features"))


def _round(df: DataFrame, keys, columns, digits: int = 9) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


# --- score tables -----------------------------------------------------------------------------------

def scan_filter_regex(spark, sf):
    return readers.keep_matching(fixture(spark, sf, "subjects"), "subject_id", r"^case-\d{6}-seg\.nii\.gz$").orderBy("subject_id")


def unpivot_scores(spark, sf):
    return sc.unpivot_scores(scores(spark, sf), ["config", "case_id"], list(METRICS))


RAW = ("case when l_linenumber = 3 then double('NaN') when l_linenumber = 5 then double('Infinity') "
             "when l_linenumber = 6 then double('-Infinity') else l_extendedprice end")


def norm_missing_q(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.expr(RAW).alias("raw")).withColumn("v", norm_missing("raw"))
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("top")
    )


def align_guard(spark, sf):
    return guards.align_guard(scores(spark, sf), "config", "case_id", 7)


def paired_join(spark, sf):
    out = sc.paired_join(scores(spark, sf), "config", "case_id", list(METRICS), CONTRASTS)
    return out.where(F.col("left").isNotNull() & F.col("right").isNotNull())


def aggregate_scores(spark, sf):
    return _round(sc.aggregate_scores(scores(spark, sf), ["config"], list(METRICS)), ["config", "metric", "n"], ["mean", "sd"])


PAIRED = ("mean_difference", "median_difference", "ci_low", "ci_high")


def bootstrap_paired(spark, sf, size=resample.CHUNK):
    pairs = sc.paired_join(scores(spark, sf), "config", "case_id", list(METRICS), {"x": ("c2", "c1")})
    out = resample.bootstrap_paired(pairs, "left", "right", ["metric"], "case_id", REPLICATES, size=size)
    return _round(out, ["metric", "n", "n_dropped_left", "n_dropped_right"], PAIRED)


SMALL_CHUNK = 300  # so that every group is routed over several chunks at any scale


def bootstrap_paired_chunks(spark, sf):
    return bootstrap_paired(spark, sf, SMALL_CHUNK)


def _split(spark, sf):
    df = scores(spark, sf)
    return df.where("config = 'c2'"), df.where("config = 'c1'")


GAP = ("target_mean", "source_mean", "mean_difference", "ci_low", "ci_high")


def bootstrap_independent(spark, sf):
    df = sc.unpivot_scores(scores(spark, sf), ["config", "case_id"], list(METRICS))
    out = resample.bootstrap_independent(
        df.where("config = 'c2'"), df.where("config = 'c1'"), "value", ["metric"], "case_id", REPLICATES
    )
    return _round(out, ["metric", "n_target", "n_source"], GAP)


def bootstrap_region_mean(spark, sf):
    out = resample.bootstrap_region_mean(*_split(spark, sf), list(METRICS), "case_id", REPLICATES)
    return _round(out, ["n_target", "n_source"], GAP)


def paired_comparisons(spark, sf):
    out = sc.paired_comparisons(scores(spark, sf), "config", "case_id", list(METRICS), CONTRASTS, REPLICATES)
    return _round(out, ["comparison", "metric", "n"], PAIRED)


def source_target_gap(spark, sf):
    out = sc.source_target_gap(*_split(spark, sf), {m: m[-2:].upper() for m in METRICS}, "case_id", REPLICATES)
    return _round(out, ["region", "n_target", "n_source"], GAP)


# --- feature tables ---------------------------------------------------------------------------------

def scan_features(spark, sf):
    return features(spark, sf)


def row_mean_q(spark, sf):
    return features(spark, sf).select("case_id", row_mean("et_dice", "tc_dice", "wt_dice").alias("mean_dice"))


def log_volume_q(spark, sf):
    return features(spark, sf).select(
        "case_id", F.round(log_volume("et_volume"), 9).alias("log_et_volume"),
        F.round(log_millilitres("et_volume"), 9).alias("log_et_volume_ml"),
    )


def safe_ratios(spark, sf):
    return features(spark, sf).select(
        "case_id", safe_ratio("tc_volume", "wt_volume").alias("tc_wt_ratio"), safe_ratio("et_volume", "wt_volume").alias("et_wt_ratio"),
        safe_ratio("et_volume", "tc_volume").alias("et_tc_ratio"),
    )


def volume_bias(spark, sf):
    return features(spark, sf).select("case_id", *[relative_bias(f"pred_{r}_volume", f"{r}_volume").alias(f"{r}_volume_bias") for r in ("et", "tc", "wt")])


def recode_default(spark, sf):
    return features(spark, sf).select("case_id", recode("domain", DOMAIN_CODES, "Unknown domain").alias("header_domain"))


def recode_chain(spark, sf):
    """Customers to group codes by their latest order's priority, some without, some with a code without a name."""
    codes = F.create_map(*[F.lit(x) for kv in {"1-URGENT": "GLI", "2-HIGH": "SSA", "3-MEDIUM": "MEN", "5-LOW": "OTHER"}.items() for x in kv])
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    known = last.select("case_id", F.try_element_at(codes, F.col("p")).alias("code"))
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")).join(known, "case_id", "left")
    return cases.select("case_id", F.coalesce("code", F.lit(UNKNOWN_GROUP)).alias("group_code"), domain_of("code").alias("header_domain"))


def abs_flags(spark, sf):
    return features(spark, sf).select(
        "case_id", below("et_dice", ET_FAILURE_BELOW).alias("et_failure"), below("wt_dice", WT_FAILURE_BELOW).alias("wt_failure")
    )


FLAGS = ["failure_eligible", *[f"failure_bottom{p:02d}" for p in FAILURE_PERCENTILES]]


def quantile_flags(spark, sf):
    return flagged(spark, sf).select("case_id", *FLAGS)


def failure_counts(spark, sf):
    return sc.failure_counts(flagged(spark, sf), WT_FAILURE_BELOW, ET_FAILURE_BELOW)


SUMMARY_OUTCOMES = (*OUTCOMES, "failure_bottom10")


def domain_summary(spark, sf):
    out = sc.domain_summary(flagged(spark, sf), "domain", replicates=REPLICATES_SHORT)
    cols = [f"{o}_{c}" for o in SUMMARY_OUTCOMES for c in ("mean", "ci_low", "ci_high")]
    return _round(out, ["domain", "n", *[f"{o}_n" for o in SUMMARY_OUTCOMES]], cols)


def bootstrap_group(spark, sf):
    out = resample.bootstrap_mean(features(spark, sf), "et_dice", ["domain"], "case_id", REPLICATES_SHORT)
    return _round(out, ["domain", "n"], ["mean", "ci_low", "ci_high"])


def avg_rank(spark, sf):
    out = ordered.average_rank(features(spark, sf), ["domain"], "et_dice", ["case_id"])
    return out.select("domain", "case_id", "et_dice", "avg_rank")


MANY = 1 << 60  # rows that no plain window is meant for: the ranged way runs


def _some_unnamed(spark, sf):
    return features(spark, sf).withColumn("domain", F.nullif("domain", F.lit("MACHINERY")))


def avg_rank_ranged(spark, sf):
    out = ordered.average_rank(materialize(_some_unnamed(spark, sf), "features"), ["domain"], "et_dice", ["case_id"], rows=MANY)
    return out.select("domain", "case_id", "et_dice", "avg_rank")


def suffix_min_ranged(spark, sf):
    out = ordered.suffix_min(materialize(_some_unnamed(spark, sf), "features"), ["domain"], ["case_id"], "wt_volume", rows=MANY)
    return out.select("domain", "case_id", "suffix_min")


def quantiles_ranged(spark, sf):
    df = materialize(_some_unnamed(spark, sf), "features").withColumn(
        "et_dice", F.when(F.col("case_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("et_dice")))
    out = ordered.quantiles(df, ["domain"], "et_dice", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, ["case_id"], "n", rows=MANY)
    return _round(out, ["domain", "n"], ["q1", "q2", "q9"])


def lookup_salted(spark, sf):
    df = _some_unnamed(spark, sf)
    sizes = df.groupBy("domain").agg(F.count(F.lit(1)).alias("n_domain"))
    return lookup(df.select("case_id", "domain"), sizes, ["domain"], ["case_id"], limit=0)


def _digits(p: str) -> Column:
    return F.when(F.col(p) > 1e-290, F.round(F.log10(p), 6)).alias(f"log10_{p}")


def _tested(df: DataFrame, keys, columns, digits: int = 9, p=("p_value",)) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns], *map(_digits, p))


def pearson(spark, sf):
    return _tested(ranks.pearson(features(spark, sf), "wt_volume", "mean_dice", ["domain"]), ["domain", "n"], ["r"])


def spearman(spark, sf):
    out = ranks.spearman(features(spark, sf), list(FEATURES), list(OUTCOMES))
    return _tested(out, ["feature", "outcome", "n"], ["rho"])


def partial_spearman(spark, sf):
    out = ranks.partial_spearman(features(spark, sf), HYPOTHESES)
    return _tested(out, ["label", "feature", "outcome", "controls", "n"], ["partial_rho"])


def bootstrap_partial_rho(spark, sf):
    df = materialize(features(spark, sf), "features")
    out = ranks.bootstrap_partial_spearman(df, HYPOTHESES, ["fold"], replicates=REPLICATES_SHORT)
    return _round(out, ["label"], ["ci_low", "ci_high"])


KEYED_REPLICATES = 100


def bootstrap_partial_rho_keyed(spark, sf):
    """The way of tables beyond any task: vectors over replicates, ranked in pieces of the sorted values."""
    out = ranks.bootstrap_partial_spearman(materialize(features(spark, sf), "features"), HYPOTHESES, ["fold"], replicates=KEYED_REPLICATES, block_rows=0)
    return _round(out, ["label"], ["ci_low", "ci_high"])


def partial_rho_table(spark, sf):
    df = materialize(features(spark, sf), "features")
    out = ranks.partial_rho_table(df, HYPOTHESES, ["fold"], replicates=REPLICATES_SHORT)
    return _round(out, ["label", "feature", "outcome", "controls", "n"], ["partial_rho", "ci_low", "ci_high"])


def mann_whitney(spark, sf):
    out = ranks.mann_whitney(flagged(spark, sf), "failure_bottom10", list(FEATURES), "failure_eligible")
    return _tested(out, ["feature", "n_failure", "n_nonfailure"], ["u_statistic", "rank_biserial", "failure_median", "nonfailure_median"])


def failure_sensitivity(spark, sf):
    out = ranks.failure_sensitivity(flagged(spark, sf), list(FEATURES))
    p = ("p_value", "p_fdr_within_percentile")
    return _tested(out, ["percentile", "feature", "n_failure", "n_nonfailure"], ["u_statistic", "rank_biserial"], p=p)


def kruskal(spark, sf):
    return _tested(ranks.kruskal(features(spark, sf), "domain", list(OUTCOMES)), ["outcome", "n", "groups"], ["h_statistic"], 6)


def association_tables(spark, sf):
    """Everything with p values: Spearman, Mann-Whitney, sensitivity, partial Spearman, Kruskal-Wallis, adjusted."""
    df = materialize(flagged(spark, sf), "flagged")
    rho = ranks.spearman(df, list(FEATURES), list(OUTCOMES)).select(
        F.lit("spearman").alias("test"), F.concat_ws("/", "feature", "outcome").alias("name"), F.col("rho").alias("effect"), "p_value")
    mw = ranks.mann_whitney(df, "failure_bottom10", list(FEATURES), "failure_eligible").select(
        F.lit("mann_whitney").alias("test"), F.col("feature").alias("name"), F.col("rank_biserial").alias("effect"), "p_value")
    sens = ranks.failure_sensitivity(df, list(FEATURES)).select(
        F.concat(F.lit("sensitivity_"), "percentile").alias("test"), F.col("feature").alias("name"), F.col("rank_biserial").alias("effect"), "p_value")
    part = ranks.partial_spearman(df, HYPOTHESES).select(
        F.lit("partial").alias("test"), F.col("label").alias("name"), F.col("partial_rho").alias("effect"), "p_value")
    kw = ranks.kruskal(df, "domain", list(OUTCOMES)).select(
        F.lit("kruskal").alias("test"), F.col("outcome").alias("name"), F.col("h_statistic").alias("effect"), "p_value")
    every = rho.unionByName(mw).unionByName(sens).unionByName(part).unionByName(kw)
    out = ranks.bh_fdr(every, "p_value", ["test"], "name")
    return _tested(out, ["test", "name"], ["effect"], 6, p=("p_value", "p_fdr"))


def bh_fdr(spark, sf):
    out = ranks.bh_fdr(fixture(spark, sf, "pvalues"), "p_value", ["family"], "test_id")
    return out.select("family", "test_id", "p_value", F.round("p_fdr", 12).alias("p_fdr"))


def qcut_median(spark, sf):
    return binning.binned_median(materialize(features(spark, sf), "features"), "wt_volume", "wt_dice")


def quintile_rate(spark, sf):
    df = flagged(spark, sf).where("failure_eligible")
    return binning.binned_rate(df, "largest_fraction", "failure_bottom10")


def topk_abs(spark, sf):
    df = ranks.spearman(features(spark, sf), list(FEATURES), list(OUTCOMES), p_value=False)
    return sc.top_by_magnitude(df.withColumn("rho", F.round("rho", 9)), "rho", ["feature", "outcome"])


def sorted_output(spark, sf):
    return features(spark, sf).select("case_id", "domain", "mean_dice").orderBy("domain", "case_id")


COLUMNS = ["et_dice", "et_wt_ratio", "largest_fraction", "wt_volume"]


def impute_median(spark, sf):
    out = embed.impute_median(features(spark, sf), COLUMNS)
    return out.select("case_id", *COLUMNS)


def standardize(spark, sf):
    out = embed.standardize(features(spark, sf).withColumn("constant", F.lit(4.0)), ["wt_volume", "largest_fraction", "constant"])
    return _round(out, ["case_id"], ["wt_volume", "largest_fraction", "constant"], 8)


def _vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    return df.select(F.col("vec_id").alias("case_id"), *[F.get("embedding", k).cast("double").alias(f"e{k}") for k in range(64)])


def pca_variance(spark, sf):
    names = [f"e{k}" for k in range(64)]
    df = embed.standardize(embed.impute_median(_vectors(spark, sf), names), names)
    return embed.pca(df, names)[0]


def pca_scores(spark, sf):
    names = [f"e{k}" for k in range(64)]
    df = embed.standardize(embed.impute_median(_vectors(spark, sf), names), names)
    return embed.pca(df, names)[1]


QUERIES = {
    "scan_filter_regex": scan_filter_regex, "unpivot_scores": unpivot_scores, "norm_missing": norm_missing_q,
    "align_guard": align_guard, "paired_join": paired_join, "aggregate_scores": aggregate_scores,
    "bootstrap_paired": bootstrap_paired, "bootstrap_paired_chunks": bootstrap_paired_chunks, "bootstrap_independent": bootstrap_independent,
    "bootstrap_region_mean": bootstrap_region_mean, "paired_comparisons": paired_comparisons,
    "source_target_gap": source_target_gap, "scan_features": scan_features, "row_mean": row_mean_q,
    "log_volume": log_volume_q, "safe_ratios": safe_ratios, "volume_bias": volume_bias, "recode_default": recode_default, "recode_chain": recode_chain,
    "abs_flags": abs_flags, "quantile_flags": quantile_flags, "failure_counts": failure_counts,
    "domain_summary": domain_summary, "bootstrap_group": bootstrap_group, "avg_rank": avg_rank,
    "avg_rank_ranged": avg_rank_ranged, "suffix_min_ranged": suffix_min_ranged, "quantiles_ranged": quantiles_ranged,
    "lookup_salted": lookup_salted, "pearson": pearson,
    "spearman": spearman, "partial_spearman": partial_spearman, "bootstrap_partial_rho": bootstrap_partial_rho,
    "bootstrap_partial_rho_keyed": bootstrap_partial_rho_keyed,
    "partial_rho_table": partial_rho_table, "mann_whitney": mann_whitney, "failure_sensitivity": failure_sensitivity,
    "kruskal": kruskal, "association_tables": association_tables, "bh_fdr": bh_fdr, "qcut_median": qcut_median,
    "quintile_rate": quintile_rate, "topk_abs": topk_abs, "sorted_output": sorted_output, "impute_median": impute_median,
    "standardize": standardize, "pca_variance": pca_variance, "pca_scores": pca_scores,
}


# --- checking SQL -----------------------------------------------------------------------------------

S, X = fx("scores"), fx("features")
LONG = ("long", " union all ".join(f"select config, case_id, '{m}' as metric, {m} as value from scores" for m in METRICS))


def _pairs(contrasts: dict) -> tuple[str, str]:
    return ("pairs", " union all ".join(
        f"""select '{n}' as comparison, l.metric, l.case_id, l.value as l, r.value as r from long l
        join long r on r.config = '{b}' and r.metric = l.metric and r.case_id = l.case_id where l.config = '{a}'"""
        for n, (a, b) in contrasts.items()))


def _paired_sql(contrasts: dict, keys: list[str], drops: bool, size: int = resample.CHUNK) -> str:
    k = ", ".join(keys)
    using = f"using ({k})"
    extra = """, count(case when l is null and r is not null then 1 end) as n_dropped_left,
        count(case when r is null and l is not null then 1 end) as n_dropped_right""" if drops else ""
    return with_(S, LONG, _pairs(contrasts), ("diffs", "select *, l - r as d from pairs where l - r is not null"),
                 *bootstrap_ctes("diffs", keys, ["d"], "case_id", REPLICATES, size=size)) + f"""select * from (
        select {k}, count(l - r) as n, round(avg(l - r), 9) as mean_difference,
          round(quantile_cont(l - r, 0.5), 9) as median_difference{extra} from pairs group by {k}) a
        join (select {k}, {interval('mean_d')} from rep group by {k}) b {using}"""


def _gap_sql(region_name: str) -> str:
    """Independent bootstrap of c2 against c1 per metric; ``region_name`` is an expression over metric."""
    return f"""select {region_name}, tn as n_target, sn as n_source, round(tm, 9) as target_mean, round(sm, 9) as source_mean,
        round(tm - sm, 9) as mean_difference, ci_low, ci_high
      from (select metric, count(value) as tn, avg(value) as tm from long where config = 'c2' group by 1) t
      join (select metric, count(value) as sn, avg(value) as sm from long where config = 'c1' group by 1) s using (metric)
      join (select a.metric, {interval('a.mean_value - b.mean_value')} from t_rep a join s_rep b using (metric, b) group by 1) c using (metric)"""


INDEPENDENT = [
    S, LONG, ("t_rows", "select metric, case_id, value from long where config = 'c2' and value is not null"),
    ("s_rows", "select metric, case_id, value from long where config = 'c1' and value is not null"),
    *bootstrap_ctes("t_rows", ["metric"], ["value"], "case_id", REPLICATES, SEED, "t_"),
    *bootstrap_ctes("s_rows", ["metric"], ["value"], "case_id", REPLICATES, SALT2, "s_"),
]
JOINT = [
    ("c2", "select case_id, dsc_et, dsc_tc, dsc_wt from scores where config = 'c2'"),
    ("c1", "select case_id, dsc_et, dsc_tc, dsc_wt from scores where config = 'c1'"),
    *bootstrap_ctes("c2", [], list(METRICS), "case_id", REPLICATES, SEED, "jt_"),
    *bootstrap_ctes("c1", [], list(METRICS), "case_id", REPLICATES, SALT2, "js_"),
    ("jm", "select a.b, (a.mean_dsc_et + a.mean_dsc_tc + a.mean_dsc_wt) / 3 - (s.mean_dsc_et + s.mean_dsc_tc + s.mean_dsc_wt) / 3 as d "
           "from jt_rep a join js_rep s on s.b = a.b"),
]
REGION_MEAN = f"""select {{region}} tn as n_target, sn as n_source, round(tm, 9) as target_mean, round(sm, 9) as source_mean,
    round(tm - sm, 9) as mean_difference, ci_low, ci_high
  from (select count(*) as tn, (avg(dsc_et) + avg(dsc_tc) + avg(dsc_wt)) / 3 as tm from c2) t,
       (select count(*) as sn, (avg(dsc_et) + avg(dsc_tc) + avg(dsc_wt)) / 3 as sm from c1) s,
       (select {interval('d')} from jm) c"""

CUTS = ("cuts", "select quantile_cont(mean_dice, 0.05) as q5, quantile_cont(mean_dice, 0.10) as q10, quantile_cont(mean_dice, 0.20) as q20 from features")
FLAGGED = ("flagged", """select f.*, mean_dice is not null as failure_eligible, coalesce(mean_dice <= q5, false) as failure_bottom05,
    coalesce(mean_dice <= q10, false) as failure_bottom10, coalesce(mean_dice <= q20, false) as failure_bottom20 from features f, cuts""")


def _rank(over: str, value: str) -> str:
    return f"rank() over (partition by {over} order by {value}) + (count(*) over (partition by {over}, {value}) - 1) / 2.0e0"


SPEARMAN = [
    X, ("pairs", " union all ".join(
        f"select '{f}' as feature, '{o}' as outcome, case_id, cast({f} as double) as x, {o} as y from features where {f} is not null and {o} is not null"
        for f in FEATURES for o in OUTCOMES)),
    ("r", f"select feature, outcome, {_rank('feature, outcome', 'x')} as rx, {_rank('feature, outcome', 'y')} as ry from pairs"),
    ("rho", "select feature, outcome, count(*) as n, corr(rx, ry) as rho from r group by 1, 2"),
]


def _partial(a: str, b: str, given: list[str], source: str) -> str:
    """Partial correlation by the recursion, over columns c_<a>_<b>."""
    if not given:
        return f"c_{min(a, b)}_{max(a, b)}"
    z, rest = given[-1], given[:-1]
    ab, az, bz = (_partial(p, q, rest, source) for p, q in ((a, b), (a, z), (b, z)))
    return f"(({ab}) - ({az}) * ({bz})) / sqrt((1 - ({az}) * ({az})) * (1 - ({bz}) * ({bz})))"


def _partial_ctes(rows: str, replicate: bool) -> list[tuple[str, str]]:
    """prho(label, [b,] n, rho): per hypothesis ranks over complete rows, repeated rows included."""
    b = "b, " if replicate else ""
    out, unions = [], []
    for label, f, o, controls in HYPOTHESES:
        cols = [f, o, *controls]
        v = [f"v{k}" for k in range(len(cols))]
        part = f"partition by b {{}}" if replicate else "{}"
        ranks_sql = ", ".join(
            f"rank() over ({part.format(f'order by {c}')}) + (count(*) over (partition by {b}{c}) - 1) / 2.0e0 as {n}" for c, n in zip(cols, v)
        )
        complete = " and ".join(f"{c} is not null" for c in cols)
        out.append((f"h_{label}", f"select {b}{ranks_sql} from {rows} where {complete}"))
        corr = ", ".join(f"corr({p}, {q}) as c_{p}_{q}" for i, p in enumerate(v) for q in v[i + 1:])
        group = f"group by {b.rstrip(', ')}" if replicate else ""
        unions.append(f"select '{label}' as label, {b}n, {_partial('v0', 'v1', v[2:], '')} as rho from (select {b}count(*) as n, {corr} from h_{label} {group}) q")
    return [*out, ("prho", " union all ".join(unions))]


NAMED = ("named", "select * from (values " + ", ".join(f"('{h[0]}', '{h[1]}', '{h[2]}', '{','.join(h[3])}')" for h in HYPOTHESES) + ") t(label, feature, outcome, controls)")
def _resampled(replicates: int) -> list[tuple[str, str]]:
    drawn = drawn_ctes("features", ["fold"], "case_id", replicates, SEED, "f_")
    return [*drawn, ("sampled", "select d.b, o.* from f_drawn d join f_ord o on o.n = d.n and o.i = d.d")]


RESAMPLED = _resampled(REPLICATES_SHORT)


def _prefixed(ctes: list[tuple[str, str]], names: list[str], prefix: str) -> list[tuple[str, str]]:
    out = []
    for n, q in ctes:
        for name in sorted(names, key=len, reverse=True):
            q = q.replace(f"from {name} ", f"from {prefix}{name} ").replace(f"from {name})", f"from {prefix}{name})")
        out.append((prefix + n if n in names else n, q))
    return out


PARTIAL = _partial_ctes("features", False)
PARTIAL_B = _prefixed(_partial_ctes("sampled", True), [f"h_{h[0]}" for h in HYPOTHESES] + ["prho"], "s_")
GROUPS = ("grouped", " union all ".join(
    f"select '{f}' as feature, case_id, cast({f} as double) as v, failure_bottom05, failure_bottom10, failure_bottom20 from flagged where failure_eligible and {f} is not null"
    for f in FEATURES))


def _mwu(source: str, keys: str) -> str:
    """Mann-Whitney with p; needs the CTE grid."""
    return f"""select {keys}, n1 as n_failure, n2 as n_nonfailure, round(u, 9) as u_statistic,
        round(2 * u / (n1 * n2 * 1.0e0) - 1, 9) as rank_biserial, least(1.0e0, {normal_p('z')}) as p
      from (select *, greatest((greatest(u, n1 * n2 - u) - n1 * n2 / 2.0e0 - 0.5e0)
                / sqrt(n1 * n2 / 12.0e0 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1.0e0)))), 0) as z
        from (select *, r1 - n1 * (n1 + 1) / 2.0e0 as u
          from (select {keys}, count(case when hit then 1 end) as n1, count(case when not hit then 1 end) as n2,
                sum(case when hit then rk end) as r1, sum(t * t - 1.0e0) as tie
              from (select {keys}, hit, {_rank(keys, 'v')} as rk, count(*) over (partition by {keys}, v) as t from {source}) a group by {keys}) b) c) d"""


OUTLONG = ("outlong", " union all ".join(f"select '{o}' as outcome, domain, case_id, {o} as v from features where {o} is not null" for o in OUTCOMES))
DOM = ("dom", " union all ".join(
    f"select domain, '{o}' as o, case_id, {o} as v from flagged where {o} is not null" for o in OUTCOMES)
    + " union all select domain, 'failure_bottom10', case_id, case when failure_bottom10 then 1.0e0 else 0.0e0 end from flagged where failure_eligible")


UNNAMED = ("unnamed", "select * replace (nullif(domain, 'MACHINERY') as domain) from features")

ORACLES = {
    "scan_filter_regex": with_(fx("subjects")) + r"select * from subjects where regexp_full_match(subject_id, 'case-\d{6}-seg\.nii\.gz') order by subject_id",
    "unpivot_scores": with_(S, LONG) + "select * from long",
    "norm_missing": """select l_returnflag, count(*) as n_rows, count(v) as n, round(avg(v), 6) as mean, max(v) as top
        from (select l_returnflag, case when l_linenumber in (3, 5, 6) then null else l_extendedprice end as v from lineitem) t group by 1""",
    "align_guard": with_(S) + "select case_id, count(distinct config) as n_configs from scores group by 1 having count(distinct config) < 7",
    "paired_join": with_(S, LONG, _pairs(CONTRASTS)) + 'select comparison, metric, case_id, l as "left", r as "right" from pairs where l is not null and r is not null',
    "aggregate_scores": with_(S, LONG) + "select config, metric, count(value) as n, round(avg(value), 9) as mean, round(stddev_samp(value), 9) as sd from long group by 1, 2",
    "bootstrap_paired": _paired_sql({"x": ("c2", "c1")}, ["metric"], True),
    "bootstrap_paired_chunks": _paired_sql({"x": ("c2", "c1")}, ["metric"], True, SMALL_CHUNK),
    "bootstrap_independent": with_(*INDEPENDENT) + _gap_sql("metric"),
    "bootstrap_region_mean": with_(S, *JOINT) + REGION_MEAN.format(region=""),
    "paired_comparisons": _paired_sql(CONTRASTS, ["comparison", "metric"], False),
    "source_target_gap": with_(*INDEPENDENT, *JOINT) + _gap_sql("upper(right(metric, 2)) as region") + " union all " + REGION_MEAN.format(region="'MEAN' as region,"),
    "scan_features": with_(X) + "select * from features",
    "row_mean": with_(X) + "select case_id, (et_dice + tc_dice + wt_dice) / 3.0e0 as mean_dice from features",
    "log_volume": with_(X) + """select case_id, round(log10(1.0e0 + et_volume), 9) as log_et_volume,
        round(case when et_volume > 0 then log10(et_volume / 1000.0e0) end, 9) as log_et_volume_ml from features""",
    "safe_ratios": with_(X) + """select case_id, tc_volume * 1.0e0 / nullif(wt_volume, 0) as tc_wt_ratio,
        et_volume * 1.0e0 / nullif(wt_volume, 0) as et_wt_ratio, et_volume * 1.0e0 / nullif(tc_volume, 0) as et_tc_ratio from features""",
    "volume_bias": with_(X) + "select case_id, " + ", ".join(
        f"(pred_{r}_volume - {r}_volume) * 1.0e0 / nullif({r}_volume, 0) as {r}_volume_bias" for r in ("et", "tc", "wt")) + " from features",
    "recode_default": with_(X) + "select case_id, case domain " + " ".join(f"when '{k}' then '{v}'" for k, v in DOMAIN_CODES.items())
        + " else 'Unknown domain' end as header_domain from features",
    "recode_chain": """with k as (select o_custkey as case_id, case arg_max(o_orderpriority, o_orderkey) when '1-URGENT' then 'GLI' when '2-HIGH' then 'SSA'
          when '3-MEDIUM' then 'MEN' when '5-LOW' then 'OTHER' end as code from orders group by 1)
        select c_custkey as case_id, coalesce(code, 'UNKNOWN') as group_code, case code """
        + " ".join(f"when '{k}' then '{v}'" for k, v in DOMAIN_NAMES.items()) + """ else 'Unknown domain' end as header_domain
        from customer left join k on case_id = c_custkey""",
    "abs_flags": with_(X) + "select case_id, coalesce(et_dice < 0.5e0, false) as et_failure, coalesce(wt_dice < 0.8e0, false) as wt_failure from features",
    "quantile_flags": with_(X, CUTS, FLAGGED) + f"select case_id, {', '.join(FLAGS)} from flagged",
    "failure_counts": with_(X, CUTS, FLAGGED) + """select count(case when failure_bottom10 then 1 end) as bottom10,
        count(case when failure_eligible then 1 end) as complete, count(case when et_dice < 0.5e0 then 1 end) as et_failures,
        count(et_dice) as et_evaluable, count(case when wt_dice < 0.8e0 then 1 end) as wt_failures, count(*) as cases from flagged""",
    "domain_summary": with_(X, CUTS, FLAGGED, DOM, *bootstrap_ctes("dom", ["domain", "o"], ["v"], "case_id", REPLICATES_SHORT),
        ("ci", f"select domain, o, {interval('mean_v')} from rep group by 1, 2"),
        ("pt", "select domain, o, count(*) as n, round(avg(v), 9) as m from dom group by 1, 2"))
        + "select f.domain, f.n, " + ", ".join(
            f"max(case when o = '{o}' then p.n end) as {o}_n, max(case when o = '{o}' then m end) as {o}_mean, "
            f"max(case when o = '{o}' then ci_low end) as {o}_ci_low, max(case when o = '{o}' then ci_high end) as {o}_ci_high" for o in SUMMARY_OUTCOMES)
        + " from (select domain, count(*) as n from features group by 1) f left join pt p using (domain) left join ci using (domain, o) group by 1, 2",
    "bootstrap_group": with_(X, ("v", "select domain, case_id, et_dice from features where et_dice is not null"),
        *bootstrap_ctes("v", ["domain"], ["et_dice"], "case_id", REPLICATES_SHORT))
        + f"""select * from (select domain, count(et_dice) as n, round(avg(et_dice), 9) as mean from features group by 1) a
        join (select domain, {interval('mean_et_dice')} from rep group by 1) b using (domain)""",
    "avg_rank": with_(X) + f"select domain, case_id, et_dice, {_rank('domain', 'et_dice')} as avg_rank from features where et_dice is not null",
    "avg_rank_ranged": with_(X, UNNAMED) + f"select domain, case_id, et_dice, {_rank('domain', 'et_dice')} as avg_rank from unnamed where et_dice is not null",
    "suffix_min_ranged": with_(X, UNNAMED) + """select domain, case_id, min(wt_volume) over (partition by domain order by case_id desc) as suffix_min from unnamed""",
    "quantiles_ranged": with_(X, UNNAMED) + """select domain, count(et_dice) as n, round(quantile_cont(et_dice, 0.25), 9) as q1, round(quantile_cont(et_dice, 0.5), 9) as q2,
        round(quantile_cont(et_dice, 0.9), 9) as q9 from unnamed where case_id % 7 <> 0 and et_dice is not null group by 1""",
    "lookup_salted": with_(X, UNNAMED) + "select case_id, domain, count(*) over (partition by domain) as n_domain from unnamed",
    "pearson": with_(X, GRID, ("c", """select domain, count(*) as n, corr(wt_volume, mean_dice) as r from features
        where wt_volume is not null and mean_dice is not null group by 1"""), ("t", f"select *, {correlation_p('r', 'n - 2')} as p from c"))
        + f"select domain, n, round(r, 9) as r, {digits('p')} as log10_p_value from t",
    "spearman": with_(*SPEARMAN, GRID, ("t", f"select *, {correlation_p('rho', 'n - 2')} as p from rho"))
        + f"select feature, outcome, n, round(rho, 9) as rho, {digits('p')} as log10_p_value from t",
    "partial_spearman": with_(X, NAMED, *PARTIAL, GRID, ("t", f"select *, {correlation_p('rho', 'n - 2')} as p from prho"))
        + f"select label, feature, outcome, controls, n, round(rho, 9) as partial_rho, {digits('p')} as log10_p_value from t join named using (label)",
    "bootstrap_partial_rho": with_(X, *RESAMPLED, *PARTIAL_B) + f"select label, {interval('rho')} from s_prho group by 1",
    "bootstrap_partial_rho_keyed": with_(X, *_resampled(KEYED_REPLICATES), *PARTIAL_B) + f"select label, {interval('rho')} from s_prho group by 1",
    "partial_rho_table": with_(X, NAMED, *PARTIAL, *RESAMPLED, *PARTIAL_B) + f"""select label, feature, outcome, controls, n, round(rho, 9) as partial_rho,
        ci_low, ci_high from prho join named using (label) left join (select label, {interval('rho')} from s_prho group by 1) c using (label)""",
    "mann_whitney": with_(X, CUTS, FLAGGED, GROUPS, GRID, ("rows1", "select feature, v, failure_bottom10 as hit from grouped"))
        + f"""select m.* exclude (p), {digits('p')} as log10_p_value, failure_median, nonfailure_median from ({_mwu('rows1', 'feature')}) m
        left join (select feature, round(quantile_cont(case when hit then v end, 0.5), 9) as failure_median,
          round(quantile_cont(case when not hit then v end, 0.5), 9) as nonfailure_median from rows1 group by 1) q using (feature)""",
    "failure_sensitivity": with_(X, CUTS, FLAGGED, GROUPS, GRID, ("rows3", " union all ".join(
        f"select {p} as percentile, feature, v, failure_bottom{p:02d} as hit from grouped" for p in FAILURE_PERCENTILES)),
        ("m", _mwu("rows3", "percentile, feature")), ("k", """select *, row_number() over (partition by percentile order by p, feature) as rk,
        count(*) over (partition by percentile) as c from m"""), ("a", """select *, least(1.0e0, min(p * c / rk) over (partition by percentile
        order by p desc, feature desc rows unbounded preceding)) as q from k"""))
        + f"""select percentile, feature, n_failure, n_nonfailure, u_statistic, rank_biserial, {digits('p')} as log10_p_value,
        {digits('q')} as log10_p_fdr_within_percentile from a""",
    "kruskal": with_(X, OUTLONG, ("r", f"select outcome, domain, {_rank('outcome', 'v')} as rk, count(*) over (partition by outcome, v) as t from outlong"),
        ("g", "select outcome, domain, count(*) as n, sum(rk) as s, sum(t * t - 1) as tie from r group by 1, 2"))
        + f"""select outcome, n, groups, round(h, 6) as h_statistic, {digits('exp(-h / 2) * (1 + h / 2)')} as log10_p_value from (
        select outcome, cast(n as bigint) as n, groups, ((12.0e0 / (n * (n + 1.0e0)) * q - 3 * (n + 1)) / (1 - tie / (n * 1.0e0 * n * n - n))) as h
        from (select outcome, sum(n) as n, count(*) as groups, sum(s * s / n) as q, sum(tie) as tie from g group by 1) a) b""",
    "association_tables": with_(*SPEARMAN, NAMED, *PARTIAL, CUTS, FLAGGED, GROUPS, OUTLONG, GRID,
        ("rows1", "select feature, v, failure_bottom10 as hit from grouped"),
        ("rows3", " union all ".join(f"select {p} as percentile, feature, v, failure_bottom{p:02d} as hit from grouped" for p in FAILURE_PERCENTILES)),
        ("kr", f"select outcome, domain, {_rank('outcome', 'v')} as rk, count(*) over (partition by outcome, v) as t from outlong"),
        ("kg", "select outcome, domain, count(*) as n, sum(rk) as s, sum(t * t - 1) as tie from kr group by 1, 2"),
        ("kh", """select outcome, ((12.0e0 / (n * (n + 1.0e0)) * q - 3 * (n + 1)) / (1 - tie / (n * 1.0e0 * n * n - n))) as h
          from (select outcome, sum(n) as n, count(*) as groups, sum(s * s / n) as q, sum(tie) as tie from kg group by 1) a"""),
        ("tests", f"""select 'spearman' as test, concat(feature, '/', outcome) as name, rho as effect, {correlation_p('rho', 'n - 2')} as p from rho
          union all select 'mann_whitney', feature, rank_biserial, p from ({_mwu('rows1', 'feature')}) m
          union all select concat('sensitivity_', percentile), feature, rank_biserial, p from ({_mwu('rows3', 'percentile, feature')}) m
          union all select 'partial', label, rho, {correlation_p('rho', 'n - 2')} from prho
          union all select 'kruskal', outcome, h, exp(-h / 2) * (1 + h / 2) from kh"""),
        ("k", """select *, row_number() over (partition by test order by p, name) as rk, count(*) over (partition by test) as c from tests"""),
        ("a", """select *, least(1.0e0, min(p * c / rk) over (partition by test order by p desc, name desc rows unbounded preceding)) as q from k"""))
        + f"select test, name, round(effect, 6) as effect, {digits('p')} as log10_p_value, {digits('q')} as log10_p_fdr from a",
    "bh_fdr": with_(fx("pvalues"), ("k", """select *, row_number() over (partition by family order by p_value, test_id) as rk,
        count(*) over (partition by family) as m from pvalues where p_value is not null""")) + """select family, test_id, p_value,
        round(least(1.0e0, min(p_value * m / rk) over (partition by family order by p_value desc, test_id desc rows unbounded preceding)), 12) as p_fdr from k
        union all select family, test_id, p_value, null from pvalues where p_value is null""",
    "qcut_median": with_(X, ("e", "select quantile_cont(cast(wt_volume as double), [" + ", ".join(repr(k / 12) for k in range(13)) + "]) as e from features"),
        ("inner_edges", "select distinct unnest(e) as x from e"), ("lo", "select min(x) as lo, max(x) as hi from inner_edges"),
        ("b", """select f.case_id, f.wt_volume, f.wt_dice, cast((select count(*) from inner_edges i, lo where i.x > lo.lo and i.x < lo.hi and i.x < f.wt_volume) as int) as bin
        from features f where wt_volume is not null"""))
        + "select bin, count(wt_volume) as n, quantile_cont(cast(wt_volume as double), 0.5) as median_x, quantile_cont(wt_dice, 0.5) as median_y from b group by 1",
    "quintile_rate": with_(X, CUTS, FLAGGED, ("ok", "select * from flagged where failure_eligible and largest_fraction is not null"),
        ("e", "select unnest(quantile_cont(largest_fraction, [0.2, 0.4, 0.6, 0.8])) as x from ok"),
        ("b", "select o.*, cast((select count(*) from e where e.x < o.largest_fraction) as int) as bin from ok o"))
        + "select bin, avg(case when failure_bottom10 then 1.0e0 else 0.0e0 end) as rate, count(*) as count from b group by 1",
    "topk_abs": with_(*SPEARMAN) + "select feature, outcome, n, round(rho, 9) as rho from rho order by abs(round(rho, 9)) desc nulls last, feature, outcome limit 12",
    "sorted_output": with_(X) + "select case_id, domain, mean_dice from features order by domain, case_id",
    "impute_median": with_(X) + "select case_id, " + ", ".join(
        f"coalesce(cast({c} as double), (select quantile_cont(cast({c} as double), 0.5) from features)) as {c}" for c in COLUMNS) + " from features",
    "standardize": with_(X) + """select case_id, round((wt_volume - a) / s, 8) as wt_volume, round((largest_fraction - b) / t, 8) as largest_fraction,
        0.0e0 as constant from features, (select avg(wt_volume) as a, stddev_pop(wt_volume) as s, avg(largest_fraction) as b, stddev_pop(largest_fraction) as t from features) q""",
}
