"""URL filter: rules first, then the ratio of two character language models.

Rules name a host (with its subdomains) and the beginning of a path; the longest fitting rule decides. URLs that
rules accept and URLs that they reject train one smoothed variable-order Markov model each; a URL
without a rule is judged by the difference of its two log-likelihoods, divided by its length, against a
threshold calibrated on a fifth of the decided URLs that the models have not seen.

*Models.* The context of a character is up to ``ORDER`` characters before it; a context seen fewer than
``SEEN`` times falls back to the next shorter one, others are interpolated with it (Witten-Bell). Counts
are made once for runs of ORDER + 1 characters; shorter runs are sums of those. The followers of a context
are at most the alphabet, so no window group grows with the data. A URL counts once however often it occurs.

Defined cases: a null URL, or one without '://', has an empty host and path and is judged by its end
alone; without decided URLs every score is 0 and the verdict allow; a score at the threshold is
allowed; repeated rows have the same verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lesionlens.llm.columns import held_out
from lesionlens.session import materialize

ORDER = 4
SEEN = 3
START, END = "\u0002", "\u0003"
STEP = 0.01  # of the calibration's score bins, which reach from -10 to 10

RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)  # the policy of the registered query: fixed values

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def _runs(sites: DataFrame, order: int) -> DataFrame:
    """(site, accepted, rejected, run): each character of a site with the ``order`` before it."""
    padded = F.concat(F.lit(START * order), F.col("site"), F.lit(END))
    starts = F.sequence(F.lit(1), F.length("site") + 1)
    return sites.select("site", "accepted", "rejected", F.explode(F.transform(starts, lambda i: F.substring(padded, i, order + 1))).alias("run"))


def ratio_model(runs: DataFrame, order: int = ORDER, seen: int = SEEN) -> DataFrame:
    """(run, ratio): log of accepted over rejected probability of every run's last character."""
    counts = materialize(runs.groupBy("run").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "runs")
    below = None
    for size in range(order + 1):
        suffix = F.substring("run", order + 1 - size, size + 1)
        level = counts.groupBy(suffix.alias("run")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        level = level.withColumn("context", F.substring("run", 1, size))
        group = Window.partitionBy("context")
        for c in ("accepted", "rejected"):
            level = level.withColumn(f"{c}_all", F.sum(c).over(group)).withColumn(f"{c}_kinds", F.sum((F.col(c) > 0).cast("bigint")).over(group))
        if below is None:
            level = level.withColumn("p_accepted", F.lit(1 / 256)).withColumn("p_rejected", F.lit(1 / 256))
        else:
            shorter = below.withColumnRenamed("run", "shorter")
            level = level.withColumn("shorter", F.substring("run", 2, size)).join(shorter.hint("merge"), "shorter")
        mixed = {
            f"p_{c}": F.when(F.col(f"{c}_all") >= (seen if size else 1), (F.col(c) + F.col(f"{c}_kinds") * F.col(f"p_{c}")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds")))
            .otherwise(F.col(f"p_{c}")) for c in ("accepted", "rejected")
        }
        below = level.select("run", *[v.alias(k) for k, v in mixed.items()])
    return below.select("run", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """(threshold): the bin edge that parts held-out accepted from rejected sites best, the one nearest 0 of equals.

    ``scored`` has score and verdict; at most 2,001 bins are sorted.
    """
    bins = scored.groupBy(F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) / STEP).cast("int").alias("bin")).agg(
        F.sum((F.col("verdict") == "allow").cast("double")).alias("a"), F.sum((F.col("verdict") == "block").cast("double")).alias("b")
    )
    total = Window.partitionBy()
    lower = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.lit(1.0) - F.coalesce(F.sum("a").over(lower), F.lit(0.0)) / F.greatest(F.sum("a").over(total), F.lit(1.0))
    caught = F.coalesce(F.sum("b").over(lower), F.lit(0.0)) / F.greatest(F.sum("b").over(total), F.lit(1.0))
    edges = bins.select("bin", F.round(kept + caught, 9).alias("good"))
    best = F.max(F.struct("good", (-F.abs("bin")).alias("near"), "bin"))["bin"]
    return edges.agg(F.coalesce((best - F.lit(0.5)) * F.lit(STEP), F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, order: int = ORDER, seen: int = SEEN) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; ``score`` is the ratio per character."""
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), F.concat("host", "path").alias("site")), "urls")
    sites = rows.groupBy("site").agg(F.first("decided").alias("decided"))
    learn = ~F.coalesce(held_out("site"), F.lit(False))
    sites = materialize(sites.select(
        "site", "decided", learn.alias("learn"), ((F.col("decided") == "allow") & learn).cast("bigint").alias("accepted"),
        ((F.col("decided") == "block") & learn).cast("bigint").alias("rejected"),
    ).fillna(0, ["accepted", "rejected"]), "sites")
    runs = _runs(sites, order)
    model = materialize(ratio_model(runs, order, seen), "ratios")
    scores = runs.select("site", "run").join(model.hint("merge"), "run").groupBy("site").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    scores = materialize(scores, "scores")
    unseen = sites.where("decided is not null and not learn").select("site", F.col("decided").alias("verdict"))
    line = threshold(unseen.join(scores.hint("merge"), "site")).scalar()
    verdict = F.coalesce("decided", F.when(F.col("score") >= line, "allow").otherwise("block"))
    return rows.join(scores.hint("merge"), "site").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
