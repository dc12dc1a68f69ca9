"""Drift between a reference and a current table, decay over time, and the alerts that follow from both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.tables import written

from .balance import auc

FLOOR = 1e-6
# Bounds of the population stability index and of other measures for a warning and an alert.
PSI_WARN, PSI_ALERT = 0.10, 0.25
MISSING_WARN = 0.05
DECAY_WARN, DECAY_CRITICAL = 0.05, 0.10


def _long(df: DataFrame, features: Sequence[str], kind: str, side: str) -> DataFrame:
    return df.select(F.lit(side).alias("side"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("x")) for c in features])))


def _both(reference: DataFrame, current: DataFrame, features: Sequence[str], kind: str) -> DataFrame:
    return _long(reference, features, kind, "r").unionByName(_long(current, features, kind, "c"))


def _shares(cells: DataFrame) -> DataFrame:
    """(feature, bin, p, q) of counts (feature, side, bin, n): shares in the reference and now, 0 where a bin is empty on a side."""
    w = Window.partitionBy("feature", "side")
    s = cells.withColumn("share", F.col("n") / F.sum("n").over(w))
    return s.groupBy("feature", "bin").agg(F.coalesce(F.max(F.when(F.col("side") == "r", F.col("share"))), F.lit(0.0)).alias("p"), F.coalesce(F.max(F.when(F.col("side") == "c", F.col("share"))), F.lit(0.0)).alias("q"))


def _psi_of(shares: DataFrame) -> DataFrame:
    p, q = F.greatest("p", F.lit(FLOOR)), F.greatest("q", F.lit(FLOOR))
    return shares.groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, psi) of numbers: bins between the reference's distinct inner quantiles, one job for all features."""
    both = _both(reference, current, features, "double").where("x IS NOT NULL AND NOT isnan(x)")
    q = F.percentile("x", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    edges = both.where("side = 'r'").groupBy("feature").agg(F.array_sort(F.array_distinct(q)).alias("edges"))
    placed = both.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))  # a row per feature
    cells = placed.groupBy("feature", "side", "bin").agg(F.count("*").alias("n"))
    # bins that neither side fills add nothing
    return _psi_of(_shares(cells))


def psi_categories(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, psi) of categories by the shares of their trimmed values."""
    both = _both(reference, current, features, "string").where("x IS NOT NULL")
    return _psi_of(_shares(both.groupBy("feature", "side", F.trim("x").alias("bin")).agg(F.count("*").alias("n"))))


def js_divergence(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 20) -> DataFrame:
    """(feature, js): base-2 divergence over equal-width bins of the pooled range, within [0, 1]."""
    both = _both(reference, current, features, "double").where("x IS NOT NULL AND NOT isnan(x)")
    span = both.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    cells = both.join(F.broadcast(span), "feature").groupBy("feature", "side", b.alias("bin")).agg(F.count("*").alias("n"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda s: F.when(F.col(s) > 0, F.col(s) * F.log2(F.col(s) / m)).otherwise(0.0)
    return _shares(cells).groupBy("feature").agg(F.greatest(F.least(F.sum(part("p") + part("q")) / 2, F.lit(1.0)), F.lit(0.0)).alias("js"))


def ks_statistic(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, n_ref, n_cur, ks): the largest gap between both distribution functions, from counts of distinct values."""
    both = _both(reference, current, features, "double").where("x IS NOT NULL AND NOT isnan(x)")
    cells = written(both.groupBy("feature", "x").agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c")))
    totals = cells.groupBy("feature").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    upto = running(cells, F.col("x"), [], {"upto_r": F.col("r"), "upto_c": F.col("c")}, by=["feature"])
    gaps = upto.join(F.broadcast(totals), "feature")  # a row per feature
    return gaps.groupBy("feature", "n_ref", "n_cur").agg(F.max(F.abs(F.col("upto_r") / F.col("n_ref") - F.col("upto_c") / F.col("n_cur"))).alias("ks"))


def chi2_categories(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, dof, chi2, cramers_v) of the 2 x k table of categories; 0 with fewer than two levels."""
    both = _both(reference, current, features, "string").where("x IS NOT NULL")
    cells = both.groupBy("feature", F.trim("x").alias("bin")).agg(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c"))
    w = Window.partitionBy("feature")
    n_r, n_c = F.sum("r").over(w), F.sum("c").over(w)
    n, k = n_r + n_c, F.col("r") + F.col("c")
    er, ec = k * n_r / n, k * n_c / n
    terms = cells.select("feature", n.alias("n"), (F.pow(F.col("r") - er, 2) / F.nullif(er, F.lit(0.0)) + F.pow(F.col("c") - ec, 2) / F.nullif(ec, F.lit(0.0))).alias("t"))
    return terms.groupBy("feature").agg((F.count("*") - 1).alias("dof"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("chi2"), F.coalesce(F.sqrt(F.sum("t") / F.max("n")), F.lit(0.0)).alias("cramers_v"))


def missing_rates(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, missing_delta): the share of missing values now less that in the reference."""
    both = _both(reference, current, features, "string")
    rate = lambda s: F.avg(F.when(F.col("side") == s, F.col("x").isNull().cast("double")))
    return both.groupBy("feature").agg((rate("c") - rate("r")).alias("missing_delta"))


def drift_report(reference: DataFrame, current: DataFrame, numbers: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(feature, kind, psi, ks, js, chi2, cramers_v, missing_delta, severity): the worst first."""
    num = psi(reference, current, numbers).join(ks_statistic(reference, current, numbers), "feature").join(js_divergence(reference, current, numbers), "feature")
    num = num.select("feature", F.lit("number").alias("kind"), "psi", "ks", "js", F.lit(None).cast("double").alias("chi2"), F.lit(None).cast("double").alias("cramers_v"))
    cat = psi_categories(reference, current, categories).join(chi2_categories(reference, current, categories), "feature")
    cat = cat.select("feature", F.lit("category").alias("kind"), "psi", F.lit(None).cast("double").alias("ks"), F.lit(None).cast("double").alias("js"), "chi2", "cramers_v")
    out = num.unionByName(cat).join(missing_rates(reference, current, [*numbers, *categories]), "feature")
    severity = F.when(F.col("psi") >= PSI_ALERT, "alert").when((F.col("psi") >= PSI_WARN) | (F.col("missing_delta") > MISSING_WARN), "warn").otherwise("ok")
    return out.withColumn("severity", severity).orderBy(F.desc("psi"), "feature")


def performance_decay(df: DataFrame, period: str, score: str, outcome: str, binary: bool = True, least: int = 30, threshold: float = 0.1) -> DataFrame:
    """(period, n, mean_score, mean_outcome, auc, corr, slope, skill, rel_drop, first_decay) per period.

    skill is AUC - 1/2 for binary outcomes, else the absolute correlation; drops are against the first period with
    ``least`` rows and a skill. first_decay marks the first period that drops more than ``threshold``.
    """
    agg = df.groupBy(period).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(outcome).alias("mean_outcome"), F.corr(score, outcome).alias("corr"),
        *([] if binary else [F.regr_slope(F.col(outcome).cast("double"), F.col(score).cast("double")).alias("slope")]),
    )
    if binary:
        agg = agg.join(calibration_slope(df, score, outcome, period), period)
    agg = agg.join(auc(df, score, outcome, [period]).select(period, "auc"), period) if binary else agg.withColumn("auc", F.lit(None).cast("double"))
    skill = F.when(F.col("n") >= least, F.col("auc") - 0.5 if binary else F.abs("corr"))
    w = Window.orderBy(period)  # a row per period
    rows = agg.withColumn("skill", skill)
    base = F.first("skill", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("rel_drop", F.when(base > 0, (base - F.col("skill")) / base))
    down = (F.col("rel_drop") > threshold).cast("int")
    return rows.withColumn("first_decay", F.coalesce((down == 1) & (F.sum(down).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1), F.lit(False)))


def calibration_slope(df: DataFrame, score: str, outcome: str, period: str, rounds: int = 8) -> DataFrame:
    """(period, slope): the slope of a logistic regression of a binary outcome on the score, scaled by the score's mean and deviation.

    A value of 1 per deviation of the score means odds that rise by the factor e. A round of Newton's method is one
    aggregate for all periods; null where a period has one outcome only or no spread.
    """
    scale = df.groupBy(period).agg(F.avg(score).alias("__m"), F.stddev_pop(score).alias("__s"), F.avg(F.col(outcome).cast("double")).alias("__o"))
    scale = scale.where("__s > 0 AND __o > 0 AND __o < 1")
    rows = df.select(period, F.col(score).cast("double").alias("__x"), F.col(outcome).cast("double").alias("__y"))
    fit = {r[period]: (0.0, 0.0) for r in scale.select(period).collect()}  # a row per period
    for _ in range(rounds):
        if not fit:
            break
        now = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in fit.items()], f"{period} {dict(df.dtypes)[period]}, __a double, __b double")
        z = (F.col("__x") - F.col("__m")) / F.col("__s")
        p = 1 / (1 + F.exp(-(F.col("__a") + F.col("__b") * F.col("z"))))
        v, g = F.col("p") * (1 - F.col("p")), F.col("__y") - F.col("p")
        sums = rows.join(F.broadcast(scale.join(now, period)), period).withColumn("z", z).withColumn("p", p).groupBy(period).agg(
            F.sum(g).alias("g0"), F.sum(g * F.col("z")).alias("g1"), F.sum(v).alias("h0"), F.sum(v * F.col("z")).alias("h1"), F.sum(v * F.col("z") * F.col("z")).alias("h2"))
        for r in sums.collect():
            det = r.h0 * r.h2 - r.h1 * r.h1
            a, b = fit[r[period]]
            fit[r[period]] = (a + (r.h2 * r.g0 - r.h1 * r.g1) / det, b + (r.h0 * r.g1 - r.h1 * r.g0) / det) if det > 1e-12 else (a, b)
    found = df.sparkSession.createDataFrame([(k, b) for k, (_, b) in fit.items()], f"{period} {dict(df.dtypes)[period]}, slope double")
    return df.select(period).distinct().join(F.broadcast(found), period, "left")


def prediction_drift(reference: DataFrame, current: DataFrame, score: str) -> DataFrame:
    """(psi, ks, js, mean_ref, mean_cur, sd_ratio, p90_shift, severity) of one prediction between two tables."""
    one = psi(reference, current, [score]).join(ks_statistic(reference, current, [score]), "feature").join(js_divergence(reference, current, [score]), "feature")
    side = lambda df, s: df.agg(F.avg(score).alias(f"mean_{s}"), F.stddev_samp(score).alias(f"sd_{s}"), F.percentile(score, 0.9).alias(f"p90_{s}"))
    both = one.crossJoin(side(reference, "ref")).crossJoin(side(current, "cur"))
    severity = F.when(F.col("psi") >= PSI_ALERT, "alert").when(F.col("psi") >= PSI_WARN, "warn").otherwise("ok")
    return both.select("psi", "ks", "js", "mean_ref", "mean_cur", (F.col("sd_cur") / F.nullif(F.col("sd_ref"), F.lit(0.0))).alias("sd_ratio"), (F.col("p90_cur") - F.col("p90_ref")).alias("p90_shift"), severity.alias("severity"))


def p_values(ks: DataFrame, chi2: DataFrame) -> DataFrame:
    """(feature, test, statistic, p_value) of KS distances (feature, n_ref, n_cur, ks) and chi-square sums (feature, dof, chi2): a row per feature."""
    from ..functions.numerics import chi2_sf, kolmogorov_sf

    rows = [(r.feature, "ks", float(r.ks), kolmogorov_sf(r.ks, r.n_ref, r.n_cur)) for r in ks.collect()]
    rows += [(r.feature, "chi2", float(r.chi2), chi2_sf(r.chi2, r.dof) if r.dof > 0 else 1.0) for r in chi2.collect()]
    return ks.sparkSession.createDataFrame(rows, "feature string, test string, statistic double, p_value double")


def alert_summary(found: DataFrame) -> DataFrame:
    """(severity, n, blocks): alerts per severity, critical first; critical ones block a deployment."""
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("blocks", F.col("severity") == "critical").orderBy(F.expr("array_position(array('critical', 'warn', 'info'), severity)"))


def effect_stability(df: DataFrame, ref: str, cur: str, key: str, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """((n, spearman, pearson, sign_flips, top_retention), (ref_bin, cur_bin, n)) of two predictions for the same units.

    Bins hold equal counts: rank i from 0 of n is in bin floor(i * bins / n). Rank correlation uses mean ranks of ties.
    Units that lack either prediction take no part. Each side is one sort by ranges, which gives place and mean rank.
    """
    rows = written(df.select(key, F.col(ref).cast("double").alias("r"), F.col(cur).cast("double").alias("c")).where("r IS NOT NULL AND c IS NOT NULL"))
    n = rows.count()
    for x, to in (("r", "ref_bin"), ("c", "cur_bin")):
        rows = running(rows, F.col(x), [F.col(key)], number=f"rn_{x}", mean_rank=f"rank_{x}").withColumn(to, F.floor((F.col(f"rn_{x}") - 1) * bins / n).cast("int"))
        rows = written(rows)
    both = (F.col("r") != 0) & (F.col("c") != 0)
    top = F.col("ref_bin") == bins - 1
    summary = rows.agg(
        F.count("*").alias("n"), F.corr("rank_r", "rank_c").alias("spearman"), F.corr("r", "c").alias("pearson"),
        F.avg(F.when(both, (F.signum("r") != F.signum("c")).cast("double"))).alias("sign_flips"), F.avg(F.when(top, (F.col("cur_bin") == bins - 1).cast("double"))).alias("top_retention"),
    )
    return summary, rows.groupBy("ref_bin", "cur_bin").agg(F.count("*").alias("n"))


ALERT = "source string, subject string, rule string, severity string, value double, bound double"


def alerts(drift: DataFrame | None = None, decay: DataFrame | None = None, stability: DataFrame | None = None, policy: DataFrame | None = None, period: str = "period") -> DataFrame:
    """(source, subject, rule, severity, value, bound) of all rules that fire: critical, warn or info."""
    rows: list[DataFrame] = []

    def rule(df: DataFrame, source: str, subject: Column, name: str, value: Column, levels: Sequence[tuple[str, Column, float]]) -> None:
        severity, bound = F.lit(None).cast("string"), F.lit(None).cast("double")
        for level, when, limit in reversed(levels):
            severity, bound = F.when(when, level).otherwise(severity), F.when(when, limit).otherwise(bound)
        rows.append(df.select(F.lit(source).alias("source"), subject.cast("string").alias("subject"), F.lit(name).alias("rule"), severity.alias("severity"), value.cast("double").alias("value"), bound.alias("bound")).where("severity IS NOT NULL"))

    if drift is not None:
        v = F.col("psi")
        rule(drift, "drift", F.col("feature"), "psi", v, [("critical", v >= PSI_ALERT, PSI_ALERT), ("warn", v >= PSI_WARN, PSI_WARN)])
        m = F.col("missing_delta")
        rule(drift, "drift", F.col("feature"), "missing", m, [("critical", m >= 0.20, 0.20), ("warn", m >= 0.10, 0.10)])
    if decay is not None:
        ends = decay.agg(F.min_by("auc", period).alias("a"), F.max_by("auc", period).alias("b"))
        d = F.col("a") - F.col("b")
        rule(ends, "decay", F.lit("auc"), "auc_drop", d, [("critical", d >= DECAY_CRITICAL, DECAY_CRITICAL), ("warn", d >= DECAY_WARN, DECAY_WARN)])
    if stability is not None:
        s, f = F.col("spearman"), F.col("sign_flips")
        rule(stability, "stability", F.lit("rank"), "rank_correlation", s, [("critical", s < 0.35, 0.35), ("warn", s < 0.70, 0.70)])
        rule(stability, "stability", F.lit("sign"), "sign_flips", f, [("critical", f >= 0.30, 0.30), ("warn", f >= 0.15, 0.15)])
    if policy is not None:
        lo, gap, roi, use = (F.col(c) for c in ("ci_low", "gap", "roi", "utilisation"))
        rule(policy, "policy", F.lit("value"), "ci_low", lo, [("critical", lo <= 0, 0.0)])
        rule(policy, "policy", F.lit("baseline"), "gap", gap, [("critical", gap <= 0, 0.0)])
        rule(policy, "policy", F.lit("roi"), "roi", roi, [("warn", roi < 0, 0.0)])
        rule(policy, "policy", F.lit("budget"), "utilisation", use, [("info", use < 0.60, 0.60)])
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def blocks_deployment(found: DataFrame) -> bool:
    return not found.where("severity = 'critical'").isEmpty()
