"""Queries: drift between two tables, decay, stability and alerts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import drift
from . import allocation
from .features import _rounded
from .inputs import DRIFT, UNITS, frame, plain

NUMBERS = ("price", "customer", "half")
CATEGORIES = ("priority", "status")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = frame(spark, sf_dir, DRIFT)
    return rows.where("now = 0"), rows.where("now = 1")


def psi(spark, sf_dir):
    return _rounded(drift.psi(*_sides(spark, sf_dir), NUMBERS), "psi")


def psi_categories(spark, sf_dir):
    return _rounded(drift.psi_categories(*_sides(spark, sf_dir), CATEGORIES), "psi")


def js(spark, sf_dir):
    return _rounded(drift.js_divergence(*_sides(spark, sf_dir), NUMBERS), "js")


def ks(spark, sf_dir):
    return _rounded(drift.ks_statistic(*_sides(spark, sf_dir), NUMBERS), "ks")


def chi2(spark, sf_dir):
    return _rounded(drift.chi2_categories(*_sides(spark, sf_dir), CATEGORIES), "chi2", "cramers_v")


def missing(spark, sf_dir):
    return _rounded(drift.missing_rates(*_sides(spark, sf_dir), (*NUMBERS, *CATEGORIES)), "missing_delta")


def report(spark, sf_dir):
    return _rounded(drift.drift_report(*_sides(spark, sf_dir), NUMBERS, CATEGORIES), "psi", "ks", "js", "chi2", "cramers_v", "missing_delta")


def decay(spark, sf_dir):
    out = drift.performance_decay(frame(spark, sf_dir, DRIFT), "period", "price", "done")
    return _rounded(out, "mean_score", "mean_outcome", "auc", "corr", "slope", "skill", "rel_drop")


def stability(spark, sf_dir):
    out, _ = drift.effect_stability(frame(spark, sf_dir, UNITS), "effect", "effect2", "unit_id")
    return _rounded(out, "spearman", "pearson", "sign_flips", "top_retention")


def transitions(spark, sf_dir):
    return drift.effect_stability(frame(spark, sf_dir, UNITS), "effect", "effect2", "unit_id")[1]


def _policy(spark, sf_dir):
    """(ci_low, gap, roi, utilisation) of the allocation: its bootstrapped gain, its lead over the first offer for all, what it earns and spends."""
    boot = {r.policy: r for r in allocation.policy_bootstrap(spark, sf_dir).collect()}
    spent = allocation.allocation_summary(spark, sf_dir).first()
    return spark.createDataFrame([(boot["chosen"].diff_low, boot["chosen"].diff - boot["first"].diff, spent.roi, spent.utilisation)], "ci_low double, gap double, roi double, utilisation double")


def prediction(spark, sf_dir):
    return _rounded(drift.prediction_drift(*_sides(spark, sf_dir), "price"), "psi", "ks", "js", "mean_ref", "mean_cur", "sd_ratio", "p90_shift", digits=5)


def p_values(spark, sf_dir):
    return _rounded(drift.p_values(drift.ks_statistic(*_sides(spark, sf_dir), NUMBERS), drift.chi2_categories(*_sides(spark, sf_dir), CATEGORIES)), "statistic", "p_value", digits=5)


def summary_of_alerts(spark, sf_dir):
    return drift.alert_summary(alerts(spark, sf_dir))


def alerts(spark, sf_dir):
    found = written(drift.drift_report(*_sides(spark, sf_dir), NUMBERS, CATEGORIES))  # two rules read it
    decayed = drift.performance_decay(frame(spark, sf_dir, DRIFT), "period", "price", "done")
    policy = _policy(spark, sf_dir)
    stable, _ = drift.effect_stability(frame(spark, sf_dir, UNITS), "effect", "effect2", "unit_id")
    return _rounded(drift.alerts(found, decayed, stable, policy), "value")


QUERIES = {
    "population_stability": psi, "category_stability": psi_categories, "js_divergence": js, "ks_distance": ks, "chi2_categories": chi2, "missing_rates": missing,
    "drift_report": report, "performance_decay": decay, "effect_stability": stability, "effect_transitions": transitions, "alert_rules": alerts, "alert_summary": summary_of_alerts, "prediction_drift": prediction, "drift_p_values": p_values,
}

_D = f"({plain(DRIFT)})"
_U = f"({plain(UNITS)})"
_NUM = f"l AS (SELECT now, f.feature, CASE f.feature WHEN 'price' THEN price WHEN 'customer' THEN customer ELSE half END AS x FROM {_D}, (SELECT unnest(['price', 'customer', 'half']) AS feature) f)"
_CAT = f"l AS (SELECT now, f.feature, CASE f.feature WHEN 'priority' THEN trim(priority) ELSE trim(status) END AS bin FROM {_D}, (SELECT unnest(['priority', 'status']) AS feature) f)"
_SHARE = "s AS (SELECT feature, bin, coalesce(sum(n) FILTER (now = 0) / any_value(tr), 0) AS p, coalesce(sum(n) FILTER (now = 1) / any_value(tc), 0) AS q FROM (SELECT *, sum(n) FILTER (now = 0) OVER (PARTITION BY feature) AS tr, sum(n) FILTER (now = 1) OVER (PARTITION BY feature) AS tc FROM c) GROUP BY feature, bin)"
_PSI = "SELECT feature, round(sum((greatest(q, 1e-6) - greatest(p, 1e-6)) * ln(greatest(q, 1e-6) / greatest(p, 1e-6))), 6) AS psi FROM s GROUP BY feature"
_GRADE = "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 OR missing_delta > 0.05 THEN 'warn' ELSE 'ok' END"
_CELLS = "c AS (SELECT feature, now, bin, count(*) AS n FROM b GROUP BY 1, 2, 3)"
SQL = {
    "population_stability": f"""WITH {_NUM}, e AS (SELECT feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM l WHERE now = 0 GROUP BY feature),
b AS (SELECT l.feature, now, len(list_filter(edges, lambda z: z <= x)) AS bin FROM l JOIN e ON e.feature = l.feature WHERE x IS NOT NULL), {_CELLS}, {_SHARE} {_PSI}""",
    "category_stability": f"WITH {_CAT}, b AS (SELECT * FROM l WHERE bin IS NOT NULL), {_CELLS}, {_SHARE} {_PSI}",
    "js_divergence": f"""WITH {_NUM}, m AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature), b AS (SELECT l.feature, now, least(floor((x - lo) / ((hi - lo) / 20)), 19) AS bin FROM l JOIN m ON m.feature = l.feature WHERE x IS NOT NULL), {_CELLS}, {_SHARE}
SELECT feature, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM s GROUP BY feature""",
    "ks_distance": f"""WITH {_NUM}, g AS (SELECT feature, x, now, count(*) FILTER (now = 0) OVER w AS r, count(*) FILTER (now = 1) OVER w AS c, count(*) FILTER (now = 0) OVER v AS nr, count(*) FILTER (now = 1) OVER v AS nc
  FROM l WHERE x IS NOT NULL WINDOW w AS (PARTITION BY feature ORDER BY x RANGE UNBOUNDED PRECEDING), v AS (PARTITION BY feature))
SELECT feature, any_value(nr) AS n_ref, any_value(nc) AS n_cur, round(max(abs(r / nr - c / nc)), 6) AS ks FROM g GROUP BY feature""",
    "chi2_categories": f"""WITH {_CAT}, c AS (SELECT feature, bin, count(*) FILTER (now = 0) AS r, count(*) FILTER (now = 1) AS c FROM l GROUP BY 1, 2), t AS (SELECT *, sum(r) OVER w AS nr, sum(c) OVER w AS nc FROM c WINDOW w AS (PARTITION BY feature)), e AS (
  SELECT *, (r + c) * nr / (nr + nc) AS er, (r + c) * nc / (nr + nc) AS ec FROM t), x AS (SELECT feature, count(*) - 1 AS dof, sum((r - er) ** 2 / er + (c - ec) ** 2 / ec) AS chi2, any_value(nr + nc) AS n FROM e GROUP BY feature)
SELECT feature, dof, round(chi2, 6) AS chi2, round(sqrt(chi2 / n), 6) AS cramers_v FROM x""",
    "missing_rates": f"""WITH {_NUM}, m AS (SELECT feature, avg((x IS NULL)::INT) FILTER (now = 1) - avg((x IS NULL)::INT) FILTER (now = 0) AS d FROM l GROUP BY feature)
SELECT feature, round(d, 6) AS missing_delta FROM m UNION ALL SELECT unnest(['priority', 'status']), 0""",
    "performance_decay": f"""WITH RECURSIVE d AS {_D}, z AS (SELECT period, done, (price - avg(price) OVER w) / stddev_pop(price) OVER w AS z, avg(done) OVER w AS o FROM d WINDOW w AS (PARTITION BY period)), newton(i, period, a, b) AS (
  SELECT 0, period, 0::DOUBLE, 0::DOUBLE FROM z WHERE o > 0 AND o < 1 GROUP BY period UNION ALL
  SELECT i + 1, period, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
    SELECT i, period, a, b, sum(done - p) AS g0, sum((done - p) * z) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * z) AS h1, sum(p * (1 - p) * z * z) AS h2
    FROM (SELECT i, n.period, a, b, done, z, 1 / (1 + exp(-(a + b * z))) AS p FROM newton n JOIN z ON z.period = n.period WHERE i < 8) GROUP BY i, period, a, b)), r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY price) + (count(*) OVER (PARTITION BY period, price) - 1) / 2 AS rk FROM d), a AS (
  SELECT period, count(*) AS n, avg(price) AS ms, avg(done) AS mo, sum(done) AS n1, sum(rk) FILTER (done = 1) AS rs, corr(price, done) AS c FROM r GROUP BY period), u AS (
  SELECT *, CASE WHEN n1 > 0 AND n1 < n THEN (rs - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) END AS auc FROM a), s AS (SELECT *, CASE WHEN n >= 30 THEN auc - 0.5::DOUBLE END AS skill FROM u), b AS (
  SELECT *, (SELECT arg_min(skill, period) FROM s WHERE skill IS NOT NULL) AS base FROM s), f AS (SELECT *, CASE WHEN base > 0 THEN (base - skill) / base END AS drop_ FROM b)
SELECT period, n, round(ms, 6) AS mean_score, round(mo, 6) AS mean_outcome, round(auc, 6) AS auc, round(c, 6) AS corr, round((SELECT b FROM newton w WHERE w.period = f.period AND i = 8), 6) AS slope, round(skill, 6) AS skill, round(drop_, 6) AS rel_drop,
  coalesce(drop_ > 0.1 AND sum((drop_ > 0.1)::INT) OVER (ORDER BY period) = 1, false) AS first_decay FROM f""",
    "effect_stability": f"""WITH r AS (SELECT effect AS r, effect2 AS c, rank() OVER (ORDER BY effect) + (count(*) OVER (PARTITION BY effect) - 1) / 2 AS rr, rank() OVER (ORDER BY effect2) + (count(*) OVER (PARTITION BY effect2) - 1) / 2 AS rc,
  (row_number() OVER (ORDER BY effect, unit_id) - 1) * 10 // count(*) OVER () AS rb, (row_number() OVER (ORDER BY effect2, unit_id) - 1) * 10 // count(*) OVER () AS cb FROM {_U})
SELECT count(*) AS n, round(corr(rr, rc), 6) AS spearman, round(corr(r, c), 6) AS pearson, round(avg((sign(r) <> sign(c))::INT) FILTER (r <> 0 AND c <> 0), 6) AS sign_flips, round(avg((cb = 9)::INT) FILTER (rb = 9), 6) AS top_retention FROM r""",
    "effect_transitions": f"""WITH r AS (SELECT ((row_number() OVER (ORDER BY effect, unit_id) - 1) * 10 // count(*) OVER ())::INT AS ref_bin, ((row_number() OVER (ORDER BY effect2, unit_id) - 1) * 10 // count(*) OVER ())::INT AS cur_bin FROM {_U})
SELECT ref_bin, cur_bin, count(*) AS n FROM r GROUP BY 1, 2""",
}
SQL["drift_report"] = f"""
SELECT *, {_GRADE} AS severity FROM (
  SELECT feature, 'number' AS kind, psi, ks, js, NULL::DOUBLE AS chi2, NULL::DOUBLE AS cramers_v, missing_delta FROM ({SQL['population_stability']}) a JOIN ({SQL['ks_distance']}) b USING (feature) JOIN ({SQL['js_divergence']}) c USING (feature) JOIN ({SQL['missing_rates']}) d USING (feature)
  UNION ALL SELECT feature, 'category', psi, NULL, NULL, chi2, cramers_v, missing_delta FROM ({SQL['category_stability']}) a JOIN ({SQL['chi2_categories']}) b USING (feature) JOIN ({SQL['missing_rates']}) d USING (feature))"""


def _whole(sql: str, name: str) -> str:
    """The query with the column ``name`` not rounded."""
    return re.sub(rf"round\((.*), 6\) AS {name}\b", rf"\1 AS {name}", sql)


_TAU = "(SELECT sum(CASE WHEN i % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * i * i * s * s * r * c / (r + c))) FROM range(1, 101) t(i))"
_GAMMA = "(SELECT sum(exp(-u / 2) * u ** (dof / 2 - 1)) * (x2 / 200000) / (2 ** (dof / 2) * gamma(dof / 2)) FROM (SELECT (i + 0.5) * x2 / 200000 AS u FROM range(200000) t(i)))"
SQL["drift_p_values"] = f"""SELECT feature, 'ks' AS test, round(ks, 5) AS statistic, round(least(1, greatest(0, {_TAU})), 5) AS p_value FROM (SELECT feature, ks, ks AS s, n_ref::DOUBLE AS r, n_cur::DOUBLE AS c FROM ({_whole(SQL['ks_distance'], 'ks')}))
UNION ALL SELECT feature, 'chi2', round(x2, 5), round(1 - {_GAMMA}, 5) FROM (SELECT feature, chi2 AS x2, dof::DOUBLE AS dof FROM ({_whole(SQL['chi2_categories'], 'chi2')}))"""
SQL["prediction_drift"] = f"""WITH d AS {_D}, m AS (SELECT avg(price) FILTER (now = 0) AS a, avg(price) FILTER (now = 1) AS b, stddev_samp(price) FILTER (now = 1) / stddev_samp(price) FILTER (now = 0) AS s, quantile_cont(price, 0.9) FILTER (now = 1) - quantile_cont(price, 0.9) FILTER (now = 0) AS p FROM d)
SELECT round(psi, 5) AS psi, round(ks, 5) AS ks, round(js, 5) AS js, round(a, 5) AS mean_ref, round(b, 5) AS mean_cur, round(s, 5) AS sd_ratio, round(p, 5) AS p90_shift, CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END AS severity
FROM m, (SELECT psi, ks, js FROM ({SQL['population_stability']}) x JOIN ({SQL['ks_distance']}) y USING (feature) JOIN ({SQL['js_divergence']}) z USING (feature) WHERE feature = 'price')"""
_BOOT, _SPENT = allocation.SQL["policy_bootstrap"], allocation.SQL["allocation_summary"]


def _rule(source: str, subject: str, rule: str, value: str, levels: tuple[tuple[str, str, float], ...], table: str) -> str:
    severity = " ".join(f"WHEN {value} {when} THEN '{level}'" for level, when, _ in levels)
    bound = " ".join(f"WHEN {value} {when} THEN {limit}::DOUBLE" for _, when, limit in levels)
    return f"SELECT '{source}' AS source, {subject} AS subject, '{rule}' AS rule, CASE {severity} END AS severity, round({value}, 6)::DOUBLE AS value, CASE {bound} END AS bound FROM {table}"


_PERIODS, _STABLE = f"(SELECT arg_min(auc, period) - arg_max(auc, period) AS d FROM ({SQL['performance_decay']}))", f"({SQL['effect_stability']})"
_GAINS = f"(SELECT max(diff_low) FILTER (policy = 'chosen') AS lo, max(diff) FILTER (policy = 'chosen') - max(diff) FILTER (policy = 'first') AS gap FROM ({_BOOT}))"
SQL["alert_rules"] = "SELECT * FROM (" + " UNION ALL ".join((
    _rule("drift", "feature", "psi", "psi", (("critical", ">= 0.25", drift.PSI_ALERT), ("warn", ">= 0.1", drift.PSI_WARN)), f"({SQL['drift_report']})"),
    _rule("drift", "feature", "missing", "missing_delta", (("critical", ">= 0.2", 0.2), ("warn", ">= 0.1", 0.1)), f"({SQL['drift_report']})"),
    _rule("decay", "'auc'", "auc_drop", "d", (("critical", f">= {drift.DECAY_CRITICAL}", drift.DECAY_CRITICAL), ("warn", f">= {drift.DECAY_WARN}", drift.DECAY_WARN)), _PERIODS),
    _rule("stability", "'rank'", "rank_correlation", "spearman", (("critical", "< 0.35", 0.35), ("warn", "< 0.7", 0.7)), _STABLE),
    _rule("stability", "'sign'", "sign_flips", "sign_flips", (("critical", ">= 0.3", 0.3), ("warn", ">= 0.15", 0.15)), _STABLE),
    _rule("policy", "'value'", "ci_low", "lo", (("critical", "<= 0", 0.0),), _GAINS), _rule("policy", "'baseline'", "gap", "gap", (("critical", "<= 0", 0.0),), _GAINS),
    _rule("policy", "'roi'", "roi", "roi", (("warn", "< 0", 0.0),), f"({_SPENT})"), _rule("policy", "'budget'", "utilisation", "utilisation", (("info", "< 0.6", 0.6),), f"({_SPENT})"),
)) + ") WHERE severity IS NOT NULL"
SQL["alert_summary"] = f"SELECT severity, count(*) AS n, severity = 'critical' AS blocks FROM ({SQL['alert_rules']}) GROUP BY severity"
