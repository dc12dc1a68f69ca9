"""Queries: survival, balance and uplift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, survival, uplift
from .features import _rounded
from .inputs import UNITS, frame, plain

E = ("e0", "e1", "e2", "e3")


def _units(spark, sf_dir) -> DataFrame:
    return frame(spark, sf_dir, UNITS)


def _lived(spark, sf_dir) -> DataFrame:
    return _units(spark, sf_dir).where("t IS NOT NULL")


def person_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.person_period(_lived(spark, sf_dir), "t", "event", 60, ["unit_id"])


def kaplan_meier(spark, sf_dir):
    return _rounded(survival.kaplan_meier(_lived(spark, sf_dir), "t", "event"), "survival", "greenwood", digits=8)


def censoring(spark, sf_dir):
    return _rounded(survival.censoring_survival(_lived(spark, sf_dir), "t", "event"), "g", digits=8)


def restricted(spark, sf_dir):
    return _rounded(survival.ipcw(_lived(spark, sf_dir), "t", "event", 70, 0.01), "value", "weight", "pseudo").select("unit_id", "periods", "follow_up", "complete", "value", "weight", "pseudo")


def concordance(spark, sf_dir):
    return _rounded(survival.concordance(_lived(spark, sf_dir), "t", "event", "risk"), "c_index")


def td_auc(spark, sf_dir):
    return _rounded(survival.time_dependent_auc(_lived(spark, sf_dir), "t", "event", "risk", [60, 70, 74]), "auc")


def brier(spark, sf_dir):
    s = F.exp(-F.col("tau") * (F.col("risk") + 2) / 1000)
    return _rounded(survival.brier(_lived(spark, sf_dir), "t", "event", s, [60, 70, 74]), "brier")


def integrated_brier(spark, sf_dir):
    return _rounded(survival.trapezoid(brier(spark, sf_dir), "tau", "brier"), "area", digits=5)


def calibration(spark, sf_dir):
    return _rounded(survival.calibration(_lived(spark, sf_dir), "t", "event", "prob", 72.0, "unit_id"), "mean_predicted", "observed")


def smd(spark, sf_dir):
    weighted = balance.ipw_weights(_units(spark, sf_dir), "arm", E, stabilised=False)
    return _rounded(balance.standardised_differences(weighted, "arm", ["x1", "x2"], "ipw"), "smd", "smd_weighted")


def overlap(spark, sf_dir):
    return _rounded(balance.overlap(_units(spark, sf_dir), "arm", E), "p_min", "p1", "p5", "median", "p95", "p99", "p_max", "share_low", "share_high")


def weights(spark, sf_dir):
    w = balance.ipw_weights(_units(spark, sf_dir), "arm", E, clip=0.9)
    return _rounded(w.groupBy("arm").agg(F.count("*").alias("n"), F.sum("ipw").alias("total"), F.max("ipw").alias("top"), balance.effective_sample_size(F.col("ipw")).alias("ess")), "total", "top", "ess", digits=4)


def hajek(spark, sf_dir):
    return _rounded(balance.hajek_means(_units(spark, sf_dir), "y", "w", 1 - F.col("e0")), "mean_treated", "mean_control")


def trimmed(spark, sf_dir):
    return balance.trim_by_overlap(_units(spark, sf_dir), "arm", E, 0.22, 0.9).groupBy("arm").agg(F.count("*").alias("n"))


def rank_auc(spark, sf_dir):
    return _rounded(balance.auc(_units(spark, sf_dir), "risk", "label", ["grp"]), "auc")


def ece(spark, sf_dir):
    return _rounded(balance.calibration_error(_units(spark, sf_dir), "prob", "label", by=["grp"]), "ece")


def qini(spark, sf_dir):
    return _rounded(uplift.qini_curve(_units(spark, sf_dir), "y", "w", "effect", "unit_id", 0.1), "value", "random", "qini", digits=4)


def scores(spark, sf_dir):
    u = _units(spark, sf_dir)
    got = (uplift.qini_score(u, "y", "w", "effect", "unit_id"), uplift.auuc(u, "y", "w", "effect", "unit_id"))
    return _rounded(spark.createDataFrame([got], "qini_score double, auuc double"), "qini_score", "auuc")


def at_k(spark, sf_dir):
    return _rounded(uplift.uplift_at_k(_units(spark, sf_dir), "y", "w", "effect", "unit_id", 0.2), "uplift", "qini", digits=4)


def deciles(spark, sf_dir):
    return _rounded(uplift.uplift_by_decile(_units(spark, sf_dir), "y", "w", "effect", "unit_id"), "mean_effect", "uplift", "se", "ci_low", "ci_high", digits=5)


def toc(spark, sf_dir):
    return _rounded(uplift.targeting_characteristic(_units(spark, sf_dir), "y", "w", "effect", "unit_id", 20), "q", "toc")


def gates(spark, sf_dir):
    return _rounded(uplift.gates(_units(spark, sf_dir), "y", "w", "effect", 1 - F.col("e0"), "unit_id"), "gate", "se")


def blp(spark, sf_dir):
    t, e = F.col("w").cast("double"), 1 - F.col("e0")
    psi = uplift.aipw_score(F.col("y"), t, e, F.col("mu0"), F.col("mu1"))
    return _rounded(uplift.blp(_units(spark, sf_dir), psi, "effect"), "ate", "slope", "se_ate", "se_slope")


def errors(spark, sf_dir):
    return _rounded(uplift.effect_errors(_units(spark, sf_dir), ["tau1", "tau2"], ["tau2", "tau3"]), "pehe", "eps_ate")


def risk(spark, sf_dir):
    return _rounded(uplift.policy_risk(_units(spark, sf_dir), ["mu0", "mu1", "mu2", "mu3"], "arm"), "policy_risk")


QUERIES = {
    "person_period": person_period, "kaplan_meier": kaplan_meier, "censoring_survival": censoring, "restricted_outcome": restricted, "concordance_index": concordance,
    "time_dependent_auc": td_auc, "brier_score": brier, "integrated_brier": integrated_brier, "survival_calibration": calibration, "standardised_differences": smd,
    "overlap_diagnostics": overlap, "ipw_weights": weights, "hajek_means": hajek, "trim_by_overlap": trimmed, "rank_auc": rank_auc, "calibration_error": ece,
    "qini_curve": qini, "uplift_scores": scores, "uplift_at_k": at_k, "uplift_deciles": deciles, "targeting_characteristic": toc, "gates": gates, "blp_calibration": blp,
    "effect_errors": errors, "policy_risk": risk,
}

_U = f"({plain(UNITS)})"
_L = f"(SELECT * FROM {_U} WHERE t IS NOT NULL)"
_KM = "SELECT t, d, n, exp(sum(CASE WHEN n > d THEN ln(1 - d / n) ELSE -1e300::DOUBLE END) OVER w) AS s FROM (SELECT t, sum({0}) AS d, (SELECT count(*) FROM l b WHERE b.t >= l.t) AS n FROM l GROUP BY t) WHERE d > 0 WINDOW w AS (ORDER BY t)"
_G = f"g AS (SELECT t, greatest(s, 1e-3::DOUBLE) AS g FROM ({_KM.format('1 - event')}))"
_AT = "coalesce((SELECT arg_max(g, t) FROM g WHERE g.t {0} {1}), 1)"
_CURVE = f"""u AS {_U}, c AS (SELECT row_number() OVER o AS k, sum(w) OVER o AS n_t, sum(1 - w) OVER o AS n_c, coalesce(sum(y * w) OVER o, 0) AS y_t, coalesce(sum(y * (1 - w)) OVER o, 0) AS y_c
  FROM u WINDOW o AS (ORDER BY effect DESC, unit_id ROWS UNBOUNDED PRECEDING))"""
_IDEAL = """i AS (SELECT row_number() OVER o AS k, sum(w) OVER o AS n_t, sum(1 - w) OVER o AS n_c, sum(y * w) OVER o AS y_t, sum(y * (1 - w)) OVER o AS y_c FROM (
  SELECT *, (row_number() OVER (PARTITION BY w ORDER BY CASE WHEN w = 1 THEN -y ELSE y END, unit_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY w) AS z FROM u) WINDOW o AS (ORDER BY z, unit_id ROWS UNBOUNDED PRECEDING))"""
_Q = "CASE WHEN n_c > 0 THEN y_t - y_c * n_t / n_c ELSE 0 END"
_V = "CASE WHEN n_t > 0 AND n_c > 0 THEN (y_t / n_t - y_c / n_c) * k ELSE 0 END"
_ENDS = "(SELECT sum({0}) - arg_max({0}, k) / 2 {2} FROM {1})"
SQL = {
    "person_period": f"SELECT unit_id, p.period::INT AS period, (event = 1 AND t <= 60 AND p.period = least(t, 60) - 1)::INT AS event FROM {_L}, LATERAL (SELECT unnest(range(0, least(t, 60))) AS period) p",
    "kaplan_meier": f"""WITH l AS {_L}, c AS ({_KM.format('event')}) SELECT t::DOUBLE AS t, d::BIGINT AS n_events, n AS n_at_risk, round(s, 8) AS survival,
  round(CASE WHEN min(n - d) OVER w > 0 THEN sum(d / (n * (n - d))) OVER w END, 8) AS greenwood FROM c WINDOW w AS (ORDER BY t)""",
    "censoring_survival": f"WITH l AS {_L}, {_G} SELECT t::DOUBLE AS t, round(g, 8) AS g FROM g",
    "restricted_outcome": f"""WITH l AS {_L}, {_G}, r AS (SELECT unit_id, greatest(least(t - event, 70), 0)::BIGINT AS periods, least(t, 70)::BIGINT AS follow_up, event = 1 OR t >= 70 AS complete FROM l), v AS (
  SELECT *, (1 - pow(1.01::DOUBLE, -periods)) / 0.01::DOUBLE AS value, CASE WHEN complete THEN 1 / {_AT.format('<', 'r.follow_up')} ELSE 0 END AS weight FROM r)
SELECT unit_id, periods, follow_up, complete, round(value, 6) AS value, round(weight, 6) AS weight, round(value * weight, 6) AS pseudo FROM v""",
    "concordance_index": f"""WITH l AS {_L}, p AS (SELECT a.risk AS r, b.risk AS s FROM l a JOIN l b ON a.event = 1 AND (b.t > a.t OR b.t = a.t AND b.event = 0))
SELECT count(*) FILTER (r > s) AS concordant, count(*) FILTER (r = s) AS tied, count(*) AS pairs, round((count(*) FILTER (r > s) + count(*) FILTER (r = s) / 2) / count(*), 6) AS c_index FROM p""",
    "time_dependent_auc": f"""WITH l AS {_L}, {_G}, x AS (SELECT *, {_AT.format('<', 'l.t')} AS g FROM l), tau AS (SELECT unnest([60, 70, 74])::DOUBLE AS tau)
SELECT tau, (SELECT count(*) FROM x WHERE t <= tau AND event = 1) AS n_cases, (SELECT count(*) FROM x WHERE t > tau) AS n_controls, round((SELECT sum(1 / a.g * CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0 END) / sum(1 / a.g)
  FROM x a JOIN x b ON a.t <= tau AND a.event = 1 AND b.t > tau), 6) AS auc FROM tau""",
    "brier_score": f"""WITH l AS {_L}, {_G}, x AS (SELECT *, {_AT.format('<', 'l.t')} AS g FROM l), tau AS (SELECT tau, {_AT.format('<=', 'z.tau')} AS gt FROM (SELECT unnest([60, 70, 74])::DOUBLE AS tau) z), s AS (SELECT *, exp(-tau * (risk + 2) / 1000) AS s FROM x, tau)
SELECT tau, round(avg(CASE WHEN t <= tau AND event = 1 THEN s * s / g WHEN t > tau THEN (1 - s) * (1 - s) / gt ELSE 0 END), 6) AS brier FROM s GROUP BY tau""",
    "survival_calibration": f"""WITH l AS (SELECT *, ((row_number() OVER (ORDER BY prob, unit_id) - 1) * 10 // count(*) OVER ())::INT AS bin FROM {_L}), x AS (
  SELECT bin, t, sum(event) AS d, (SELECT count(*) FROM l b WHERE b.bin = l.bin AND b.t >= l.t) AS n FROM l GROUP BY bin, t), s AS (SELECT bin, product(1 - d / n) AS s FROM x WHERE d > 0 AND t <= 72 GROUP BY bin)
SELECT l.bin, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(coalesce(any_value(s), 1), 6) AS observed FROM l LEFT JOIN s ON s.bin = l.bin GROUP BY l.bin""",
    "standardised_differences": f"""WITH u AS (SELECT *, 1 / CASE arm WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS q FROM {_U}), l AS (SELECT 'x1' AS feature, arm, q, x1 AS x FROM u UNION ALL SELECT 'x2', arm, q, x2 FROM u), m AS (
  SELECT feature, arm, avg(x) AS m, var_samp(x) AS v, sum(q * x) / sum(q) AS wm, sum(q) AS sq, sum(q * q) AS sqq FROM l GROUP BY 1, 2), v AS (
  SELECT m.*, (SELECT sum(q * (x - m.wm) * (x - m.wm)) FROM l WHERE l.feature = m.feature AND l.arm = m.arm) * sq / (sq * sq - sqq) AS wv FROM m)
SELECT a.feature, a.arm, round((a.m - c.m) / sqrt((a.v + c.v) / 2), 6) AS smd, round((a.wm - c.wm) / sqrt((a.wv + c.wv) / 2), 6) AS smd_weighted FROM v a JOIN v c ON a.feature = c.feature AND c.arm = 0 AND a.arm > 0""",
    "overlap_diagnostics": f"""WITH l AS (SELECT a.i::INT AS arm, u.arm = a.i AS own, CASE a.i WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS p FROM {_U} u, (SELECT unnest([0, 1, 2, 3]) AS i) a)
SELECT arm, own, count(*) AS n, round(min(p), 6) AS p_min, round(quantile_cont(p, 0.01), 6) AS p1, round(quantile_cont(p, 0.05), 6) AS p5, round(median(p), 6) AS median, round(quantile_cont(p, 0.95), 6) AS p95, round(quantile_cont(p, 0.99), 6) AS p99,
  round(max(p), 6) AS p_max, round(avg((p <= 0.01)::INT), 6) AS share_low, round(avg((p >= 0.99)::INT), 6) AS share_high, avg((p <= 0.01)::INT) > 0.05 OR avg((p >= 0.99)::INT) > 0.05 AS flag FROM l GROUP BY arm, own""",
    "ipw_weights": f"""WITH u AS (SELECT arm, count(*) OVER (PARTITION BY arm) / count(*) OVER () / CASE arm WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS q FROM {_U}), c AS (SELECT quantile_cont(q, 0.9) AS top FROM u), w AS (SELECT arm, least(q, top) AS q FROM u, c)
SELECT arm, count(*) AS n, round(sum(q), 4) AS total, round(max(q), 4) AS top, round(sum(q) * sum(q) / sum(q * q), 4) AS ess FROM w GROUP BY arm""",
    "hajek_means": f"SELECT round(sum(w * y / (1 - e0)) / sum(w / (1 - e0)), 6) AS mean_treated, round(sum((1 - w) * y / e0) / sum((1 - w) / e0), 6) AS mean_control FROM {_U}",
    "trim_by_overlap": f"SELECT arm, count(*) AS n FROM {_U} WHERE e0 BETWEEN 0.22 AND 0.9 AND CASE arm WHEN 0 THEN e0 WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END BETWEEN 0.22 AND 0.9 GROUP BY arm",
    "rank_auc": f"""WITH u AS {_U} SELECT grp, count(*) AS n, round((SELECT avg(CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5::DOUBLE ELSE 0 END) FROM u a JOIN u b ON a.grp = b.grp AND a.label = 1 AND b.label = 0 WHERE a.grp = u.grp), 6) AS auc FROM u GROUP BY grp""",
    "calibration_error": f"WITH b AS (SELECT grp, count(*) AS n, avg(prob) AS p, avg(label) AS y FROM {_U} GROUP BY grp, least(floor(prob * 10), 9)) SELECT grp, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY grp",
    "qini_curve": f"""WITH {_CURVE}, v AS (SELECT k, n_t::BIGINT AS n_t, n_c::BIGINT AS n_c, {_Q} - 0.1::DOUBLE * n_t AS value FROM c UNION ALL SELECT 0, 0, 0, 0), e AS (SELECT max(k) AS n, arg_max(value, k) AS last FROM v)
SELECT k, n_t, n_c, round(value, 4) AS value, round(last * k / n, 4) AS random, round(value - last * k / n, 4) AS qini FROM v, e""",
    "uplift_scores": f"""WITH {_CURVE}, {_IDEAL} SELECT round({_ENDS.format(_Q, 'c', f'- arg_max({_Q}, k) * max(k) / 2')} / {_ENDS.format(_Q, 'i', f'- arg_max({_Q}, k) * max(k) / 2')}, 6) AS qini_score, round({_ENDS.format(_V, 'c', '')} / {_ENDS.format(_V, 'i', '')}, 6) AS auuc""",
    "uplift_at_k": f"WITH {_CURVE} SELECT k, round(y_t / n_t - y_c / n_c, 4) AS uplift, round(y_t - y_c * n_t / n_c, 4) AS qini FROM c WHERE k = ceil(0.2 * (SELECT count(*) FROM c))",
    "uplift_deciles": f"""WITH b AS (SELECT *, ntile(10) OVER (ORDER BY effect DESC, unit_id)::INT AS bin FROM {_U}), g AS (SELECT bin, sum(w)::BIGINT AS n_t, sum(1 - w)::BIGINT AS n_c, avg(effect) AS mean_effect, avg(y) FILTER (w = 1) - avg(y) FILTER (w = 0) AS u,
  sqrt(var_samp(y) FILTER (w = 1) / sum(w) + var_samp(y) FILTER (w = 0) / sum(1 - w)) AS se FROM b GROUP BY bin)
SELECT bin, n_t, n_c, round(mean_effect, 5) AS mean_effect, round(u, 5) AS uplift, round(se, 5) AS se, round(u - 1.959963984540054 * se, 5) AS ci_low, round(u + 1.959963984540054 * se, 5) AS ci_high FROM g""",
    "targeting_characteristic": f"""WITH {_CURVE}, n AS (SELECT count(*) AS n FROM c), g AS (SELECT i / 20 AS q, round_even(i / 20 * n, 0)::BIGINT AS m, n FROM n, (SELECT unnest(range(1, 21)) AS i))
SELECT round(q, 6) AS q, m, round(a.y_t / a.n_t - a.y_c / a.n_c - (z.y_t / z.n_t - z.y_c / z.n_c), 6) AS toc FROM g JOIN c a ON a.k = m JOIN c z ON z.k = n""",
    "gates": f"""WITH b AS (SELECT *, 1 - e0 AS e, ntile(5) OVER (ORDER BY effect, unit_id)::INT AS bin FROM {_U}), m AS (SELECT bin, sum(w / e * y) / sum(w / e) AS m1, sum((1 - w) / (1 - e) * y) / sum((1 - w) / (1 - e)) AS m0 FROM b GROUP BY bin), p AS (
  SELECT bin, m1 - m0 + w / e * (y - m1) - (1 - w) / (1 - e) * (y - m0) AS p FROM b JOIN m USING (bin)) SELECT bin, count(*) AS n, round(avg(p), 6) AS gate, round(stddev_samp(p) / sqrt(count(*)), 6) AS se FROM p GROUP BY bin""",
    "blp_calibration": f"""WITH p AS (SELECT mu1 - mu0 + w / (1 - e0) * (y - mu1) - (1 - w) / e0 * (y - mu0) AS p, effect AS x FROM {_U}), c AS (SELECT count(*) AS n, avg(p) AS a, avg(x) AS m, regr_slope(p, x) AS b FROM p), r AS (
  SELECT n, a, b, p - a - b * (x - m) AS r, x - m AS d FROM p, c)
SELECT n, round(a, 6) AS ate, round(b, 6) AS slope, round(sqrt(sum(r * r) * n / (n - 2)) / n, 6) AS se_ate, round(sqrt(sum(r * r * d * d) * n / (n - 2)) / sum(d * d), 6) AS se_slope FROM r GROUP BY n, a, b""",
    "effect_errors": f"WITH l AS (SELECT tau1 AS t, tau2 AS p FROM {_U} UNION ALL SELECT tau2, tau3 FROM {_U}) SELECT round(sqrt(avg((t - p) * (t - p))), 6) AS pehe, round(abs(avg(t) - avg(p)), 6) AS eps_ate FROM l",
    "policy_risk": f"SELECT round(avg(greatest(mu0, mu1, mu2, mu3) - CASE arm WHEN 0 THEN mu0 WHEN 1 THEN mu1 WHEN 2 THEN mu2 ELSE mu3 END), 6) AS policy_risk FROM {_U}",
}
SQL["integrated_brier"] = f"SELECT round(sum((tau - lt) * (brier + lb) / 2) / (max(tau) - min(lt)), 5) AS area FROM (SELECT *, lag(tau) OVER (ORDER BY tau) AS lt, lag(brier) OVER (ORDER BY tau) AS lb FROM ({SQL['brier_score']})) WHERE lt IS NOT NULL"
