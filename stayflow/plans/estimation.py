"""Queries: propensities, effects by meta-learners, hazards and refutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cox, hazard, learners, refute
from .features import _rounded
from .inputs import UNITS, frame, plain

X, E, MU, TAU = ("x1", "x2"), ("e0", "e1", "e2", "e3"), ("mu0", "mu1", "mu2", "mu3"), ("tau1", "tau2", "tau3")
CATE = ("cate_1", "cate_2", "cate_3")
HORIZON = 12


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, UNITS).withColumn("half_years", F.ceil(F.col("t") / 6))


def _cates(df: DataFrame) -> DataFrame:
    return _rounded(df, *CATE).select("unit_id", *CATE)


def s_learner(spark, sf_dir):
    return _cates(learners.s_learner(_units(spark, sf_dir), "y", "arm", X, 4))


def t_learner(spark, sf_dir):
    return _cates(learners.t_learner(_units(spark, sf_dir), "y", "arm", X, 4))


def t_learner_folds(spark, sf_dir):
    return _cates(learners.t_learner(_units(spark, sf_dir), "y", "arm", ("x1",), 4, 3, "unit_id"))


def x_learner(spark, sf_dir):
    return _cates(learners.x_learner(_units(spark, sf_dir), "y", "arm", X, E))


def dr_learner(spark, sf_dir):
    return _cates(learners.dr_learner(_units(spark, sf_dir), "y", "arm", X, E, MU)[0])


def dr_ate(spark, sf_dir):
    return _rounded(learners.dr_learner(_units(spark, sf_dir), "y", "arm", X, E, MU)[1], "ate", "se")


def r_learner(spark, sf_dir):
    return _cates(learners.r_learner(_units(spark, sf_dir), "y", "arm", ("x1",), E, MU))


def centering(spark, sf_dir):
    return _rounded(learners.local_centering(_units(spark, sf_dir), "y", "arm", X, E, MU), "ate")


def leaderboard(spark, sf_dir):
    units = _units(spark, sf_dir)
    found = {"s": learners.s_learner(units, "y", "arm", X, 4), "t": learners.t_learner(units, "y", "arm", X, 4), "dr": learners.dr_learner(units, "y", "arm", X, E, MU)[0], "r": learners.r_learner(units, "y", "arm", ("x1",), E, MU)}
    return _rounded(learners.compare_learners(found, TAU), "pehe", "eps_ate", digits=4)


def propensities(spark, sf_dir):
    out = learners.propensity(_units(spark, sf_dir), "arm", X, 4, "unit_id", 3)
    return _rounded(out.select("unit_id", "fold", "e_0", "e_1", "e_2", "e_3"), "e_0", "e_1", "e_2", "e_3")


def propensity_report(spark, sf_dir):
    out = learners.propensity_diagnostics(_units(spark, sf_dir), "arm", E)
    return _rounded(out, "mean_e", "auc", "ece", "brier")


def confounding(spark, sf_dir):
    return _rounded(learners.confounding(_units(spark, sf_dir), "y", "arm", E, TAU), "true_ate", "naive", "ipw", "naive_error", "ipw_error")


def segment_means(spark, sf_dir):
    return _rounded(_units(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), *[F.avg(t).alias(t) for t in TAU]), *TAU)


def hazards(spark, sf_dir):
    models = hazard.fit_hazard(_units(spark, sf_dir), "half_years", "event", HORIZON, by="arm")
    one = spark.range(1)
    rows = None
    for arm, m in sorted(models.items()):
        own = one.select(F.lit(arm).alias("arm"), F.posexplode(F.arrays_zip(m.hazard().alias("hazard"), m.survival().alias("survival"))).alias("period", "v"))
        own = own.select("arm", "period", F.col("v.hazard").alias("hazard"), F.col("v.survival").alias("survival"))
        rows = own if rows is None else rows.unionByName(own)
    return _rounded(rows, "hazard", "survival", digits=5)


def hazard_slopes(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("x", F.col("x1") / 1000)
    m = hazard.fit_hazard(units, "half_years", "event", HORIZON, ("x",))[None]
    s = m.survival()
    out = units.select("unit_id", hazard.mean_time(s, 10.5).alias("rmst"), hazard.churn_probability(s, 6).alias("churn"), hazard.value_of(s, F.col("mu0"), 0.01).alias("value"))
    return _rounded(out, "rmst", "churn", "value", digits=5)


def cox_curves(spark, sf_dir):
    units = _units(spark, sf_dir)
    m = cox.fit_cox(units, "half_years", "event", X)
    s = m.survival(range(1, HORIZON + 1))
    out = units.select("unit_id", m.risk().alias("hazard_ratio"), hazard.churn_probability(s, 6).alias("churn"), hazard.mean_time(s, HORIZON).alias("rmst"))
    return _rounded(out, "hazard_ratio", "churn", "rmst", digits=5)


def uplift_on_survival(spark, sf_dir):
    out = hazard.survival_effects(_units(spark, sf_dir), "half_years", "event", "arm", HORIZON, margin=F.col("mu0"), within=8)
    names = [f"{k}_{a}" for a in (1, 2, 3) for k in ("rmst", "value", "churn")]
    return _rounded(out.select("unit_id", *names), *names, digits=4)


def _treated(spark, sf_dir):
    return _units(spark, sf_dir)


def linear_effect(spark, sf_dir):
    got = refute.linear_effect(_treated(spark, sf_dir), F.col("y"), F.col("w"), X)
    return spark.createDataFrame([(round(got["effect"], 6), round(got["se"], 6), int(got["dof"]))], "effect double, se double, dof long")


def partial_linear(spark, sf_dir):
    return _rounded(refute.partial_linear(_treated(spark, sf_dir), "y", "w", X, "unit_id"), "ate", "se")


def robustness(spark, sf_dir):
    return _rounded(refute.robustness(_treated(spark, sf_dir), "y", "w", X), "effect", "se", "t", "robustness", "robustness_alpha", digits=5)


def benchmarks(spark, sf_dir):
    return _rounded(refute.benchmarks(_treated(spark, sf_dir), "y", "w", X), "r2_y", "r2_w", "bias", "adjusted", "multiple", digits=5)


def confounder_shift(spark, sf_dir):
    return _rounded(refute.confounder_shift(_treated(spark, sf_dir), "y", "w", X, "unit_id"), "effect", "shift", "predicted", "gap", digits=5)


def _told(df):
    return _rounded(df, "original", "mean", "low", "high", digits=5)


def placebo(spark, sf_dir):
    return _told(refute.placebo(_treated(spark, sf_dir), "y", "w", X, "unit_id"))


def common_cause(spark, sf_dir):
    return _told(refute.common_cause(_treated(spark, sf_dir), "y", "w", X, "unit_id"))


def subsets(spark, sf_dir):
    return _told(refute.subsets(_treated(spark, sf_dir), "y", "w", X, "unit_id"))


def confounder(spark, sf_dir):
    return _told(refute.hidden_confounder(_treated(spark, sf_dir), "y", "w", X, "unit_id"))


def suite(spark, sf_dir):
    return _told(refute.suite(_treated(spark, sf_dir), "y", "w", X, "unit_id"))


def contour(spark, sf_dir):
    return _rounded(refute.contour(_treated(spark, sf_dir), "y", "w", X), "bias", "adjusted")


def rosenbaum(spark, sf_dir):
    pairs = refute.matched_pairs(_treated(spark, sf_dir), "y", "w", "x1", "unit_id")
    return _rounded(refute.rosenbaum(pairs), "z_low", "z_high", "p_low", "p_high", digits=5)


def placebo_permuted(spark, sf_dir):
    return _rounded(refute.placebo_permuted(_treated(spark, sf_dir), "y", "w", X, "unit_id"), "original", "mean", "low", "high", digits=5)


def hodges_lehmann(spark, sf_dir):
    pairs = refute.matched_pairs(_treated(spark, sf_dir), "y", "w", "x1", "unit_id")
    return _rounded(refute.hodges_lehmann(pairs), "mean_difference", "hodges_lehmann", digits=5)


QUERIES = {
    "s_learner": s_learner, "t_learner": t_learner, "t_learner_folds": t_learner_folds, "x_learner": x_learner, "dr_learner": dr_learner, "dr_ate": dr_ate, "r_learner": r_learner, "local_centering": centering,
    "learner_leaderboard": leaderboard, "propensity_scores": propensities, "propensity_report": propensity_report, "confounding_demo": confounding, "segment_effects": segment_means, "hazard_model": hazards,
    "hazard_values": hazard_slopes, "cox_survival": cox_curves, "survival_uplift": uplift_on_survival, "linear_effect": linear_effect, "partial_linear_ate": partial_linear, "refute_placebo": placebo, "refute_common_cause": common_cause,
    "refute_subset": subsets, "refute_confounder": confounder, "refutation_suite": suite, "sensitivity_contour": contour, "rosenbaum_bounds": rosenbaum,
    "refute_placebo_permuted": placebo_permuted, "robustness_value": robustness, "sensitivity_benchmarks": benchmarks, "confounder_shift": confounder_shift, "hodges_lehmann": hodges_lehmann,
}

_U = f"(SELECT *, ceil(t / 6)::BIGINT AS half_years FROM ({plain(UNITS)}))"


def _fit(y: str, x1: str = "x1", x2: str = "x2") -> str:
    """Sums for a regression on two features, and its coefficients."""
    return f"""avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_pop({x1}) AS s11, var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12, covar_pop({y}, {x1}) AS s1, covar_pop({y}, {x2}) AS s2"""


_B1, _B2 = "(s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12)", "(s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12)"
_COEF = f"b AS (SELECT *, {_B1} AS b1, {_B2} AS b2 FROM m), c AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM b)"
_LINE = "k{0}.b0 + k{0}.b1 * x1 + k{0}.b2 * x2"
_BY_ARM = " ".join(f"JOIN c k{a} ON k{a}.arm = {a}" for a in range(4))
_T = f"WITH u AS {_U}, m AS (SELECT arm, {_fit('y')} FROM u GROUP BY arm), {_COEF} SELECT unit_id, " + ", ".join(f"round(({_LINE.format(a)}) - ({_LINE.format(0)}), 6) AS cate_{a}" for a in (1, 2, 3)) + f" FROM u {_BY_ARM}"
_PSI = ", ".join(f"mu{a} - mu0 + CASE WHEN arm = {a} THEN (y - mu{a}) / e{a} ELSE 0 END - CASE WHEN arm = 0 THEN (y - mu0) / e0 ELSE 0 END AS psi{a}" for a in (1, 2, 3))
_FOLD = "floor(('0x' || substr(md5(concat_ws('|', '0', unit_id, {0})), 1, 12))::BIGINT / 281474976710656::DOUBLE * 3)::INT"


def _uniform(seed: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {seed}, unit_id)), 1, 12))::BIGINT / 281474976710656::DOUBLE)"


def _det(rows: tuple[str, ...], cols: tuple[str, ...], keep: str = "true") -> str:
    """The determinant of the covariances of ``rows`` with ``cols``."""
    if not rows:
        return "1"
    terms = [f"{'-' if j % 2 else '+'} covar_pop({rows[0]}, {c}) FILTER ({keep}) * {_det(rows[1:], cols[:j] + cols[j + 1:], keep)}" for j, c in enumerate(cols)]
    return f"({' '.join(terms)})"


def _left(y: str, others: tuple[str, ...]) -> str:
    """The variance of ``y`` that a regression on ``others`` leaves."""
    return f"({_det((y, *others), (y, *others))} / {_det(others, others)})"


def _effect(y: str, a: str, others: tuple[str, ...], keep: str = "true") -> str:
    """The coefficient of ``a`` in a regression of ``y`` on it and ``others``."""
    return f"({_det((y, *others), (a, *others), keep)} / {_det((a, *others), (a, *others), keep)})"


_R = ", ".join(
    f"(SELECT struct_pack(b0 := (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b1 := (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1)) FROM (SELECT sum(w * r) AS g0, sum(w * r * x1) AS g1, sum(w * w) AS h0, sum(w * w * x1) AS h1, sum(w * w * x1 * x1) AS h2 FROM "
    f"(SELECT x1, (arm = {a})::INT - e{a} / (e0 + e{a}) AS w, y - (mu0 * e0 + mu{a} * e{a}) / (e0 + e{a}) AS r FROM u WHERE arm IN (0, {a})))) AS r{a}" for a in (1, 2, 3)
)
_CENTRE = " UNION ALL ".join(
    f"SELECT {a} AS arm, round(sum(w * r) / sum(w * w), 6) AS ate FROM (SELECT (arm = {a})::INT - e{a} / (e0 + e{a}) AS w, y - (mu0 * e0 + mu{a} * e{a}) / (e0 + e{a}) AS r FROM u WHERE arm IN (0, {a}))" for a in (1, 2, 3)
)
_HAZ = f"""u AS {_U}, n AS (SELECT arm, greatest(least(half_years, {HORIZON}), 1) AS n, event = 1 AND half_years <= {HORIZON} AS e FROM u WHERE t IS NOT NULL), p AS (SELECT unnest(range({HORIZON})) AS period), h AS (
  SELECT arm, period, count(*) FILTER (e AND n - 1 = period) / count(*) AS hazard FROM n JOIN p ON n.n > period GROUP BY 1, 2), s AS (SELECT *, product(1 - hazard) OVER (PARTITION BY arm ORDER BY period) AS survival FROM h)"""
_WHOLE = f"(SELECT {_effect('y', 'w', X)} FROM u)"
_TOLD = "round(original, 5) AS original, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.975), 5) AS high"
_OUT = "original < quantile_cont(v, 0.025) OR original > quantile_cont(v, 0.975)"
_NORMAL = "(SELECT sum(exp(-0.5 * pow((i + 0.5) * z / 20000, 2))) * z / 20000 / sqrt(2 * pi()) FROM range(20000) r(i))"
_SE = f"(SELECT {_effect('y', 'w', X)} AS effect, sqrt({_left('y', ('w', *X))} / {_left('w', X)} / (count(*) - 4)) AS se, count(*) - 4 AS dof FROM u)"
SQL = {
    "s_learner": f"""WITH u AS {_U}, a AS (SELECT arm, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM u GROUP BY arm), d AS (SELECT y - my AS y, x1 - m1 AS x1, x2 - m2 AS x2 FROM u JOIN a USING (arm)), m AS (SELECT {_fit('y')} FROM d), b AS (SELECT {_B1} AS b1, {_B2} AS b2 FROM m), c AS (
  SELECT {", ".join(f"round((a{a}.my - a0.my) - b1 * (a{a}.m1 - a0.m1) - b2 * (a{a}.m2 - a0.m2), 6) AS cate_{a}" for a in (1, 2, 3))} FROM b JOIN a a0 ON a0.arm = 0 JOIN a a1 ON a1.arm = 1 JOIN a a2 ON a2.arm = 2 JOIN a a3 ON a3.arm = 3) SELECT unit_id, cate_1, cate_2, cate_3 FROM u, c""",
    "t_learner": _T, "x_learner": _T,
    "t_learner_folds": f"""WITH u AS (SELECT *, {_FOLD.format('arm')} AS fold FROM {_U}), f AS (SELECT unnest(range(3))::INT AS fold), c AS (SELECT f.fold, arm, regr_slope(y, x1) AS b1, regr_intercept(y, x1) AS b0 FROM u JOIN f ON u.fold <> f.fold GROUP BY 1, 2)
SELECT unit_id, {", ".join(f"round(k{a}.b0 + k{a}.b1 * x1 - k0.b0 - k0.b1 * x1, 6) AS cate_{a}" for a in (1, 2, 3))} FROM u {" ".join(f"JOIN c k{a} ON k{a}.arm = {a} AND k{a}.fold = u.fold" for a in range(4))}""",
    "dr_learner": f"""WITH u AS {_U}, p AS (SELECT *, {_PSI} FROM u), {", ".join(f"m{a} AS (SELECT {_fit(f'psi{a}')} FROM p), k{a} AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT *, {_B1} AS b1, {_B2} AS b2 FROM m{a}))" for a in (1, 2, 3))}
SELECT unit_id, {", ".join(f"round({_LINE.format(a)}, 6) AS cate_{a}" for a in (1, 2, 3))} FROM u, k1, k2, k3""",
    "dr_ate": f"WITH u AS {_U}, p AS (SELECT {_PSI} FROM u) " + " UNION ALL ".join(f"SELECT {a} AS arm, round(avg(psi{a}), 6) AS ate, round(stddev_samp(psi{a}) / sqrt(count(*)), 6) AS se FROM p" for a in (1, 2, 3)),
    "r_learner": f"WITH u AS {_U}, r AS (SELECT {_R}) SELECT unit_id, " + ", ".join(f"round(r{a}.b0 + r{a}.b1 * x1, 6) AS cate_{a}" for a in (1, 2, 3)) + " FROM u, r",
    "local_centering": f"WITH u AS {_U} {_CENTRE}",
    "propensity_report": f"WITH u AS {_U} " + " UNION ALL ".join(
        f"""SELECT {a} AS arm, sum(l) AS n, round(avg(p), 6) AS mean_e, round((sum(rk) FILTER (l = 1) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * (count(*) - sum(l))), 6) AS auc,
  (SELECT round(sum(n * abs(mp - ml)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(e{a}) AS mp, avg((arm = {a})::INT) AS ml FROM u GROUP BY least(floor(e{a} * 10), 9))) AS ece, round(avg((p - l) ** 2), 6) AS brier
FROM (SELECT (arm = {a})::INT AS l, e{a} AS p, rank() OVER (ORDER BY e{a}) + (count(*) OVER (PARTITION BY e{a}) - 1) / 2 AS rk FROM u)""" for a in range(4)),
    "confounding_demo": f"WITH u AS {_U}, r AS (" + " UNION ALL ".join(
        f"SELECT {a} AS arm, count(*) FILTER (arm = {a}) AS n, avg(tau{a}) AS t, avg(y) FILTER (arm = {a}) - avg(y) FILTER (arm = 0) AS d, avg(CASE WHEN arm = {a} THEN y / e{a} ELSE 0 END) - avg(CASE WHEN arm = 0 THEN y / e0 ELSE 0 END) AS i FROM u" for a in (1, 2, 3))
    + ") SELECT arm, n, round(t, 6) AS true_ate, round(d, 6) AS naive, round(i, 6) AS ipw, round(d - t, 6) AS naive_error, round(i - t, 6) AS ipw_error, sign(d) <> sign(t) AS sign_flip FROM r",
    "segment_effects": f"SELECT grp, count(*) AS n, round(avg(tau1), 6) AS tau1, round(avg(tau2), 6) AS tau2, round(avg(tau3), 6) AS tau3 FROM {_U} GROUP BY grp",
    "hazard_model": f"WITH {_HAZ} SELECT arm, period, round(hazard, 5) AS hazard, round(survival, 5) AS survival FROM s",
    "survival_uplift": f"""WITH {_HAZ}, g AS (SELECT arm, sum(survival) AS rmst, sum(survival * 1.01::DOUBLE ** -(period + 1)) AS v, 1 - max(survival) FILTER (period = 7) AS churn FROM s GROUP BY arm)
SELECT unit_id, {", ".join(f"round(g{a}.rmst - g0.rmst, 4) AS rmst_{a}, round(mu0 * g{a}.v - mu0 * g0.v, 4) AS value_{a}, round(g0.churn - g{a}.churn, 4) AS churn_{a}" for a in (1, 2, 3))} FROM u {" ".join(f"JOIN g g{a} ON g{a}.arm = {a}" for a in range(4))}""",
    "linear_effect": f"WITH u AS {_U} SELECT round(effect, 6) AS effect, round(se, 6) AS se, dof FROM {_SE}",
    "partial_linear_ate": f"""WITH u AS (SELECT *, {_FOLD.format('w')} AS fold FROM {_U}), f AS (SELECT unnest(range(3))::INT AS fold), c AS (SELECT f.fold, {", ".join(f"{_effect(v, 'x1', ('x2',))} AS {v}1, {_effect(v, 'x2', ('x1',))} AS {v}2, avg({v}) AS {v}m" for v in ("y", "w"))}, avg(x1) AS m1, avg(x2) AS m2
  FROM u JOIN f ON u.fold <> f.fold GROUP BY 1), r AS (SELECT y - ym - y1 * (x1 - m1) - y2 * (x2 - m2) AS y, w - wm - w1 * (x1 - m1) - w2 * (x2 - m2) AS w FROM u JOIN c USING (fold)), a AS (SELECT sum(w * y) / sum(w * w) AS ate FROM r)
SELECT round(any_value(ate), 6) AS ate, round(sqrt(sum((w * (y - ate * w)) ** 2)) / sum(w * w), 6) AS se, count(*) AS n FROM r, a""",
    "refute_placebo": f"""WITH u AS {_U}, s AS (SELECT unnest(range(20)) AS s), z AS (SELECT s, y, x1, x2, ({_uniform('11 + s')} < (SELECT avg(w) FROM u))::INT AS z FROM u, s), v AS (SELECT s, {_effect('y', 'z', X)} AS v FROM z GROUP BY s)
SELECT 'placebo' AS test, {_TOLD}, {_OUT} AS passed FROM v, (SELECT {_WHOLE} AS original) GROUP BY original""",
    "refute_common_cause": f"""WITH u AS {_U}, s AS (SELECT unnest(range(10)) AS s), z AS (SELECT s, y, w, x1, x2, {_uniform('12 + s')} AS z FROM u, s), v AS (SELECT s, {_effect('y', 'w', (*X, 'z'))} AS v FROM z GROUP BY s)
SELECT 'random_common_cause' AS test, {_TOLD}, avg(abs(v - original)) / greatest(abs(original), 0.05 * (SELECT stddev_samp(y) FROM u)) < 0.1 AS passed FROM v, (SELECT {_WHOLE} AS original) GROUP BY original""",
    "refute_subset": f"""WITH u AS {_U}, s AS (SELECT unnest(range(10)) AS s), z AS (SELECT s, y, w, x1, x2, {_uniform('13 + s')} AS z FROM u, s), v AS (SELECT s, {_effect('y', 'w', X, 'z < 0.7')} AS v FROM z GROUP BY s)
SELECT 'subset' AS test, {_TOLD}, NOT ({_OUT}) AS passed FROM v, (SELECT {_WHOLE} AS original) GROUP BY original""",
    "refute_confounder": f"""WITH u AS {_U}, s AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE)) t(i, s)), q AS (SELECT avg(w) AS m, stddev_pop(w) AS d, stddev_samp(y) AS sy FROM u), z AS (
  SELECT i, w, x1, x2, y + s * sy * (s * (w - m) / d + ({_uniform('14 + i')} - 0.5) * sqrt(12)) AS z FROM u, s, q), v AS (SELECT i, {_effect('z', 'w', X)} AS v FROM z GROUP BY i)
SELECT 'unobserved_confounder' AS test, {_TOLD}, bool_and(sign(v) = sign(original)) AS passed FROM v, (SELECT {_WHOLE} AS original) GROUP BY original""",
    "rosenbaum_bounds": f"""WITH u AS {_U}, k AS (SELECT w, y, row_number() OVER (PARTITION BY w ORDER BY x1, unit_id) AS r, count(*) OVER (PARTITION BY w) AS size FROM u), n AS (SELECT min(size) AS n FROM k), t AS (
  SELECT w, y, floor((r - 1) * n / size) AS pair FROM k, n WHERE r = 1 OR floor((r - 1) * n / size) <> floor((r - 2) * n / size)), d AS (SELECT a.y - b.y AS d FROM t a JOIN t b ON a.pair = b.pair AND a.w = 1 AND b.w = 0), q AS (
  SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0), g AS (SELECT unnest([1.0, 1.2, 1.5, 2.0, 3.0])::DOUBLE AS gamma), s AS (
  SELECT gamma, count(*) AS n, sum(rk) FILTER (d > 0) AS w, sum(rk) AS r1, sum(rk * rk) AS r2, gamma / (1 + gamma) AS p FROM q, g GROUP BY gamma), z AS (
  SELECT *, (w - p * r1) / sqrt(p * (1 - p) * r2) AS z_low, (w - (1 - p) * r1) / sqrt(p * (1 - p) * r2) AS z_high FROM s)
SELECT gamma, n, w AS w_plus, round(z_low, 5) AS z_low, round(z_high, 5) AS z_high, round(0.5 - {_NORMAL.replace(' z ', ' z_high ')}, 5) AS p_low, round(0.5 - {_NORMAL.replace(' z ', ' z_low ')}, 5) AS p_high FROM z""",
}
SQL["sensitivity_contour"] = f"""WITH u AS {_U}, g AS (SELECT unnest([0, 0.05, 0.1, 0.2, 0.3])::DOUBLE AS r), e AS {_SE}, x AS (SELECT a.r AS r2_y, b.r AS r2_w, effect, se * sqrt(dof) * sqrt(a.r * b.r / (1 - b.r)) AS bias FROM g a, g b, e)
SELECT r2_y, r2_w, round(bias, 6) AS bias, round(effect - sign(effect) * bias, 6) AS adjusted FROM x"""
_RV = "(sqrt({0} ** 4 + 4 * {0} ** 2) - {0} ** 2) / 2"
SQL["robustness_value"] = f"""WITH u AS {_U}, e AS {_SE}, f AS (SELECT *, abs(effect / se) / sqrt(dof) AS f, greatest(abs(effect / se) - 1.959963985::DOUBLE, 0) / sqrt(dof) AS fa FROM e)
SELECT round(effect, 5) AS effect, round(se, 5) AS se, dof, round(effect / se, 5) AS t, round({_RV.format('f')}, 5) AS robustness, round({_RV.format('fa')}, 5) AS robustness_alpha FROM f"""
SQL["sensitivity_benchmarks"] = f"WITH u AS {_U}, e AS {_SE}, r AS (" + " UNION ALL ".join(
    f"SELECT '{j}' AS feature, 1 - {_left('y', ('w', *X))} / {_left('y', ('w', k))} AS a, 1 - {_left('w', X)} / {_left('w', (k,))} AS b FROM u" for j, k in (("x1", "x2"), ("x2", "x1"))
) + """), f AS (SELECT feature, a, b, effect, se * sqrt(dof) * sqrt(a * b / (1 - b)) AS bias, (effect / se) ** 2 / dof AS f2 FROM r, e)
SELECT feature, round(a, 5) AS r2_y, round(b, 5) AS r2_w, round(bias, 5) AS bias, round(effect - sign(effect) * bias, 5) AS adjusted, bias >= abs(effect) AS nullified,
  CASE WHEN a * b > 1e-12::DOUBLE THEN round((sqrt(f2 ** 2 * b ** 2 + 4 * a * b * f2) - f2 * b) / (2 * a * b), 5) END AS multiple FROM f"""  # fmt: skip
SQL["confounder_shift"] = f"""WITH u AS {_U}, s AS (SELECT * FROM (VALUES (0, 0.25::DOUBLE), (1, 0.5::DOUBLE), (2, 1::DOUBLE)) t(i, s)), q AS (SELECT avg(w) AS m, stddev_pop(w) AS d, stddev_samp(y) AS sy FROM u), z AS (
  SELECT s, w, x1, x2, y + s * sy * (s * (w - m) / d + ({_uniform('14 + i')} - 0.5) * sqrt(12)) AS z FROM u, s, q), v AS (SELECT s, {_effect('z', 'w', X)} AS v FROM z GROUP BY s), g AS (
  SELECT s, v, v - {_WHOLE} AS shift, s * s * sy / d AS p, sy FROM v, q)
SELECT s AS strength, round(v, 5) AS effect, round(shift, 5) AS shift, round(p, 5) AS predicted, round(abs(shift - p), 5) AS gap, abs(shift - p) <= greatest(0.35 * abs(p), 0.02 * sy) AS as_predicted FROM g"""
SQL["learner_leaderboard"] = "WITH r AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS learner, (" + " + ".join(f"sqrt(avg((cate_{a} - tau{a}) ** 2))" for a in (1, 2, 3)) + ") / 3 AS pehe, (" + " + ".join(f"abs(avg(cate_{a} - tau{a}))" for a in (1, 2, 3)) + f") / 3 AS eps FROM ({SQL[q]}) c JOIN {_U} u ON u.unit_id = c.unit_id"
    for name, q in (("s", "s_learner"), ("t", "t_learner"), ("dr", "dr_learner"), ("r", "r_learner"))
) + ") SELECT learner, round(pehe, 4) AS pehe, round(eps, 4) AS eps_ate, rank() OVER (ORDER BY pehe, learner) AS rank FROM r"


SQL["refute_placebo_permuted"] = f"""WITH u AS {_U}, s AS (SELECT unnest(range(20)) AS s), r AS (SELECT s, y, x1, x2, row_number() OVER (PARTITION BY s ORDER BY {_uniform('11 + s')}, unit_id) AS r FROM u, s), z AS (
  SELECT s, y, x1, x2, (r > (SELECT count(*) FROM u WHERE w = 0))::INT AS z FROM r), v AS (SELECT s, {_effect('y', 'z', X)} AS v FROM z GROUP BY s)
SELECT 'placebo_permuted' AS test, {_TOLD}, count(*) FILTER (abs(v) >= abs(original)) / count(*) AS p_value, {_OUT} AS passed FROM v, (SELECT {_effect('y', 'w', X)} AS original FROM u) GROUP BY original"""
SQL["hodges_lehmann"] = SQL["rosenbaum_bounds"].partition(", q AS (")[0] + """, i AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM d)
SELECT (SELECT count(*) FROM i) AS n, round((SELECT avg(d) FROM i), 5) AS mean_difference, round(median((a.d + b.d) / 2), 5) AS hodges_lehmann FROM i a JOIN i b ON a.i <= b.i"""
