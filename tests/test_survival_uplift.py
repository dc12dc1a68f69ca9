"""Doubly robust effects on survival against numpy fits and on simulated censoring."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayflow.operators import survival, survival_uplift

H = 6


def simulated(n=2500, seed=0):
    """Monthly hazards by arm and x; censoring depends on x, the arm on z."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    w = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    h = lambda a: 1 / (1 + np.exp(-(-1.0 + 0.8 * z - a * (0.4 + 0.8 * (x > 0)))))
    die = rng.geometric(h(w))
    leave = rng.geometric(1 / (1 + np.exp(-(-2.2 + 0.9 * x))))
    t, e = np.minimum(die, leave), (die <= leave).astype(int)
    rmst = lambda a: sum((1 - h(a)) ** k for k in range(1, H + 1))
    return pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "w": w, "t": t.astype(float), "e": e, "tau": rmst(1) - rmst(0), "lived": np.minimum(die - 1, H)})


def logistic_hazard(t, e, x, horizon):
    """Newton's method on the rows of units and periods themselves."""
    rows, target = [], []
    for ti, ei, xi in zip(t, e, x, strict=True):
        for k in range(min(int(ti), horizon)):
            rows.append(np.concatenate([np.eye(horizon)[k], xi]))
            target.append(float(ei and k == ti - 1))
    m, y = np.array(rows), np.array(target)
    b = np.zeros(m.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        b += np.clip(np.linalg.lstsq((m * (p * (1 - p))[:, None]).T @ m + 1e-9 * np.eye(len(b)), m.T @ (y - p), rcond=None)[0], -2, 2)
    return lambda xi: np.cumprod(1 - 1 / (1 + np.exp(-(b[:horizon] + xi @ b[horizon:]))))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(simulated()).repartition(3)


@pytest.fixture(scope="module")
def scored(rows):
    out = survival_uplift.robust_scores(rows, "t", "e", "w", 2, H, ["x", "z"], "id", F.lit(2.0), 0.01, 2)
    return out.toPandas().sort_values("id").reset_index(drop=True)


def test_scores_equal_brute_force_per_row(scored):
    d = scored
    for f in (0, 1):
        other, own = d[d.fold != f], d[d.fold == f].head(60)
        curves = {a: logistic_hazard(*(other[other.w == a][c].to_numpy() for c in "te"), other[other.w == a][["x", "z"]].to_numpy(), H) for a in (0, 1)}
        at_risk = other[(other.e == 0) | (other.t > 1)]
        g = logistic_hazard(np.where(at_risk.e == 1, at_risk.t - 1, at_risk.t), 1 - at_risk.e.to_numpy(), at_risk[["x", "z"]].to_numpy(), H)
        for r in own.itertuples():
            xi = np.array([r.x, r.z])
            s = {a: curves[a](xi) for a in (0, 1)}
            end = int(min(r.t, H))
            before = 1.0 if end == 1 else max(0.05, g(xi)[end - 2])
            assert r.g == pytest.approx(before, abs=1e-4)
            lived = min(r.t - r.e, H)
            weight = (r.e == 1 or r.t >= H) / before
            for name, per, factor in (("psi_1", np.ones(H), 1.0), ("psi_value_1", 1.01 ** -np.arange(1, H + 1.0), 2.0)):
                m = {a: factor * (s[a] * per).sum() for a in (0, 1)}
                got = factor * per[: int(lived)].sum()
                e = (r.e_0, r.e_1)[r.w]
                want = m[1] - m[0] + (1 if r.w else -1) * weight / e * (got - m[r.w])
                assert getattr(r, name) == pytest.approx(want, abs=2e-3)


def test_scores_are_right_on_average_despite_censoring_and_confounding(scored):
    truth, naive = scored.tau.mean(), scored.lived[scored.w == 1].mean() - scored.lived[scored.w == 0].mean()
    assert abs(naive - truth) > 0.4
    assert abs(scored.psi_1.mean() - truth) < 4 * scored.psi_1.std() / np.sqrt(len(scored)) and abs(scored.psi_1.mean() - truth) < abs(naive - truth) / 2


def test_second_stage_takes_what_predicts_best(spark, scored):
    df = spark.createDataFrame(scored[["id", "fold", "x", "z", "tau"]]).withColumns({"line": F.col("x") * 2 - F.col("z"), "step": (F.col("x") > 0).cast("double") * (F.col("z") > 0).cast("double"), "noise": F.pmod(F.xxhash64("id"), F.lit(1009)).cast("double"), "noise2": F.pmod(F.xxhash64("id", "fold"), F.lit(1009)).cast("double")})
    out, told = survival_uplift.second_stage(df, {"p_line": "line", "p_step": "step", "p_noise": "noise", "p_noise2": "noise2"}, ["x", "z"], 2, rounds=8, depth=2, bins=16)
    best = {n: min(v, key=v.get) for n, v in told.items()}
    assert best["p_line"] == "linear" and best["p_step"] == "trees" and all(0.985 * told[n]["mean"] < told[n]["trees"] for n in ("p_noise", "p_noise2"))
    got = out.toPandas()
    assert np.allclose(got.p_line, got.line) and np.corrcoef(got.p_step, got.step)[0, 1] > 0.9


def test_uplift_beats_a_constant(rows):
    out, _ = survival_uplift.robust_uplift(rows, "t", "e", "w", 2, H, ["x", "z"], "id", k=2, rounds=4, depth=2, bins=8)
    got = out.toPandas()
    assert len(got) == 2500 and np.corrcoef(got.cate_1, got.tau)[0, 1] > 0.4


def test_censoring_given_features(spark, rows):
    """Equals the curve for all where nothing depends on the features, and differs where it does; Brier and AUC take it."""
    d = rows.withColumn("one", F.lit(0.0))
    flat = survival_uplift.conditional_ipcw(d, "t", "e", H, ["one"]).toPandas()
    t, e = (rows.toPandas()[c].to_numpy() for c in "te")
    g, curve = 1.0, [1.0]
    for k in range(1, H):
        g *= 1 - ((t == k) & (e == 0)).sum() / ((t > k) | ((t == k) & (e == 0))).sum()
        curve.append(g)
    assert np.allclose(flat.g, [curve[int(k) - 1] for k in flat.follow_up], atol=1e-6)
    assert np.allclose(flat.weight, np.where(flat.complete, 1 / flat.g, 0))
    m = survival_uplift.fit_censoring(rows, "t", "e", H, ["x"])[None]
    assert m.slopes[0] == pytest.approx(0.9, abs=0.15)
    own = rows.withColumns({"gb": survival_uplift.uncensored_before(m, F.least(F.col("t"), F.lit(float(H)))), "risk": F.col("z")})
    auc = survival.time_dependent_auc(own, "t", "e", "risk", [3.0], before=F.col("gb")).first()
    p = own.toPandas()
    case, control = p[(p.t <= 3) & (p.e == 1)], p[p.t > 3]
    won = ((case.risk.to_numpy()[:, None] > control.risk.to_numpy()[None, :]) / case.gb.to_numpy()[:, None]).sum() / ((1 / case.gb).sum() * len(control))
    assert auc.auc == pytest.approx(won)
    b = survival.brier(own, "t", "e", F.lit(0.6), [3.0], before=F.col("gb"), at=survival_uplift.uncensored_before(m, F.col("tau") + 1)).first()
    at = p.merge(rows.select("id", survival_uplift.uncensored_before(m, F.lit(4.0)).alias("ga")).toPandas(), on="id").ga
    assert b.brier == pytest.approx(np.mean(np.where((p.t <= 3) & (p.e == 1), 0.36 / p.gb, np.where(p.t > 3, 0.16 / at, 0))))
