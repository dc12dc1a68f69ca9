"""Effects on restricted survival under censoring: doubly robust scores of every row, from nuisances of the other folds.

Censoring may depend on the features: its hazard is modelled as the outcome's is, with events ahead of censorings of
the same period, so a unit whose event comes in a period is at risk of censoring only before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .hazard import Hazard, fit_hazard
from .learners import propensity
from .linear import by_fold, design, dot, moments, out_of_fold, solve
from .survival import restricted_outcome
from .trees import fit_boosted, predict_boosted


def fit_censoring(df: DataFrame, time: str, event: str, horizon: int, x: Sequence[str], by: str | None = None, **fit) -> dict:
    """Per value of ``by`` the hazard model of censoring given the features; None for a group in which nobody is at risk."""
    whole = F.greatest(F.ceil(F.col(time) - 1e-9), F.lit(1))
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    risk = rows.withColumn("__t", F.when(F.col(event).cast("boolean"), whole - 1).otherwise(whole)).withColumn("__c", 1 - F.col(event).cast("int")).where("__t >= 1")
    return fit_hazard(risk, "__t", "__c", horizon, x, by, **fit)


def uncensored_before(model: Hazard | None, at: Column, least: float = 0.05) -> Column:
    """The probability to be uncensored until just before the period ``at`` (from 1), given the row's features, ``least`` at least."""
    if model is None:
        return F.lit(1.0)
    s = model.survival()
    g = F.when(at <= 1, F.lit(1.0)).otherwise(F.element_at(s, F.least(at - 1, F.size(s)).cast("int")))
    return F.greatest(g, F.lit(least))


def conditional_ipcw(df: DataFrame, time: str, event: str, horizon: int, x: Sequence[str], rate: float = 0.0, least: float = 0.05, model: Hazard | None = None) -> DataFrame:
    """Adds periods, follow_up, complete and value (see ``restricted_outcome``), g (uncensored until just before the follow-up's end, given the features), weight and pseudo."""
    model = model or fit_censoring(df, time, event, horizon, x).get(None)
    out = restricted_outcome(df, time, event, horizon, rate).withColumn("g", uncensored_before(model, F.col("follow_up"), least))
    return out.withColumn("weight", F.when(F.col("complete"), 1 / F.col("g")).otherwise(0.0)).withColumn("pseudo", F.col("value") * F.col("weight"))


def _promises(outcome: Mapping[int, Hazard], censoring: Mapping[int, Hazard | None], arms: int, k: int, horizon: int, names: Sequence[str], rate: float, least: float):
    """What the models of a row's fold promise it, under ``names``: per arm the mean time (see ``mean_time``) and value (``value_of``), and ``uncensored_before`` its follow-up's end; batches of rows at once."""

    def curve(model: Hazard, x: Sequence[np.ndarray], n: int) -> list[np.ndarray]:
        shift, alive, out = np.zeros(n), np.ones(n), []
        for b, c in zip(model.slopes, x, strict=True):
            shift = shift + b * c
        for level in model.levels:
            with np.errstate(over="ignore"):
                alive = alive * (1 - 1 / (1 + np.exp(-(level + shift))))
            out.append(alive)
        return out

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(fold: pd.Series, paid: pd.Series, at: pd.Series, *x: pd.Series) -> pd.DataFrame:
        out = {n: np.full(len(fold), np.nan) for n in names}
        folds = fold.to_numpy()
        for f in range(k):
            own = np.flatnonzero(folds == f)
            own_x, pays, end = [c.to_numpy(dtype=float)[own] for c in x], paid.to_numpy(dtype=float)[own], at.to_numpy(dtype=float)[own]
            for a in range(arms):
                if a * k + f in outcome:
                    alive = curve(outcome[a * k + f], own_x, len(own))
                    out[f"rmst_{a}"][own] = sum(alive[:horizon], np.zeros(len(own)))
                    out[f"worth_{a}"][own] = pays * sum((s * (1 + rate) ** -(i + 1) for i, s in enumerate(alive)), np.zeros(len(own)))
            if censoring.get(f) is None:
                out["g"][own] = 1.0
            else:
                alive = np.stack(curve(censoring[f], own_x, len(own)))
                place = np.where(np.isnan(end), horizon, np.minimum(end - 1, horizon)).astype(int)
                out["g"][own] = np.where(end <= 1, 1.0, np.maximum(alive[np.maximum(place, 1) - 1, np.arange(len(own))], least))
        return pd.DataFrame(out)

    return run


def robust_scores(df: DataFrame, time: str, event: str, arm: str, arms: int, horizon: int, x: Sequence[str], key: str, margin: Column | None = None, rate: float = 0.01, k: int = 3, least: float = 0.05, low: float = 0.01, high: float = 0.99, seed: int = 0) -> DataFrame:
    """Adds fold, e_a, g, rmst_a and worth_a (what the arm's hazards promise), and per arm but 0 psi_a and psi_value_a.

    psi is the promised difference plus, for the row's own arm, the inversely weighted error of the promise, if the row
    was followed to the end: right on average if either the hazards or propensities and censoring are. Hazards,
    censoring and propensities come from the other folds. Rows without time, event or arm get null scores.
    """
    paid = F.lit(1.0) if margin is None else margin
    rows = restricted_outcome(propensity(df, arm, x, arms, key, k, low, high, seed), time, event, horizon)
    rows = written(rows.withColumn("__paid", paid.cast("double")))  # propensities are predicted once, not for each fit
    train = written(rows.groupBy(*x, time, event, arm, "fold").agg(F.count("*").alias("__n"))).withColumn("__f", F.explode(F.array(*[F.lit(f) for f in range(k)]))).where("__f <> fold").withColumn("__g", F.col(arm) * k + F.col("__f"))
    outcome, censoring = fit_hazard(train, time, event, horizon, x, "__g", weight="__n"), fit_censoring(train, time, event, horizon, x, "__f", weight="__n")

    names = [*[f"rmst_{a}" for a in range(arms)], *[f"worth_{a}" for a in range(arms)], "g"]
    told = _promises(outcome, censoring, arms, k, horizon, names, rate, least)
    rows = rows.withColumn("__told", told("fold", "__paid", F.col("follow_up").cast("double"), *[F.col(c).cast("double") for c in x]))
    rows = rows.withColumns({n: F.col("__told")[n] for n in names}).drop("__told")
    lived = {"rmst": F.col("periods").cast("double"), "worth": F.col("__paid") * (F.col("periods").cast("double") if rate == 0 else (1 - F.pow(F.lit(1 + rate), -F.col("periods"))) / rate)}
    weight = F.when(F.col("complete"), 1 / F.col("g")).otherwise(F.when(F.col("complete").isNotNull(), 0.0))
    scores = {}
    for name, kind in (("psi", "rmst"), ("psi_value", "worth")):
        error = lambda a, kind=kind: F.when(F.col(arm) == a, weight / F.col(f"e_{a}") * (lived[kind] - F.col(f"{kind}_{a}"))).when(F.col(arm).isNotNull(), 0.0)
        scores |= {f"{name}_{a}": F.col(f"{kind}_{a}") - F.col(f"{kind}_0") + error(a) - error(0) for a in range(1, arms)}
    return rows.withColumns(scores).drop("__paid")


def second_stage(df: DataFrame, targets: Mapping[str, str], x: Sequence[str], k: int, **boost) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Adds per target column its regression on the features under the given name, by what predicts it best out of fold: its mean, a linear model or boosted trees.

    Also tells the out-of-fold mean squared errors per name. ``df`` has a column fold below ``k``.
    """
    rows, xs, names = written(df), design(x), list(targets)
    cols = [F.col(targets[n]) for n in names]
    usable = [F.col(targets[n]).isNotNull() for n in names]
    fits = [(c, (u & (F.col("fold") != f)).cast("double")) for c, u in zip(cols, usable, strict=True) for f in range(k)] + [(c, u.cast("double")) for c, u in zip(cols, usable, strict=True)]
    model = fit_boosted(rows, x, [t for t, _ in fits], [w for _, w in fits], **boost)
    # slots are numbered fold first; the whole fits follow
    judged = predict_boosted(rows.select(*dict.fromkeys([*x, "fold", *targets.values()])), model, [f"__t_{n}" for n in names], F.col("fold"), k)
    linear, whole = {}, {}
    for n, c in zip(names, cols, strict=True):
        parts = {("all", f): m for (f,), m in moments(rows, xs, [c], [F.col("fold")]).items()}
        linear[n] = out_of_fold(parts, "all", k) if parts else [np.zeros(len(xs))] * k
        whole[n] = solve(sum(p[0] for p in parts.values()), sum(p[1] for p in parts.values()))[:, 0] if parts else np.zeros(len(xs))
    errors = []
    sums = rows.groupBy("fold").agg(*[f(c).alias(f"{m}{i}") for i, c in enumerate(cols) for m, f in (("s", F.sum), ("n", F.count))]).collect()
    mean = {n: [(sum(r[f"s{i}"] or 0.0 for r in sums if r["fold"] != f), sum(r[f"n{i}"] for r in sums if r["fold"] != f)) for f in range(k)] for i, n in enumerate(names)}
    for n, c in zip(names, cols, strict=True):
        constant = by_fold([[s / max(1, m), *[0.0] * len(x)] for s, m in mean[n]], xs, F.col("fold"))
        for kind, p in (("mean", constant), ("linear", by_fold(linear[n], xs, F.col("fold"))), ("trees", F.col(f"__t_{n}"))):
            errors.append(F.avg(F.pow(c - p, 2)).alias(f"{kind}|{n}"))
    got = judged.agg(*errors).first().asDict()
    told = {n: {kind: got[f"{kind}|{n}"] for kind in ("mean", "linear", "trees")} for n in names}
    best = {n: min(("mean", "linear", "trees"), key=lambda kind: (told[n][kind] is None, told[n][kind])) for n in names}
    full = rows
    if "trees" in best.values():
        full = predict_boosted(rows, type(model)(model.x, model.edges, model.first[len(names) * k :], [(_part(t, len(names) * k), v[len(names) * k :]) for t, v in model.rounds]), [f"__w_{n}" for n in names])
    out = {}
    for i, n in enumerate(names):
        total = sum(r[f"s{i}"] or 0.0 for r in sums) / max(1, sum(r[f"n{i}"] for r in sums))
        out[n] = {"mean": F.lit(float(total)), "linear": dot(whole[n], xs), "trees": F.col(f"__w_{n}")}[best[n]]
    return full.withColumns(out).drop(*[f"__w_{n}" for n in names]), told


def _part(trees, begin: int):
    return type(trees)(trees.depth, trees.feature[begin:], trees.cut[begin:], trees.gain[begin:], trees.sums[begin:])


def robust_uplift(df: DataFrame, time: str, event: str, arm: str, arms: int, horizon: int, x: Sequence[str], key: str, margin: Column | None = None, rate: float = 0.01, k: int = 3, seed: int = 0, **boost) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Adds to the scores per arm but 0 cate_a (periods of life gained) and cate_value_a (discounted margin gained), and tells the second stages' errors."""
    scored = robust_scores(df, time, event, arm, arms, horizon, x, key, margin, rate, k, seed=seed)
    targets = {f"cate_{a}": f"psi_{a}" for a in range(1, arms)} | {f"cate_value_{a}": f"psi_value_{a}" for a in range(1, arms)}
    return second_stage(scored, targets, x, k, **boost)
