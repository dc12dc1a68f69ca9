"""Discrete-time hazards, the survival curves they make, and effects on survival."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import dot, solve
from .survival import person_period


@dataclass(frozen=True)
class Hazard:
    """A pooled logistic hazard: a level per period and linear terms of the features."""

    levels: np.ndarray
    slopes: np.ndarray
    x: tuple[str, ...]

    def hazard(self) -> Column:
        """The hazards of all periods as an array."""
        shift = dot(self.slopes, [F.col(c) for c in self.x])
        return F.transform(F.array(*[F.lit(float(a)) for a in self.levels]), lambda a: 1 / (1 + F.exp(-(a + shift))))

    def survival(self) -> Column:
        """The probabilities to survive each period, never rising."""
        return survival_of(self.hazard())


def fit_hazard(df: DataFrame, time: str, event: str, horizon: int, x: Sequence[str] = (), by: str | None = None, l2: float = 1e-6, rounds: int = 30, tol: float = 1e-9, weight: str | None = None) -> dict:
    """Per value of ``by`` (few; one entry None without) the model fitted on a row per unit and period lived, by Newton's method.

    Units that agree in group, time, event and features are counted before they become rows per period, and rows that
    agree in group, period and features before the first round. ``weight``: how many units a row stands for. A round is one aggregate
    per group and period: levels meet in no row, so their part of the second derivatives is diagonal. Periods without
    an event have hazard 0, those that nobody outlives hazard 1, whatever the features. It ends with steps below ``tol``.
    """
    p = len(x)
    xs = [F.col(f"x{i}") for i in range(p)]
    units = df.select((F.col(by) if by else F.lit(0)).alias("g"), F.ceil(F.col(time) - 1e-9).alias("t"), F.col(event).cast("boolean").alias("e"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)])
    units = units.groupBy("g", "t", "e", *xs).agg(F.sum("w").alias("w"))
    rows = person_period(units, "t", "e", horizon, ["g", "w", *[f"x{i}" for i in range(p)]]).dropna()
    cells = rows.groupBy("g", "period", *xs).agg(F.sum("w").alias("n"), F.sum(F.col("event") * F.col("w")).alias("d")).persist()
    start = cells.groupBy("g", "period").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect()
    beta = {g: np.zeros(horizon + p) for g in sorted({r.g for r in start})}
    for g, b in beta.items():
        b[:horizon] = -30.0  # nobody is left then
    for r in start:
        beta[r.g][r.period] = -30.0 if r.d == 0 else 30.0 if r.d == r.n else np.log((r.d + 0.5) / (r.n - r.d + 0.5))
    seen = {(r.g, r.period) for r in start if 0 < r.d < r.n}
    kind = dict(rows.dtypes)["g"]
    for _ in range(rounds):
        now = df.sparkSession.createDataFrame([(g, k, float(b[k]), [float(v) for v in b[horizon:]]) for g, b in beta.items() for k in range(horizon) if (g, k) in seen], f"g {kind}, period int, level double, slopes array<double>")
        z = F.col("level")
        for i, c in enumerate(xs):
            z = z + F.col("slopes")[i] * c
        h = F.col("n") / (1 + F.exp(-z))
        scored = cells.join(F.broadcast(now), ["g", "period"]).withColumn("e", F.col("d") - h).withColumn("v", h * (1 - h / F.col("n")))
        terms = [F.sum("e").alias("e"), F.sum("v").alias("v"), *[F.sum(F.col("e") * c).alias(f"e{i}") for i, c in enumerate(xs)], *[F.sum(F.col("v") * c).alias(f"v{i}") for i, c in enumerate(xs)]]
        terms += [F.sum(F.col("v") * xs[i] * xs[j]).alias(f"v{i}_{j}") for i in range(p) for j in range(i, p)]
        ridge = np.array([0.0] * horizon + [l2] * p)  # levels are determined by their own events
        gradient, hessian = {g: -ridge * b for g, b in beta.items()}, {g: np.diag(ridge) for g in beta}
        for r in scored.groupBy("g", "period").agg(*terms).collect():
            gradient[r.g][r.period] += r.e
            hessian[r.g][r.period, r.period] += r.v
            for i in range(p):
                gradient[r.g][horizon + i] += r[f"e{i}"]
                hessian[r.g][r.period, horizon + i] += r[f"v{i}"]
                hessian[r.g][horizon + i, r.period] += r[f"v{i}"]
                for j in range(i, p):
                    hessian[r.g][horizon + i, horizon + j] += r[f"v{i}_{j}"]
                    hessian[r.g][horizon + j, horizon + i] = hessian[r.g][horizon + i, horizon + j]
        largest = 0.0
        for g, b in beta.items():
            own = [*[k for k in range(horizon) if (g, k) in seen], *range(horizon, horizon + p)]
            step = np.clip(solve(hessian[g][np.ix_(own, own)], gradient[g][own]), -3, 3) if own else np.zeros(0)
            b[own] += step
            largest = max(largest, float(np.abs(step).max(initial=0.0)))
        if largest < tol:
            break
    cells.unpersist()
    return {(g if by else None): Hazard(b[:horizon], b[horizon:], tuple(x)) for g, b in beta.items()}


def survival_of(hazard: Column) -> Column:
    """Running products of 1 - h as an array."""
    step = lambda s, h: F.concat(s, F.array(F.element_at(s, -1) * (1 - h)))
    whole = F.aggregate(hazard, F.array(F.lit(1.0)), step)
    return F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0)))


def falling(curve: Column) -> Column:
    """A curve whose values never rise and lie between 0 and 1: each is the least so far."""
    step = lambda s, v: F.concat(s, F.array(F.least(F.element_at(s, -1), F.greatest(v, F.lit(0.0)))))
    whole = F.aggregate(curve, F.array(F.lit(1.0)), step)
    return F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0)))


def mean_time(curve: Column, horizon: float) -> Column:
    """The restricted mean survival time: the sum of the curve up to the horizon, a part of a period counting in part."""
    whole = int(horizon)
    total = F.aggregate(F.slice(curve, 1, whole) if whole else F.array().cast("array<double>"), F.lit(0.0), lambda a, b: a + b)
    return total if horizon == whole else total + (horizon - whole) * F.coalesce(F.try_element_at(curve, F.lit(max(whole, 1))), F.lit(0.0))


def churn_probability(curve: Column, within: int = 1) -> Column:
    return 1 - F.element_at(curve, F.least(F.greatest(F.lit(within), F.lit(1)), F.size(curve)))


def value_of(curve: Column, margin: Column, rate: float = 0.01) -> Column:
    """The value of a survival curve: the margin of each period lived, discounted."""
    held = F.transform(curve, lambda s: F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    return margin * F.aggregate(F.transform(held, lambda s, i: s * F.pow(F.lit(1 + rate), -(i + 1))), F.lit(0.0), lambda a, b: a + b)


def survival_effects(df: DataFrame, time: str, event: str, arm: str, horizon: int, x: Sequence[str] = (), margin: Column | None = None, rate: float = 0.01, within: int = 1) -> DataFrame:
    """Adds per arm but 0 rmst_a, value_a and churn_a: what the arm's own hazard model promises beyond that of arm 0."""
    models = fit_hazard(df, time, event, horizon, x, arm)
    out = df.withColumns({f"__s{a}": m.survival() for a, m in models.items()})
    columns, paid = {}, F.lit(1.0) if margin is None else margin
    for a in sorted(models):
        if a != 0:
            s, s0 = F.col(f"__s{a}"), F.col("__s0")
            columns |= {f"rmst_{a}": mean_time(s, horizon) - mean_time(s0, horizon), f"value_{a}": value_of(s, paid, rate) - value_of(s0, paid, rate), f"churn_{a}": churn_probability(s0, within) - churn_probability(s, within)}
    return out.withColumns(columns).drop(*[f"__s{a}" for a in models])
