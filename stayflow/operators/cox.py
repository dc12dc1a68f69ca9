"""Cox's proportional hazards by Efron's partial likelihood, and the survival curves that follow."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running

from .linear import dot, solve

#: Events at one time whose terms one row sums.
STEP = 4096


@dataclass(frozen=True)
class Cox:
    """Log hazard ratios of the features, relative to the mean unit, whose hazard is ``baseline`` (t, hazard, cumhaz)."""

    coef: np.ndarray
    mean: np.ndarray
    x: tuple[str, ...]
    log_likelihood: float
    baseline: DataFrame

    def risk(self) -> Column:
        """The unit's hazard ratio to the mean unit."""
        return F.exp(dot(self.coef, [F.col(c) - F.lit(float(m)) for c, m in zip(self.x, self.mean, strict=True)]))

    def survival(self, times: Sequence[float]) -> Column:
        """The probabilities to survive the given times, as an array."""
        so_far = self.baseline.agg(*[F.coalesce(F.sum(F.when(F.col("t") <= float(t), F.col("hazard"))), F.lit(0.0)) for t in times]).first()
        return F.transform(F.array(*[F.lit(float(h)) for h in so_far]), lambda h: F.exp(-h * self.risk()))


def fit_cox(df: DataFrame, time: str, event: str, x: Sequence[str], l2: float = 1e-3, rounds: int = 20, tol: float = 1e-8) -> Cox:
    """The coefficients that maximise Efron's partial likelihood per unit less l2 / 2 times their squares, by Newton's method.

    The penalty applies to features of mean 0 and deviation 1; coefficients are given on the original scale. Rows with
    a null take no part; without any event all coefficients are 0. A round sums the units by time, adds up the sums of later times
    (running sums over ranges of times, so times may be continuous), and takes one aggregate over the times of events.
    Of d events at one time the i-th sees all units at risk less i / d of the d; only sums of reciprocals depend on i,
    and rows of STEP events share these.
    """
    p = len(x)
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    scale = rows.agg(F.count("*").alias("n"), *[f(f"x{i}") for i in range(p) for f in (F.avg, F.stddev_pop)]).first()
    n = max(1, scale[0])
    mean = np.array([v or 0.0 for v in scale[1::2]])
    deviation = np.array([v or 1.0 for v in scale[2::2]])
    rows = rows.select("t", "e", *[((F.col(f"x{i}") - float(mean[i])) / float(deviation[i])).alias(f"x{i}") for i in range(p)]).persist()
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def at_risk(beta: np.ndarray) -> DataFrame:
        """Per time of events: d, the events' sums, and sums over all units still at risk (s) and over the events (e) weighted by their risks."""
        moments = {"0": F.lit(1.0), **{f"_{i}": F.col(f"x{i}") for i in range(p)}, **{f"_{i}_{j}": F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        own = rows.withColumn("r", F.exp(dot(beta, [F.col(f"x{i}") for i in range(p)])))
        sums = own.groupBy("t").agg(
            F.sum("e").alias("d"), *[F.sum(F.col("e") * F.col(f"x{i}")).alias(f"d_{i}") for i in range(p)],
            *[F.sum(F.col("r") * m).alias(f"a{k}") for k, m in moments.items()], *[F.sum(F.col("r") * F.col("e") * m).alias(f"e{k}") for k, m in moments.items()],
        )
        return running(sums, -F.col("t"), [], {f"s{k}": F.col(f"a{k}") for k in moments}, "__rn").where("d > 0")

    def round_of(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d, s0, e0 = F.col("d"), F.col("s0"), F.col("e0")
        some = at_risk(beta).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), d - 1, F.lit(STEP).cast("long"))))
        left = F.transform(F.sequence("lo", F.least(F.col("lo") + STEP - 1, d - 1)), lambda i: s0 - i / d * e0)
        total = lambda of: F.aggregate(F.col("left"), F.lit(0.0), lambda acc, v: acc + of(v))
        some = some.withColumn("left", left).withColumns({"k": F.size("left"), "l": total(F.log), "r1": total(lambda v: 1 / v), "r2": total(lambda v: 1 / (v * v))})
        # the weighted mean of those at risk is a + b / left for each event
        some = some.withColumns({f"a_{i}": F.col(f"e_{i}") / e0 for i in range(p)})
        some = some.withColumns({f"b_{i}": F.col(f"s_{i}") - s0 * F.col(f"a_{i}") for i in range(p)})
        k, r1, r2 = F.col("k"), F.col("r1"), F.col("r2")
        a, b = [F.col(f"a_{i}") for i in range(p)], [F.col(f"b_{i}") for i in range(p)]
        once = F.when(F.col("lo") == 0, 1.0).otherwise(0.0)
        terms = [F.sum(once * dot(beta, [F.col(f"d_{i}") for i in range(p)]) - F.col("l"))]
        terms += [F.sum(once * F.col(f"d_{i}") - k * a[i] - b[i] * r1) for i in range(p)]
        for i, j in pairs:
            share = F.col(f"e_{i}_{j}") / e0
            second = k * share + (F.col(f"s_{i}_{j}") - s0 * share) * r1
            terms.append(F.sum(second - k * a[i] * a[j] - (a[i] * b[j] + b[i] * a[j]) * r1 - b[i] * b[j] * r2))
        got = [float(v or 0.0) for v in some.agg(*[t.alias(f"v{q}") for q, t in enumerate(terms)]).first()]
        hessian = np.zeros((p, p))
        for (i, j), v in zip(pairs, got[1 + p :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        return got[0], np.array(got[1 : 1 + p]), hessian

    beta, likelihood = np.zeros(p), 0.0
    for _ in range(rounds):
        likelihood, gradient, hessian = round_of(beta)
        slope = gradient / n - l2 * beta
        if np.abs(slope).max(initial=0.0) < tol:
            break
        beta = beta + np.clip(solve(hessian / n + l2 * np.eye(p), slope), -3, 3)
    hazards = at_risk(beta).select("t", (F.col("d") / F.col("s0")).alias("hazard"))
    baseline = running(hazards, F.col("t"), [], {"cumhaz": F.col("hazard")}, "__rn").select("t", "hazard", "cumhaz")
    return Cox(beta / deviation, mean, tuple(x), likelihood, baseline)
