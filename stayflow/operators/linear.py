"""Linear and logistic regressions from sums that Spark aggregates: only matrices of features by features reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, x: Sequence[Column], y: Sequence[Column], by: Sequence[Column] = (), weight: Column | None = None) -> dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group (X'WX, X'WY, Y'WY) in one aggregate; rows with a null in x or y take no part.

    The number of groups must be small: a few arms and folds.
    """
    keys = [b.alias(f"__g{i}") for i, b in enumerate(by)]
    xs, ys = [c.cast("double").alias(f"__x{i}") for i, c in enumerate(x)], [c.cast("double").alias(f"__y{i}") for i, c in enumerate(y)]
    rows = df.select(*keys, *xs, *ys, (F.lit(1.0) if weight is None else weight.cast("double")).alias("__w")).dropna(subset=[f"__x{i}" for i in range(len(x))] + [f"__y{i}" for i in range(len(y))])
    names = [f"__x{i}" for i in range(len(x))] + [f"__y{i}" for i in range(len(y))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.groupBy(*[f"__g{i}" for i in range(len(by))]).agg(*[F.sum(F.col("__w") * F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    out, p = {}, len(x)
    for r in got:
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[tuple(r[f"__g{i}"] for i in range(len(by)))] = (m[:p, :p], m[:p, p:], m[p:, p:])
    return out


def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Coefficients of the normal equations; columns are scaled first, and what they do not determine is 0."""
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.lstsq(gram / scale[:, None] / scale[None, :], cross / (scale[:, None] if cross.ndim == 2 else scale), rcond=1e-12)[0] / (scale[:, None] if cross.ndim == 2 else scale)


def design(x: Sequence[str]) -> list[Column]:
    """A one and the features."""
    return [F.lit(1.0), *[F.col(c) for c in x]]


def dot(coefficients: Sequence[float], x: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for b, c in zip(coefficients, x, strict=True):
        out = out + F.lit(float(b)) * c
    return out


def by_fold(per_fold: Sequence[Sequence[float]], x: Sequence[Column], fold: Column) -> Column:
    """The prediction of the fold's own coefficients."""
    out = F.lit(None).cast("double")
    for k, b in enumerate(per_fold):
        out = F.when(fold == k, dot(b, x)).otherwise(out)
    return out


def out_of_fold(parts: dict[tuple, tuple], arm, k: int) -> list[np.ndarray]:
    """Per fold the coefficients fitted on an arm's other folds: moments are sums, so those are the whole less the fold's."""
    own = [parts.get((arm, f)) for f in range(k)]
    whole = [sum(p[i] for p in own if p is not None) for i in (0, 1)]
    return [solve(whole[0] - (p[0] if p is not None else 0), whole[1] - (p[1] if p is not None else 0))[:, 0] for p in own]


def logistic(df: DataFrame, x: Sequence[Column], y: Sequence[Column], by: Column | None = None, l2: float = 1e-6, rounds: int = 25, tol: float = 1e-8) -> dict:
    """Per group the coefficients (outcomes x features) of logistic regressions of the 0/1 outcomes by Newton's method.

    A round is one aggregate for all groups and outcomes. ``l2`` keeps coefficients finite where a feature decides.
    """
    p, m = len(x), len(y)
    rows = df.select((by if by is not None else F.lit(0)).alias("__g"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(x)], *[c.cast("double").alias(f"__y{i}") for i, c in enumerate(y)])
    rows = rows.dropna()
    xs = [F.col(f"__x{i}") for i in range(p)]
    beta = {r["__g"]: np.zeros((m, p)) for r in rows.select("__g").distinct().collect()}
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(rounds):
        probability = []
        for k in range(m):
            z = F.lit(0.0)
            for g, b in beta.items():
                z = F.when(F.col("__g").eqNullSafe(F.lit(g)), dot(b[k], xs)).otherwise(z)
            probability.append((1 / (1 + F.exp(-z))).alias(f"__p{k}"))
        scored = rows.select("*", *probability)
        sums = []
        for k in range(m):
            e, v = F.col(f"__y{k}") - F.col(f"__p{k}"), F.col(f"__p{k}") * (1 - F.col(f"__p{k}"))
            sums += [F.sum(e * c).alias(f"g{k}_{i}") for i, c in enumerate(xs)] + [F.sum(v * xs[i] * xs[j]).alias(f"h{k}_{i}_{j}") for i, j in pairs]
        largest = 0.0
        for r in scored.groupBy("__g").agg(*sums).collect():
            for k in range(m):
                gradient = np.array([r[f"g{k}_{i}"] for i in range(p)]) - l2 * beta[r["__g"]][k]
                hessian = np.zeros((p, p))
                for i, j in pairs:
                    hessian[i, j] = hessian[j, i] = r[f"h{k}_{i}_{j}"]
                step = solve(hessian + l2 * np.eye(p), gradient)
                beta[r["__g"]][k] += np.clip(step, -5, 5)
                largest = max(largest, float(np.abs(step).max()))
        if largest < tol:
            break
    return beta
