"""Scalar expressions of the domain."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    """``x`` held within bounds; null stays null, which least and greatest alone would turn into a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def annuity(periods: Column, rate: float) -> Column:
    """The sum of (1 + rate) ** -k for k = 1..periods."""
    return periods.cast("double") if rate == 0 else (1 - F.pow(F.lit(1 + rate), -periods)) / rate


def discount_factors(horizon: int, rate: float, first: int = 1) -> Column:
    """(1 + rate) ** -k for k = first..first + horizon - 1 as an array."""
    return F.transform(F.sequence(F.lit(first), F.lit(first + horizon - 1)), lambda k: F.pow(F.lit(1 + rate), -k))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def first_argmax(values: Column) -> Column:
    """The index from 0 of the largest value, NaN and null counting as lowest; the first of equal ones."""
    clean = F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(float("-inf"))).otherwise(v))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def scaled_to_simplex(p: np.ndarray, low: float, high: float, rounds: int = 60) -> np.ndarray:
    """Rows of probabilities scaled by one factor each, held within [low, high], with sum 1: the factors are found by bisection."""

    def held(s: np.ndarray) -> np.ndarray:
        z = p * s[:, None]
        return np.where(np.isnan(z), high, np.minimum(np.maximum(z, low), high))

    least = np.where(p > 0, p, np.inf).min(axis=1, initial=np.inf)
    lo, hi = np.zeros(len(p)), high / np.maximum(np.where(np.isinf(least), 0.0, least), 1e-12)
    for _ in range(rounds):
        mid, total = (lo + hi) / 2, np.zeros(len(p))
        for column in held(mid).T:
            total = total + column
        lo, hi = np.where(total < 1, mid, lo), np.where(total < 1, hi, mid)
    return held((lo + hi) / 2)


def clip_to_simplex(p: Column, low: float, high: float, rounds: int = 60) -> Column:
    """``scaled_to_simplex`` of an array column, a batch of rows at a time; a missing probability counts as 0.

    As nested array functions the bisection would be evaluated again for every element and every use of the result.
    """

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = np.empty(len(rows), dtype=object)
        sizes = np.array([-1 if r is None else len(r) for r in rows], dtype=int)
        for n in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == n)
            found = scaled_to_simplex(np.array([rows.iat[i] for i in at], dtype=float).reshape(len(at), n), low, high, rounds)
            for i, r in zip(at, found, strict=True):
                out[i] = r
        return pd.Series(out)

    return run(F.transform(p, lambda v: F.coalesce(v, F.lit(0.0))))


def expected_costs(costs: Sequence[float], redemption: Sequence[float], fixed: float = 0.0) -> list[float]:
    """Per arm cost times redemption plus the fixed cost of a contact; nothing for the control arm.

    Products are those of the decimals written, 12 * 0.62 = 7.44: a last binary digit would decide ties between arms.
    """
    exact = [Decimal(repr(float(c))) * Decimal(repr(float(r))) + Decimal(repr(float(fixed))) for c, r in zip(costs[1:], redemption[1:], strict=True)]
    return [0.0, *(float(v) for v in exact)]


def average_rank(order: Column, within: list[Column]) -> Column:
    """The mean rank from 1 of ties in ascending order within groups."""
    from pyspark.sql import Window

    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*within, order)) - 1) / 2
