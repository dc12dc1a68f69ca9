"""Customer lifetime value from purchase histories: the BG/NBD model of purchases and the gamma-gamma model of spending.

Fader, Hardie & Lee, "Counting Your Customers the Easy Way" (Marketing Science 2005) and Fader & Hardie's note on the
gamma-gamma model. A likelihood is a sum over customers, so one aggregate gives it for many parameters at once; Newton
steps on the logarithms of the parameters take their derivatives from differences of such sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The step of differences in a parameter's logarithm.
STEP = 1e-3


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift + np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1, z)
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def hypergeometric(a: np.ndarray, b, c, z: np.ndarray, terms: int = 2000) -> np.ndarray:
    """Gauss's 2F1 for 0 <= z < 1 by its series."""
    total = term = np.ones_like(z)
    for n in range(terms):
        term = term * (a + n) * (b + n) / ((c + n) * (n + 1)) * z
        total = total + term
        if not (np.abs(term) > 1e-12 * np.abs(total)).any():
            break
    return total


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x and the place of each element among them: frequencies are few, so gamma functions are worked out for these alone."""
    return np.unique(x, return_inverse=True)


def purchase_likelihood(theta: np.ndarray, x: np.ndarray, recency: np.ndarray, age: np.ndarray, known: tuple | None = None) -> np.ndarray:
    """The log likelihood of each customer under (r, alpha, a, b); ``known`` is ``distinct(x)``."""
    r, alpha, a, b = theta
    u, at = distinct(x) if known is None else known
    common = (log_gamma(r + u) - log_gamma(r) + r * np.log(alpha) + log_gamma(a + b) + log_gamma(b + u) - log_gamma(b) - log_gamma(a + b + u))[at]
    alive = -(r + x) * np.log(alpha + age)
    gone = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + recency), -np.inf)
    return common + np.logaddexp(alive, gone)


def spend_likelihood(theta: np.ndarray, x: np.ndarray, mean: np.ndarray, known: tuple | None = None) -> np.ndarray:
    """The log likelihood of each customer's mean spend under (p, q, v), of those who bought again; ``known`` is ``distinct(x)``."""
    p, q, v = theta
    u, at = distinct(x) if known is None else known
    u = np.where(u > 0, u, 1.0)
    common = (log_gamma(p * u + q) - log_gamma(p * u) - log_gamma(q) + q * np.log(v) + p * u * np.log(u))[at]
    some = (x > 0) & (mean > 0)
    x, mean = np.where(some, x, 1.0), np.where(some, mean, 1.0)
    own = common + (p * x - 1) * np.log(mean) - (p * x + q) * np.log(v + mean * x)
    return np.where(some, own, 0.0)


def _sums(df: DataFrame, columns: Sequence[str], likelihood: Callable, thetas: np.ndarray) -> np.ndarray:
    """The log likelihood of all rows under each parameter vector: a task's sums are one row, which the driver adds up; ``columns`` begins with the frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(thetas))
        for batch in batches:
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            known = distinct(values[0])
            total += [float(likelihood(t, *values, known).sum()) for t in thetas]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    rows = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(run, "v array<double>").collect()
    return np.sum([r.v for r in rows], axis=0) if rows else np.zeros(len(thetas))


def maximise(df: DataFrame, columns: Sequence[str], likelihood: Callable, start: Sequence[float], penalty: float = 1e-4, rounds: int = 40) -> np.ndarray:
    """The positive parameters of the largest likelihood per row less ``penalty`` times their squares, by damped Newton steps on logarithms."""
    # every round passes over these rows, so they lie in no more parts than there are cores
    rows = df.select(*columns).dropna().coalesce(df.sparkSession.sparkContext.defaultParallelism).persist()
    n = max(1, rows.count())
    value = lambda logs: _sums(rows, columns, likelihood, np.exp(logs)) / n - penalty * np.exp(2 * logs).sum(axis=1)
    at, k = np.log(np.array(start, dtype=float)), len(start)
    eye = np.eye(k) * STEP
    pairs = [(i, j) for i in range(k) for j in range(i)]
    for _ in range(rounds):
        points = [at, *(at + s * eye[i] for i in range(k) for s in (1, -1)), *(at + s * eye[i] + t * eye[j] for i, j in pairs for s in (1, -1) for t in (1, -1))]
        f = value(np.array(points))
        up, down = f[1 : 1 + 2 * k : 2], f[2 : 2 + 2 * k : 2]
        gradient, hessian = (up - down) / (2 * STEP), np.diag((up - 2 * f[0] + down) / STEP**2)
        for (i, j), own in zip(pairs, f[1 + 2 * k :].reshape(-1, 4), strict=True):
            hessian[i, j] = hessian[j, i] = (own[0] - own[1] - own[2] + own[3]) / (4 * STEP**2)
        # uphill even where the surface is not concave
        values, vectors = np.linalg.eigh(hessian)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-6))
        step *= min(1.0, 1.5 / max(np.abs(step).max(), 1e-12))
        tries = np.array([at + step * 0.5**s for s in range(8)])
        found = value(tries)
        best = int(found.argmax())
        if found[best] <= f[0] + 1e-12:
            break
        at, moved = tries[best], np.abs(tries[best] - at).max()
        if moved < 1e-6:
            break
    rows.unpersist()
    return np.exp(at)


@dataclass(frozen=True)
class Purchases:
    """BG/NBD with parameters r, alpha, a, b over columns frequency, recency and T."""

    r: float
    alpha: float
    a: float
    b: float

    def alive(self) -> Column:
        x, t, age = (F.col(c).cast("double") for c in ("frequency", "recency", "T"))
        odds = self.a / (self.b + x - 1) * F.pow((self.alpha + age) / (self.alpha + t), self.r + x)
        return F.when(x > 0, 1 / (1 + odds)).otherwise(1.0)

    def expected(self, months: float) -> Column:
        """The purchases expected of each customer in the next months."""
        me = self

        @F.pandas_udf("double")
        def run(x: pd.Series, t: pd.Series, age: pd.Series) -> pd.Series:
            x, t, age = (v.to_numpy(dtype=float) for v in (x, t, age))
            a = me.a if abs(me.a - 1) > 1e-6 else 1 + 1e-6  # a pole of the closed form
            z = months / (me.alpha + age + months)
            bracket = 1 - ((me.alpha + age) / (me.alpha + age + months)) ** (me.r + x) * hypergeometric(me.r + x, me.b + x, a + me.b + x - 1, z)
            odds = np.where(x > 0, a / (me.b + np.maximum(x, 1) - 1) * ((me.alpha + age) / (me.alpha + t)) ** (me.r + x), 0.0)
            out = (a + me.b + x - 1) / (a - 1) * bracket / (1 + odds)
            return pd.Series(np.where(np.isfinite(out), out, 0.0))

        return run("frequency", "recency", "T")

    def expected_new(self, months: float) -> float:
        """The purchases expected of a new customer in so many months."""
        a = self.a if abs(self.a - 1) > 1e-6 else 1 + 1e-6
        z = np.array([months / (self.alpha + months)])
        return float(((a + self.b - 1) / (a - 1) * (1 - (self.alpha / (self.alpha + months)) ** self.r * hypergeometric(self.r, self.b, a + self.b - 1, z)))[0])

    def probability_of(self, n: int, months: np.ndarray) -> np.ndarray:
        """The probability of exactly n purchases of a new customer in so many months."""
        r, alpha, a, b = self.r, self.alpha, self.a, self.b
        beta = lambda x, y: log_gamma(np.array([x]))[0] + log_gamma(np.array([y]))[0] - log_gamma(np.array([x + y]))[0]
        ratio = lambda j: np.exp(log_gamma(np.array([r + j]))[0] - log_gamma(np.array([r]))[0] - log_gamma(np.array([j + 1.0]))[0])
        part = lambda j: ratio(j) * (alpha / (alpha + months)) ** r * (months / (alpha + months)) ** j
        out = np.exp(beta(a, b + n) - beta(a, b)) * part(n)
        if n > 0:
            out = out + np.exp(beta(a + 1, b + n - 1) - beta(a, b)) * (1 - sum(part(j) for j in range(n)))
        return out


@dataclass(frozen=True)
class Spending:
    """Gamma-gamma with parameters p, q, v over columns frequency and monetary_value."""

    p: float
    q: float
    v: float

    def profit(self) -> Column:
        """The mean spend expected of each customer; of those who bought once the mean of all."""
        x, m = F.col("frequency").cast("double"), F.col("monetary_value").cast("double")
        if self.q <= 1:
            return m
        w = self.p * x / (self.p * x + self.q - 1)
        return F.when(x > 0, (1 - w) * self.p * self.v / (self.q - 1) + w * m).otherwise(self.p * self.v / (self.q - 1))


def fit_purchases(summary: DataFrame, penalty: float = 1e-4) -> Purchases:
    """BG/NBD of a summary with frequency, recency and T."""
    rate = summary.agg((F.avg("frequency") / F.avg("T")).alias("m")).first()["m"] or 0.1
    return Purchases(*maximise(summary, ("frequency", "recency", "T"), purchase_likelihood, (1.0, 1 / max(rate, 1e-6), 0.8, 2.5), penalty))


def fit_spending(summary: DataFrame, penalty: float = 1e-4) -> Spending:
    """Gamma-gamma of a summary with frequency and monetary_value; spends are divided by their mean for the fit."""
    again = summary.where("frequency > 0 AND monetary_value > 0")
    mean = again.agg(F.avg("monetary_value")).first()[0] or 1.0
    p, q, v = maximise(again.withColumn("monetary_value", F.col("monetary_value") / mean), ("frequency", "monetary_value"), spend_likelihood, (2.0, 3.0, 1.0), penalty)
    return Spending(p, q, v * mean)


def goodness_of_fit(summary: DataFrame, model: Purchases, most: int = 7) -> DataFrame:
    """(frequency, observed, expected): customers by number of repeat purchases, ``most`` standing for that and more."""
    ages = summary.groupBy(F.round("T", 1).alias("T")).agg(F.count("*").alias("n")).collect()  # ages in steps of a tenth
    months, n = np.array([r["T"] for r in ages], dtype=float), np.array([r["n"] for r in ages], dtype=float)
    expected = [float(n @ model.probability_of(k, months)) for k in range(most)]
    grid = summary.sparkSession.createDataFrame([(k, e) for k, e in enumerate([*expected, float(n.sum()) - sum(expected)])], "frequency long, expected double")
    seen = summary.groupBy(F.least(F.col("frequency"), F.lit(most)).cast("long").alias("frequency")).agg(F.count("*").alias("observed"))
    return grid.join(seen, "frequency", "left").select("frequency", F.coalesce("observed", F.lit(0)).alias("observed"), "expected")


def lifetime_value(summary: DataFrame, purchases: Purchases, spending: Spending, months: int, rate: float = 0.01, margin: float = 0.3) -> DataFrame:
    """Adds p_alive, expected (purchases within the months), profit and clv: each month's purchases times profit and margin, discounted."""
    steps = [purchases.expected(float(k)) for k in range(1, months + 1)]
    out = summary.withColumns({"p_alive": purchases.alive(), "profit": spending.profit()} | {f"__e{k}": e for k, e in enumerate(steps, 1)})
    value = F.lit(0.0)
    for k in range(1, months + 1):
        gain = F.col(f"__e{k}") - (F.col(f"__e{k - 1}") if k > 1 else F.lit(0.0))
        value = value + gain * F.lit((1 + rate) ** -k)
    out = out.withColumn("expected", F.col(f"__e{months}")).withColumn("clv", value * F.col("profit") * margin)
    return out.drop(*[f"__e{k}" for k in range(1, months + 1)])
