"""Refutations of a linear effect estimate. All simulations of a test are sums of one aggregate over the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import normal_cdf
from ..functions.prefix import running
from ..functions.tables import written
from .linear import design, moments, solve
from .splits import folds, uniform


def linear_effect(df: DataFrame, y: Column, w: Column, x: Sequence[str]) -> dict[str, float]:
    """The coefficient of ``w`` in a regression of ``y`` on it and the features: effect, se, dof."""
    gram, cross, square = moments(df, [*design(x), w], [y])[()]
    b = solve(gram, cross)[:, 0]
    dof = gram[0, 0] - len(b)
    residual = max(0.0, float(square[0, 0] - b @ cross[:, 0]))
    se = math.sqrt(residual / dof * np.linalg.pinv(gram)[-1, -1]) if dof > 0 else float("nan")
    return {"effect": float(b[-1]), "se": se, "dof": float(dof)}


def partial_linear(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """(ate, se, n): Robinson's estimate from residuals of the outcome and of the treatment, both fitted on the other folds."""
    xs = design(x)
    rows = folds(df, w, key, k)
    parts = moments(rows, xs, [F.col(y), F.col(w)], [F.col("fold")])
    whole = [sum(p[i] for p in parts.values()) for i in (0, 1)]
    left = {}
    for name, j in (("__y", 0), ("__w", 1)):
        out = F.lit(None).cast("double")
        for (f,), p in parts.items():
            b = solve(whole[0] - p[0], whole[1] - p[1])[:, j]
            out = F.when(F.col("fold") == f, F.col((y, w)[j]) - sum(F.lit(float(v)) * c for v, c in zip(b, xs, strict=True))).otherwise(out)
        left[name] = out
    rows = rows.withColumns(left)
    ate = rows.agg((F.sum(F.col("__w") * F.col("__y")) / F.sum(F.col("__w") * F.col("__w"))).alias("ate"))
    meat = F.pow(F.col("__w") * (F.col("__y") - F.col("ate") * F.col("__w")), 2)
    return rows.crossJoin(F.broadcast(ate)).agg(F.first("ate").alias("ate"), (F.sqrt(F.sum(meat)) / F.sum(F.col("__w") * F.col("__w"))).alias("se"), F.count("*").alias("n"))


def _simulated(df: DataFrame, x: Sequence[str], y: Column, w: Sequence[Column], more: Sequence[Column] | None = None, kept: Sequence[Column] | None = None) -> list[float]:
    """The coefficient of each simulated treatment, with its further regressor and its own rows where given; one aggregate."""
    xs, sums, names = design(x), [], []
    for s in range(max(len(w), len(more or ()), len(kept or ()))):
        row = [*xs, *([more[s]] if more else []), w[s % len(w)], y]
        m = kept[s].cast("double") if kept else F.lit(1.0)
        for i in range(len(row)):
            for j in range(i, len(row)):
                sums.append(F.sum(m * row[i] * row[j]).alias(f"s{s}_{i}_{j}"))
        names.append(len(row))
    got, out = df.agg(*sums).first(), []
    for s, n in enumerate(names):
        g = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                g[i, j] = g[j, i] = got[f"s{s}_{i}_{j}"] or 0.0
        out.append(float(solve(g[:-1, :-1], g[:-1, -1])[-1]))
    return out


def _result(df: DataFrame, test: str, original: float, values: list[float], passed: bool) -> DataFrame:
    """(test, original, mean, low, high, passed) as a row."""
    low, high = (float(np.quantile(values, q)) for q in (0.025, 0.975))
    return df.sparkSession.createDataFrame([(test, float(original), float(np.mean(values)), low, high, bool(passed))], "test string, original double, mean double, low double, high double, passed boolean")


def placebo(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, n: int = 20, seed: int = 11) -> DataFrame:
    """A treatment drawn at random with the same share should have no effect: the original must lie outside the draws' central 95 %."""
    share = df.agg(F.avg(F.col(w).cast("double"))).first()[0] or 0.0
    original = linear_effect(df, F.col(y), F.col(w), x)["effect"]
    values = _simulated(df, x, F.col(y), [(uniform(seed + s, key) < share).cast("double") for s in range(n)])
    low, high = np.quantile(values, [0.025, 0.975])
    return _result(df, "placebo", original, values, not low <= original <= high)


def placebo_permuted(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, n: int = 20, seed: int = 11) -> DataFrame:
    """(test, original, mean, low, high, p_value, passed): the treatment column shuffled over all rows, with every arm's count kept exactly.

    Each draw orders the rows by a hash of their key and hands the arms out in that order; the draws are numbered over
    ranges in one job and fitted from one aggregate. ``p_value`` is the share of draws at least as far from 0 as the
    original. Rows without outcome or treatment take no part. Rows of equal keys lie side by side in a draw.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(w).isNotNull())
    original = linear_effect(rows, F.col(y), F.col(w), x)["effect"]
    arms = rows.groupBy(F.col(w).cast("double").alias("w")).count().orderBy("w").collect()  # a row per arm
    last = np.cumsum([r["count"] for r in arms])
    shuffled = F.lit(None).cast("double")
    for r, upto in zip(reversed(arms), reversed(last), strict=True):
        shuffled = F.when(F.col("__rank") <= int(upto), F.lit(r["w"])).otherwise(shuffled)
    drawn = rows.select(F.col(key).alias("__key"), F.col(y).alias("__y"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(x)], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", (F.col("__draw") + seed).cast("string"), F.col("__key").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranked = running(drawn.withColumn("__u", u), F.col("__u"), [F.col("__key")], number="__rank", by=["__draw"])
    parts = moments(ranked.withColumn("__w", shuffled), [*design([f"__x{i}" for i in range(len(x))]), F.col("__w")], [F.col("__y")], [F.col("__draw")])
    values = [float(solve(gram, cross)[-1, 0]) for gram, cross, _ in parts.values()]
    low, high = np.quantile(values, [0.025, 0.975])
    p = float(np.mean(np.abs(values) >= abs(original)))
    return _result(df, "placebo_permuted", original, values, not low <= original <= high).select("test", "original", "mean", "low", "high", F.lit(p).alias("p_value"), "passed")


def common_cause(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, n: int = 10, seed: int = 12, tolerance: float = 0.1) -> DataFrame:
    """A random regressor should change nothing: the mean relative change stays below ``tolerance``."""
    original = linear_effect(df, F.col(y), F.col(w), x)["effect"]
    values = _simulated(df, x, F.col(y), [F.col(w)], [uniform(seed + s, key) for s in range(n)])
    spread = df.agg(F.stddev_samp(y)).first()[0] or 0.0
    change = np.mean(np.abs(np.array(values) - original)) / max(abs(original), 0.05 * spread, 1e-12)
    return _result(df, "random_common_cause", original, values, change < tolerance)


def subsets(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, share: float = 0.7, n: int = 10, seed: int = 13) -> DataFrame:
    """Estimates on random subsets should hold the original in their central 95 %."""
    original = linear_effect(df, F.col(y), F.col(w), x)["effect"]
    values = _simulated(df, x, F.col(y), [F.col(w)], kept=[uniform(seed + s, key) < share for s in range(n)])
    low, high = np.quantile(values, [0.025, 0.975])
    return _result(df, "subset", original, values, low <= original <= high)


def hidden_confounder(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, strengths: Sequence[float] = (0.25, 0.5), seed: int = 14) -> DataFrame:
    """A confounder of each strength moves treatment and outcome: the effect should keep its sign."""
    stats = df.agg(F.avg(F.col(w).cast("double")).alias("m"), F.stddev_pop(F.col(w).cast("double")).alias("s"), F.stddev_samp(y).alias("y")).first()
    original = linear_effect(df, F.col(y), F.col(w), x)["effect"]
    values = []
    for i, s in enumerate(strengths):
        u = F.lit(s) * (F.col(w) - stats["m"]) / (stats["s"] or 1.0) + (uniform(seed + i, key) - 0.5) * math.sqrt(12)
        values.append(linear_effect(df, F.col(y) + s * stats["y"] * u, F.col(w), x)["effect"])
    return _result(df, "unobserved_confounder", original, values, all(np.sign(v) == np.sign(original) for v in values))


def confounder_shift(df: DataFrame, y: str, w: str, x: Sequence[str], key: str, strengths: Sequence[float] = (0.25, 0.5, 1.0), tolerance: float = 0.35, seed: int = 14) -> DataFrame:
    """(strength, effect, shift, predicted, gap, as_predicted): how far the confounder of ``hidden_confounder`` moves the estimate, and should.

    A confounder that moves the standardised treatment and outcome by s shifts the effect by s^2 sd(y) / sd(w); the gap
    may reach ``tolerance`` of that, or 0.02 sd(y) if more. A treatment that does not vary gives nulls.
    """
    stats = df.agg(F.avg(F.col(w).cast("double")).alias("m"), F.stddev_pop(F.col(w).cast("double")).alias("s"), F.stddev_samp(y).alias("y")).first()
    kind = "strength double, effect double, shift double, predicted double, gap double, as_predicted boolean"
    if not stats["s"] or stats["y"] is None:
        return df.sparkSession.createDataFrame([(float(s), None, None, None, None, None) for s in strengths], kind)
    # every strength is an outcome of the same regression
    u = [F.lit(s) * (F.col(w) - stats["m"]) / stats["s"] + (uniform(seed + i, key) - 0.5) * math.sqrt(12) for i, s in enumerate(strengths)]
    gram, cross, _ = moments(df, [*design(x), F.col(w)], [F.col(y), *[F.col(y) + s * stats["y"] * c for s, c in zip(strengths, u, strict=True)]])[()]
    effects = solve(gram, cross)[-1]
    rows = []
    for s, e in zip(strengths, effects[1:], strict=True):
        shift, predicted = float(e - effects[0]), s * s * stats["y"] / stats["s"]
        gap = abs(shift - predicted)
        rows.append((float(s), float(e), shift, predicted, gap, gap <= max(tolerance * abs(predicted), 0.02 * stats["y"])))
    return df.sparkSession.createDataFrame(rows, kind)


SUITE = "test string, original double, mean double, low double, high double, passed boolean, error string"


def suite(df: DataFrame, y: str, w: str, x: Sequence[str], key: str) -> DataFrame:
    """(test, original, mean, low, high, passed, error) of all tests.

    A test that the data do not allow (no row, an outcome that does not vary) is a row that has not passed, with what
    went wrong; what fails in Spark itself is raised.
    """
    dof, rows = linear_effect(df, F.col(y), F.col(w), x)["dof"], []
    for name, test in (("placebo", placebo), ("random_common_cause", common_cause), ("subset", subsets), ("unobserved_confounder", hidden_confounder)):
        try:
            if dof <= 0:
                raise ValueError("fewer rows than the regression has coefficients")
            rows.append((*test(df, y, w, x, key).first(), None))
        except (ValueError, TypeError, KeyError, ArithmeticError, np.linalg.LinAlgError) as e:
            rows.append((name, None, None, None, None, False, f"{type(e).__name__}: {e}"))
    return df.sparkSession.createDataFrame(rows, SUITE)


def contour(df: DataFrame, y: str, w: str, x: Sequence[str], steps: Sequence[float] = (0.0, 0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """(r2_y, r2_w, bias, adjusted): how far a confounder that explains so much of outcome and treatment would move the effect towards 0."""
    got = linear_effect(df, F.col(y), F.col(w), x)
    grid = df.sparkSession.createDataFrame([(float(a), float(b)) for a in steps for b in steps], "r2_y double, r2_w double")
    bias = got["se"] * math.sqrt(max(got["dof"], 0.0)) * F.sqrt(F.col("r2_y") * F.col("r2_w") / (1 - F.col("r2_w")))
    toward = F.lit(got["effect"]) - math.copysign(1.0, got["effect"]) * F.col("bias")
    return grid.withColumn("bias", bias).withColumn("adjusted", toward)


def _partial_r2(gram: np.ndarray, cross: np.ndarray, square: float) -> np.ndarray:
    """What each regressor explains of what the others leave of the target; one that the others determine explains nothing."""

    def left(kept: list[int]) -> float:
        part = gram[np.ix_(kept, kept)]
        return max(0.0, square - float(solve(part, cross[kept]) @ cross[kept])) if kept else square

    every = list(range(len(gram)))
    whole = left(every)
    without = [left([i for i in every if i != j]) for j in every]
    return np.array([1 - min(whole / o, 1.0) if o > 1e-12 * square else 0.0 for o in without])


def _bias_to(f: float) -> float:
    """The common partial R2 of outcome and treatment at which a confounder's bias is ``f`` standard errors over root dof."""
    return (math.sqrt(f**4 + 4 * f * f) - f * f) / 2


def robustness(df: DataFrame, y: str, w: str, x: Sequence[str], z: float = 1.959963985) -> DataFrame:
    """(effect, se, dof, t, robustness, robustness_alpha): the share that a confounder must explain of both outcome and treatment to bring the effect to 0, or within ``z`` standard errors of it.

    Without residual degrees of freedom t and both shares are null.
    """
    got = linear_effect(df, F.col(y), F.col(w), x)
    t = rv = alpha = None
    if got["dof"] > 0 and got["se"] > 0:
        t, root = got["effect"] / got["se"], math.sqrt(got["dof"])
        rv, alpha = _bias_to(abs(t) / root), _bias_to(max(abs(t) - z, 0.0) / root)
    return df.sparkSession.createDataFrame([(got["effect"], got["se"], int(got["dof"]), t, rv, alpha)], "effect double, se double, dof long, t double, robustness double, robustness_alpha double")


def benchmarks(df: DataFrame, y: str, w: str, x: Sequence[str]) -> DataFrame:
    """(feature, r2_y, r2_w, bias, adjusted, nullified, multiple): a confounder as strong as each feature, on the axes of ``contour``.

    r2_y is what the feature explains of the outcome beside treatment and other features, r2_w of the treatment beside
    them. ``multiple`` is how many times as strong on both axes a confounder must be to bring the effect to 0: the k with
    k^2 r2_y r2_w / (1 - k r2_w) = t^2 / dof; null where the feature explains nothing. One aggregate serves all.
    """
    gram, cross, square = moments(df, [*design(x), F.col(w)], [F.col(y)])[()]
    kind = "feature string, r2_y double, r2_w double, bias double, adjusted double, nullified boolean, multiple double"
    dof = gram[0, 0] - len(gram)
    if dof <= 0:
        return df.sparkSession.createDataFrame([(c, *[None] * 6) for c in x], kind)
    on_y = np.minimum(_partial_r2(gram, cross[:, 0], float(square[0, 0])), 0.999)
    on_w = np.minimum(_partial_r2(gram[:-1, :-1], gram[:-1, -1], float(gram[-1, -1])), 0.999)
    effect = float(solve(gram, cross)[-1, 0])
    share = _partial_r2(gram, cross[:, 0], float(square[0, 0]))[-1]
    f2 = float(share / (1 - share)) if share < 1 else math.inf  # t^2 / dof
    rows = []
    for i, c in enumerate(x, 1):
        a, b = float(on_y[i]), float(on_w[i])
        bias = abs(effect) * math.sqrt(a * b / (1 - b) / f2) if f2 > 0 else 0.0
        multiple = (math.sqrt(f2 * f2 * b * b + 4 * a * b * f2) - f2 * b) / (2 * a * b) if a * b > 1e-12 else None
        rows.append((c, a, b, bias, effect - math.copysign(bias, effect), bias >= abs(effect), multiple))
    return df.sparkSession.createDataFrame(rows, kind)


def matched_pairs(df: DataFrame, y: str, w: str, score: str, key: str) -> DataFrame:
    """(pair, difference): treated and control rows in order of the score, the longer side thinned evenly, paired by rank."""
    sides = []
    for v in (0, 1):
        one = df.where(F.col(w) == v).select(F.col(score).cast("double").alias("s"), F.col(key).alias("k"), F.col(y).cast("double").alias(f"y{v}"))
        sides.append((running(one, F.col("s"), [F.col("k")], number="rank"), one.count()))
    n = min(s[1] for s in sides)
    thin = []
    for v, (rows, size) in enumerate(sides):
        # of each n-th part of the longer side the row that starts it
        part = F.floor((F.col("rank") - 1) * n / size)
        starts = (F.col("rank") == 1) | (part != F.floor((F.col("rank") - 2) * n / size))
        thin.append(rows.withColumn("pair", part.cast("long")).where(starts).select("pair", f"y{v}"))
    return thin[1].join(thin[0], "pair").select("pair", (F.col("y1") - F.col("y0")).alias("difference"))


def hodges_lehmann(pairs: DataFrame, column: str = "difference", bins: int = 4096, at_once: int = 31, precision: float = 1e-10) -> DataFrame:
    """(n, mean_difference, hodges_lehmann): the median of all averages of two differences, each with itself too, without writing the averages.

    Counts per bin, folded with themselves, enclose the median within a bin's width; then candidates between the bounds
    are counted: a candidate m has below it, for each difference d, the differences up to 2 m - d, which running counts
    over ranges answer. The bounds meet to ``precision`` of the differences' range. Nulls and NaN take no part; no row:
    n = 0 and nulls.
    """
    d = F.col("d")
    rows = written(pairs.select(F.col(column).cast("double").alias("d")).where(d.isNotNull() & ~F.isnan(d)))
    s = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("low"), F.max("d").alias("high")).first()
    found, span = s["low"], (s["high"] - s["low"]) if s["n"] else 0.0
    if span > 0:
        counts = np.zeros(bins, dtype=np.int64)
        for r in rows.groupBy(F.least(F.floor((d - s["low"]) / span * bins), F.lit(bins - 1)).alias("bin")).count().collect():  # a row per bin
            counts[r["bin"]] = r["count"]
        folded = np.convolve(counts, counts)
        folded[::2] += counts
        upto, every = np.cumsum(folded // 2), s["n"] * (s["n"] + 1) // 2
        ranks = sorted({(every + 1) // 2, every // 2 + 1})  # an even number of averages has two middle ones
        fuzz, bounds = 1e-12 * (span + abs(s["low"])), {}
        for k in ranks:
            at = int(np.searchsorted(upto, k))
            bounds[k] = (s["low"] + at * span / bins / 2 - fuzz, s["low"] + (at + 2) * span / bins / 2 + fuzz)
        while any(high - low > precision * span and np.nextafter(low, high) < high for low, high in bounds.values()):
            tried = sorted({float(m) for low, high in bounds.values() for m in np.linspace(low, high, at_once + 2)[1:-1]})
            asked = rows.select(F.posexplode(F.array(*[F.lit(2 * m) - d for m in tried])).alias("m", "v"))
            points = rows.select(F.lit(-1).alias("m"), d.alias("v")).unionByName(asked)
            counted = running(points, F.col("v"), [F.col("m")], {"below": (F.col("m") < 0).cast("long")}, "__rn").where("m >= 0").groupBy("m").agg(F.sum("below").alias("c")).collect()  # a row per candidate
            own = rows.agg(*[F.count_if(d <= m).alias(f"m{i}") for i, m in enumerate(tried)]).first()
            below = [(tried[r["m"]], (r["c"] + own[f"m{r['m']}"]) // 2) for r in counted]
            for k, (low, high) in bounds.items():
                bounds[k] = (max([low, *[m for m, c in below if c < k]]), min([high, *[m for m, c in below if c >= k]]))
        found = float(np.mean([(low + high) / 2 for low, high in bounds.values()]))
    return pairs.sparkSession.createDataFrame([(s["n"], s["mean"], found)], "n long, mean_difference double, hodges_lehmann double")


def rosenbaum(pairs: DataFrame, gammas: Sequence[float] = (1.0, 1.2, 1.5, 2.0, 3.0)) -> DataFrame:
    """(gamma, n, w_plus, z_low, z_high, p_low, p_high): signed-rank bounds where hidden bias changes the odds of treatment by up to gamma."""
    d = F.col("difference")
    cells = pairs.where(d != 0).groupBy(F.abs(d).alias("a")).agg(F.count("*").alias("c"), F.count_if(d > 0).alias("up"))
    ranked = running(cells, F.col("a"), [], {"upto": F.col("c")})
    rank = F.col("upto") - (F.col("c") - 1) / 2
    s = ranked.agg(F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("w"), F.sum(rank * F.col("c")).alias("r1"), F.sum(rank * rank * F.col("c")).alias("r2")).first()
    rows = []
    for g in gammas:
        z = []
        for p in (g / (1 + g), 1 / (1 + g)):
            spread = math.sqrt(p * (1 - p) * (s["r2"] or 0.0))
            z.append((s["w"] - p * s["r1"]) / spread if spread else 0.0)
        rows.append((float(g), int(s["n"] or 0), float(s["w"] or 0.0), z[0], z[1], 1 - normal_cdf(z[1]), 1 - normal_cdf(z[0])))
    return pairs.sparkSession.createDataFrame(rows, "gamma double, n long, w_plus double, z_low double, z_high double, p_low double, p_high double")
