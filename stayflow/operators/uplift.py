"""Uplift curves and effect metrics. Rows have an outcome y, a treatment mark w (0 or 1), a predicted effect and a unique key for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running


def _prefix(df: DataFrame, y: str, w: str, lead: Column, key: str) -> DataFrame:
    """(k, n_t, n_c, y_t, y_c, y, w) in the order of ``lead`` ascending: counts and sums of outcomes so far."""
    t, v = F.col(w).cast("long"), F.col(y).cast("double")
    rows = df.select(F.col(key), v.alias("y"), t.alias("w"), lead.alias("__by"))
    out = running(rows, F.col("__by"), [F.col(key)], {"n_t": t, "n_c": 1 - t, "y_t": v * t, "y_c": v * (1 - t)}, "k")
    return out.drop("__by")


def qini_curve(df: DataFrame, y: str, w: str, effect: str, key: str, cost: float = 0.0) -> DataFrame:
    """(k, n_t, n_c, value, random, qini) for k = 0..n targeted units: treated outcomes less control outcomes scaled to their number."""
    curve = _prefix(df, y, w, -F.col(effect), key)
    value = F.when(F.col("n_c") > 0, F.col("y_t") - F.col("y_c") * F.col("n_t") / F.col("n_c")).otherwise(0.0) - cost * F.col("n_t")
    curve = curve.select("k", "n_t", "n_c", value.alias("value"))
    end = curve.agg(F.max("k").alias("__n"), F.max_by("value", "k").alias("__end"))
    zero = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("n_t"), F.lit(0).cast("long").alias("n_c"), F.lit(0.0).alias("value"))
    out = curve.unionByName(zero).crossJoin(F.broadcast(end))  # a single row
    random = F.coalesce(F.col("__end") * F.col("k") / F.col("__n"), F.lit(0.0))
    return out.select("k", "n_t", "n_c", "value", random.alias("random"), (F.col("value") - random).alias("qini"))


def oracle_lead(df: DataFrame, y: str, w: str, key: str) -> DataFrame:
    """Adds __ideal: the ideal order has treated units by falling and controls by rising outcome, spread evenly among each other."""
    v, t = F.col(y).cast("double"), F.col(w).cast("int")
    by_arm = [running(df.where(t == a), (v if a == 0 else -v), [F.col(key)], number="__j") for a in (0, 1)]
    sizes = {r[0]: r[1] for r in df.groupBy(t.alias("w")).count().collect()}
    return by_arm[0].withColumn("__ideal", (F.col("__j") - 0.5) / sizes.get(0, 1)).unionByName(by_arm[1].withColumn("__ideal", (F.col("__j") - 0.5) / sizes.get(1, 1))).drop("__j")


def _area(curve: DataFrame, value: Column, chord: bool) -> float:
    """The trapezoid area under a curve that starts at 0 over unit steps, less that under its chord if asked.

    Every inner point counts once and the last half, so no ordering is needed for the sum.
    """
    s = curve.agg(F.sum(value).alias("s"), F.max("k").alias("n"), F.max_by(value, "k").alias("last")).first()
    if s["n"] is None:
        return 0.0
    area = s["s"] - s["last"] / 2
    return area - (s["last"] * s["n"] / 2 if chord else 0.0)


def qini_score(df: DataFrame, y: str, w: str, effect: str, key: str) -> float:
    """The area between the curve and its chord over that of the ideal order; 0 where the latter is not positive."""
    value = F.when(F.col("n_c") > 0, F.col("y_t") - F.col("y_c") * F.col("n_t") / F.col("n_c")).otherwise(0.0)
    own = _area(_prefix(df, y, w, -F.col(effect), key), value, True)
    ideal = _area(_prefix(oracle_lead(df, y, w, key), y, w, F.col("__ideal"), key), value, True)
    return own / ideal if ideal > 1e-12 else 0.0


def uplift_value() -> Column:
    both = (F.col("n_t") > 0) & (F.col("n_c") > 0)
    return F.when(both, (F.col("y_t") / F.col("n_t") - F.col("y_c") / F.col("n_c")) * F.col("k")).otherwise(0.0)


def auuc(df: DataFrame, y: str, w: str, effect: str, key: str) -> float:
    """The area under the cumulative uplift over that of the ideal order; NaN where the latter is not positive."""
    own = _area(_prefix(df, y, w, -F.col(effect), key), uplift_value(), False)
    ideal = _area(_prefix(oracle_lead(df, y, w, key), y, w, F.col("__ideal"), key), uplift_value(), False)
    return own / ideal if ideal > 0 else float("nan")


def uplift_at_k(df: DataFrame, y: str, w: str, effect: str, key: str, k: float) -> DataFrame:
    """(k, uplift, qini) at a share (up to 1) or number of units; null where an arm is empty there."""
    curve = _prefix(df, y, w, -F.col(effect), key)
    at = F.ceil(F.lit(float(k)) * df.count()) if k <= 1 else F.lit(int(k))
    both = (F.col("n_t") > 0) & (F.col("n_c") > 0)
    return curve.where(F.col("k") == at).select(
        "k", F.when(both, F.col("y_t") / F.col("n_t") - F.col("y_c") / F.col("n_c")).alias("uplift"),
        F.when(both, F.col("y_t") - F.col("y_c") * F.col("n_t") / F.col("n_c")).alias("qini"),
    )


def rank_blocks(df: DataFrame, lead: Column, key: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds the block from 1 of a row's rank: blocks of equal size, the first n mod bins of them one row larger."""
    ranked = running(df, lead, [F.col(key)], number="__rn")
    n = df.count()
    size, extra = divmod(n, bins)
    r = F.col("__rn") - 1
    edge = extra * (size + 1)
    block = F.when(r < edge, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - edge) / max(size, 1))) + 1
    return ranked.withColumn(name, block.cast("int")).drop("__rn")


def uplift_by_decile(df: DataFrame, y: str, w: str, effect: str, key: str, bins: int = 10, z: float = 1.959963984540054) -> DataFrame:
    """(bin, n_t, n_c, mean_effect, uplift, se, ci_low, ci_high) from the highest predicted effect on; Welch errors."""
    binned = rank_blocks(df, -F.col(effect), key, bins)
    t = F.col(w).cast("int")
    of = lambda f, a: f(F.when(t == a, F.col(y)))
    uplift = of(F.avg, 1) - of(F.avg, 0)
    se = F.sqrt(of(F.var_samp, 1) / F.sum(t) + of(F.var_samp, 0) / F.sum(1 - t))
    out = binned.groupBy("bin").agg(F.sum(t).alias("n_t"), F.sum(1 - t).alias("n_c"), F.avg(effect).alias("mean_effect"), uplift.alias("uplift"), se.alias("se"))
    return out.withColumns({"ci_low": F.col("uplift") - z * F.col("se"), "ci_high": F.col("uplift") + z * F.col("se")})


def targeting_characteristic(df: DataFrame, y: str, w: str, effect: str, key: str, points: int = 100) -> DataFrame:
    """(q, m, toc): the effect among the m = round(q n) units with the highest predicted effects less that among all."""
    curve = _prefix(df, y, w, -F.col(effect), key)
    n = df.count()
    grid = df.sparkSession.range(1, points + 1).select((F.col("id") / points).alias("q"), F.bround(F.col("id") / points * n).cast("long").alias("m"))
    ate = F.when((F.col("n_t") > 0) & (F.col("n_c") > 0), F.col("y_t") / F.col("n_t") - F.col("y_c") / F.col("n_c"))
    at = curve.join(F.broadcast(grid), F.col("k") == F.col("m")).select("q", "m", ate.alias("ate"))  # the grid has `points` rows
    whole = at.where(F.col("m") == n).agg(F.first("ate").alias("__all"))
    return at.crossJoin(F.broadcast(whole)).select("q", "m", (F.col("ate") - F.col("__all")).alias("toc"))


def aipw_score(y: Column, t: Column, e: Column, mu0: Column, mu1: Column) -> Column:
    return mu1 - mu0 + t / e * (y - mu1) - (1 - t) / (1 - e) * (y - mu0)


def gates(df: DataFrame, y: str, w: str, effect: str, e1: Column, key: str, groups: int = 5) -> DataFrame:
    """(bin, n, gate, se): mean doubly robust score in groups of rising predicted effect, with each group's self-normalised arm means as outcome models."""
    binned = rank_blocks(df, F.col(effect), key, groups).withColumns({"__e": F.least(F.greatest(e1, F.lit(0.01)), F.lit(0.99)), "__t": F.col(w).cast("double"), "__y": F.col(y).cast("double")})
    a, b = F.col("__t") / F.col("__e"), (1 - F.col("__t")) / (1 - F.col("__e"))
    means = binned.groupBy("bin").agg((F.sum(a * F.col("__y")) / F.nullif(F.sum(a), F.lit(0.0))).alias("m1"), (F.sum(b * F.col("__y")) / F.nullif(F.sum(b), F.lit(0.0))).alias("m0"))
    psi = aipw_score(F.col("__y"), F.col("__t"), F.col("__e"), F.col("m0"), F.col("m1"))
    return binned.join(F.broadcast(means), "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg(psi).alias("gate"), (F.stddev_samp(psi) / F.sqrt(F.count("*"))).alias("se"))


def blp(df: DataFrame, psi: Column, effect: str) -> DataFrame:
    """(n, ate, slope, se_ate, se_slope): scores regressed on 1 and the centred effect, with HC1 errors, in two aggregates."""
    rows = df.select(psi.alias("p"), F.col(effect).cast("double").alias("x"))
    c = rows.agg(F.count("*").alias("n"), F.avg("p").alias("a"), F.avg("x").alias("m"), F.regr_slope("p", "x").alias("b"), F.regr_sxx("p", "x").alias("sxx"))
    d = F.col("x") - F.col("m")
    r2 = F.pow(F.col("p") - F.col("a") - F.col("b") * d, 2)
    return rows.crossJoin(F.broadcast(c)).groupBy("n", "a", "b", "sxx").agg(F.sum(r2).alias("e"), F.sum(r2 * d * d).alias("ex")).select(
        "n", F.col("a").alias("ate"), F.col("b").alias("slope"), (F.sqrt(F.col("e") * F.col("n") / (F.col("n") - 2)) / F.col("n")).alias("se_ate"),
        (F.sqrt(F.col("ex") * F.col("n") / (F.col("n") - 2)) / F.nullif(F.col("sxx"), F.lit(0.0))).alias("se_slope"),
    )


def effect_errors(df: DataFrame, true: list[str], estimated: list[str]) -> DataFrame:
    """(pehe, eps_ate): the root mean squared error over all cells, and the gap between the pooled means."""
    cells = df.select(F.inline(F.array(*[F.struct(F.col(a).cast("double").alias("t"), F.col(b).cast("double").alias("p")) for a, b in zip(true, estimated, strict=True)])))
    return cells.agg(F.sqrt(F.avg(F.pow(F.col("t") - F.col("p"), 2))).alias("pehe"), F.abs(F.avg("t") - F.avg("p")).alias("eps_ate"))


def policy_risk(df: DataFrame, outcomes: list[str], chosen: str) -> DataFrame:
    """(policy_risk): mean of the best arm's outcome less the chosen arm's."""
    return df.agg(F.avg(F.greatest(*outcomes) - F.element_at(F.array(*outcomes), (F.col(chosen) + 1).cast("int"))).alias("policy_risk"))
