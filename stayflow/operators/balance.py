"""Propensity weights, overlap and balance. ``e`` names the columns of propensities, one per arm from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running


def own_propensity(arm: str, e: Sequence[str]) -> Column:
    return F.element_at(F.array(*e), (F.col(arm) + 1).cast("int"))


def trim_by_overlap(df: DataFrame, arm: str, e: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows whose own and control propensities both lie within [low, high]."""
    return df.where(own_propensity(arm, e).between(low, high) & F.col(e[0]).between(low, high))


def ipw_weights(df: DataFrame, arm: str, e: Sequence[str], stabilised: bool = True, clip: float | None = None, name: str = "ipw") -> DataFrame:
    """Adds 1 / own propensity, times the arm's share if stabilised; ``clip`` below 1 is a quantile of the weights, above an upper bound."""
    weight = 1 / own_propensity(arm, e)
    if stabilised:
        shares = df.groupBy(arm).count().withColumn("__share", F.col("count") / F.sum("count").over(Window.partitionBy()))
        df = df.join(F.broadcast(shares.select(arm, "__share")), arm)  # a row per arm
        weight = weight * F.col("__share")
    out = df.withColumn(name, weight)
    if clip is not None:
        top = out.agg(F.percentile(name, clip)).first()[0] if clip < 1 else clip
        out = out.withColumn(name, F.least(F.col(name), F.lit(top)))
    return out.drop("__share")


def effective_sample_size(weight: Column) -> Column:
    """(sum w)^2 / sum w^2 as an aggregate; 0 over nothing."""
    return F.coalesce(F.pow(F.sum(weight), 2) / F.nullif(F.sum(weight * weight), F.lit(0.0)), F.lit(0.0))


def standardised_differences(df: DataFrame, arm: str, features: Sequence[str], weight: str | None = None) -> DataFrame:
    """(feature, arm, smd, smd_weighted) against arm 0, over one pass of sums per (feature, arm).

    The mean difference over the root of the mean of both variances (reliability-corrected where weighted); 0 where both
    sides are constant and equal, null where they are constant and differ.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    long = df.select(F.col(arm).alias("arm"), w.cast("double").alias("w"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    moments = long.where("x IS NOT NULL").groupBy("feature", "arm").agg(
        F.avg("x").alias("m"), F.var_samp("x").alias("v"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("wm"),
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("swxx"),
    )
    wv = (F.col("swxx") - F.col("sw") * F.col("wm") * F.col("wm")) * F.col("sw") / F.nullif(F.col("sw") * F.col("sw") - F.col("sww"), F.lit(0.0))
    moments = moments.withColumn("wv", wv)
    a, c = moments.where("arm <> 0").alias("a"), moments.where("arm = 0").alias("c")

    def smd(mean: str, var: str) -> Column:
        gap, spread = F.col(f"a.{mean}") - F.col(f"c.{mean}"), F.sqrt((F.col(f"a.{var}") + F.col(f"c.{var}")) / 2)
        return F.when(spread > 0, gap / spread).when(gap == 0, 0.0)

    return a.join(c, "feature").select("feature", F.col("a.arm").alias("arm"), smd("m", "v").alias("smd"), smd("wm", "wv").alias("smd_weighted"))


def overlap(df: DataFrame, arm: str, e: Sequence[str], low: float = 0.01, high: float = 0.99, most: float = 0.05) -> DataFrame:
    """(arm, own, n, p_min, p1, p5, median, p95, p99, p_max, share_low, share_high, flag): each arm's propensity among its own rows and the others."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), (F.col(arm) == a).alias("own"), F.col(c).cast("double").alias("p")) for a, c in enumerate(e)])))
    q = F.percentile("p", F.array(*[F.lit(x) for x in (0.01, 0.05, 0.5, 0.95, 0.99)]))
    out = long.groupBy("arm", "own").agg(
        F.count("*").alias("n"), F.min("p").alias("p_min"), q.alias("q"), F.max("p").alias("p_max"),
        F.avg((F.col("p") <= low).cast("double")).alias("share_low"), F.avg((F.col("p") >= high).cast("double")).alias("share_high"),
    )
    names = ("p1", "p5", "median", "p95", "p99")
    return out.select("arm", "own", "n", "p_min", *[F.col("q")[i].alias(c) for i, c in enumerate(names)], "p_max", "share_low", "share_high", ((F.col("share_low") > most) | (F.col("share_high") > most)).alias("flag"))


def hajek_means(df: DataFrame, y: str, treated: str, e1: Column) -> DataFrame:
    """(mean_treated, mean_control): self-normalised inverse-propensity means."""
    t = F.col(treated).cast("double")
    a, b = t / e1, (1 - t) / (1 - e1)
    return df.agg((F.sum(a * F.col(y)) / F.sum(a)).alias("mean_treated"), (F.sum(b * F.col(y)) / F.sum(b)).alias("mean_control"))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, auc) by rank sums over distinct scores; null without both labels."""
    cells = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    # negatives up to a score, half of those at it
    won = running(cells, F.col("s"), [], {"upto": F.col("n") - F.col("p")}, "__rn", by=by).withColumn("won", F.col("p") * (F.col("upto") - (F.col("n") - F.col("p")) / 2))
    out = won.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("won").alias("won"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return out.select(*by, "n", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, ece): over equal-width bins the mean gap between score and label, weighted by count."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    cells = df.groupBy(*by, b).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("double")).alias("y"))
    return cells.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
