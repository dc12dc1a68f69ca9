"""Costs, net values, the decision frame, budgeted allocation and off-policy value."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.scalars import expected_costs, first_argmax
from ..functions.tables import written
from ..schema import ARM_COSTS, ARM_NAMES, ARM_REDEMPTION

COSTS = expected_costs(ARM_COSTS, ARM_REDEMPTION)


def net_values(df: DataFrame, effects: Sequence[str], costs: Sequence[float] = COSTS) -> DataFrame:
    """Adds net: per arm effect less expected cost, 0 for the control arm; missing effects stay missing."""
    return df.withColumn("net", F.array(F.lit(0.0), *[F.col(c).cast("double") - k for c, k in zip(effects, costs[1:], strict=True)]))


def risk_terciles(df: DataFrame, risk: str, key: str) -> DataFrame:
    """Adds tercile: 0, 1 or 2 by average percentile rank; 1 where risk is missing or everywhere equal.

    Ranks come from counts of distinct risks in a global order.
    """
    cells = df.where(F.col(risk).isNotNull()).groupBy(F.col(risk).alias("__r")).agg(F.count("*").alias("__c"))
    ranked = running(cells, F.col("__r"), [], {"__upto": F.col("__c")}, "__rn")
    totals = cells.agg(F.sum("__c").alias("__n"), F.count("*").alias("__d"))
    pct = (F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2) / F.col("__n")
    t = F.when(F.col("__d") == 1, 1).when(pct <= 1 / 3, 0).when(pct <= 2 / 3, 1).otherwise(2)
    grades = ranked.crossJoin(F.broadcast(totals)).select("__r", t.alias("tercile"))
    return df.join(grades, df[risk] == F.col("__r"), "left").drop("__r").withColumn("tercile", F.coalesce("tercile", F.lit(1)))


def decision_frame(df: DataFrame, key: str, effects: Sequence[str], risk: str, costs: Sequence[float] = COSTS) -> DataFrame:
    """(key, net per arm, arm, arm_name, expected_net, tercile, segment, priority): the best arm, doing nothing winning ties.

    Segments: an effect above 0 makes a persuadable unless the risk is lowest (sure thing); without one the highest
    risks are lost causes, and units that every offer harms sleeping dogs. priority is the dense rank of expected_net.
    """
    out = risk_terciles(net_values(df, effects, costs), risk, key)
    best = F.greatest(*[F.col(c) for c in effects])
    segment = (
        F.when((best > 0) & (F.col("tercile") > 0), "persuadable").when((best > 0) & (F.col("tercile") == 0), "sure_thing")
        .when((best < 0) & (F.col("tercile") < 2), "sleeping_dog").when(F.col("tercile") == 2, "lost_cause").otherwise("sure_thing")
    )
    out = out.withColumn("arm", first_argmax(F.col("net"))).withColumn("expected_net", F.greatest(F.array_max("net"), F.lit(0.0)))
    out = out.withColumn("arm_name", F.element_at(F.array(*[F.lit(a) for a in ARM_NAMES]), F.col("arm") + 1)).withColumn("segment", segment)
    values = out.select("expected_net").distinct()
    ranks = running(values, -F.col("expected_net"), [], number="priority")
    return out.join(ranks, "expected_net").select(key, *[F.col("net")[a].alias(f"net_{a}") for a in range(len(costs))], "arm", "arm_name", "expected_net", "tercile", "segment", "priority")


def roi_summary(df: DataFrame, arm: str, net: str, costs: Sequence[float] = COSTS) -> DataFrame:
    """(n_targeted, cost, net, gross, roi) of an assignment; arms without a finite value are counted but bring nothing."""
    cost = F.element_at(F.array(*[F.lit(float(c)) for c in costs]), (F.col(arm) + 1).cast("int"))
    value = F.element_at(F.col(net), (F.col(arm) + 1).cast("int"))
    ok = (F.col(arm) > 0) & value.isNotNull() & ~F.isnan(value)
    sums = df.agg(F.count_if(F.col(arm) > 0).alias("n_targeted"), F.coalesce(F.sum(F.when(ok, cost)), F.lit(0.0)).alias("cost"), F.coalesce(F.sum(F.when(ok, value)), F.lit(0.0)).alias("net"))
    return sums.withColumn("gross", F.col("net") + F.col("cost")).withColumn("roi", F.when(F.col("cost") > 0, F.col("net") / F.col("cost")))


def per_arm(df: DataFrame, arm: str, net: str, costs: Sequence[float] = COSTS) -> DataFrame:
    """(arm, n, cost, value) of every arm, empty ones included."""
    arms = df.sparkSession.createDataFrame([(a, float(c)) for a, c in enumerate(costs)], "arm int, unit double")
    got = df.groupBy(F.col(arm).cast("int").alias("arm")).agg(F.count("*").alias("n"), F.sum(F.element_at(F.col(net), (F.col(arm) + 1).cast("int"))).alias("value"))
    return arms.join(got, "arm", "left").select("arm", F.coalesce("n", F.lit(0)).alias("n"), (F.col("unit") * F.coalesce("n", F.lit(0))).alias("cost"), F.coalesce("value", F.lit(0.0)).alias("value"))


def assign_at(net: Column, price: float, costs: Sequence[float] = COSTS) -> Column:
    """The arm with the largest net value less ``price`` times cost; doing nothing wins ties, missing arms never win."""
    return first_argmax(F.transform(net, lambda v, i: v - price * F.element_at(F.array(*[F.lit(float(c)) for c in costs]), i + 1)))


def breakeven(costs: Sequence[float] = ARM_COSTS, redemption: Sequence[float] = ARM_REDEMPTION, fixed: float = 0.0) -> list[float]:
    """Per arm the effect that pays for the offer."""
    return expected_costs(costs, redemption, fixed)


def off_policy(df: DataFrame, y: str, arm: str, chosen: str, e: Sequence[str], mu: Sequence[str] | None = None, cap: float = 50.0) -> DataFrame:
    """(n, n_match, ess, ipw, snipw, dr, se_ipw, se_snipw, se_dr): the value of the chosen arms from logged outcomes, in one pass and one for errors.

    Weights are 1 / propensity where logged and chosen arms agree, at most ``cap``; dr falls back to snipw without outcome models.
    """
    p = F.element_at(F.array(*e), (F.col(arm) + 1).cast("int"))
    w = F.when(F.col(arm) == F.col(chosen), F.least(1 / p, F.lit(float(cap)))).otherwise(0.0)
    m = F.element_at(F.array(*mu), (F.col(chosen) + 1).cast("int")) if mu else F.lit(None).cast("double")
    rows = df.select(F.col(y).cast("double").alias("y"), w.alias("w"), m.alias("m")).withColumn("d", F.col("m") + F.col("w") * (F.col("y") - F.col("m")))
    sn = rows.agg((F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("sn"), F.avg("w").alias("mw"))
    r = F.col("w") * (F.col("y") - F.col("sn")) / F.col("mw")
    return rows.crossJoin(F.broadcast(sn)).agg(
        F.count("*").alias("n"), F.count_if(F.col("w") > 0).alias("n_match"), (F.pow(F.sum("w"), 2) / F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).alias("ess"),
        F.avg(F.col("w") * F.col("y")).alias("ipw"), F.first("sn").alias("snipw"), F.coalesce(F.avg("d"), F.first("sn")).alias("dr"),
        (F.stddev_samp(F.col("w") * F.col("y")) / F.sqrt(F.count("*"))).alias("se_ipw"), (F.stddev_samp(r) / F.sqrt(F.count("*"))).alias("se_snipw"),
        (F.stddev_samp(F.coalesce("d", r)) / F.sqrt(F.count("*"))).alias("se_dr"),
    )


def bootstrap_differences(df: DataFrame, key: str, values: Mapping[str, Column], baseline: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """(policy, diff, diff_low, diff_high, beats_baseline): paired differences of mean values under Poisson(1) resampling.

    A row's weight in a replicate comes from a hash of its key, so all policies share it and results do not depend on
    partitioning. Replicates are summed within tasks; a row per policy and replicate is shuffled. Hashes are compared as
    the hex digits that they are, with the least ones at or above each cut.
    """
    from .splits import hashed

    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # spread first: a small shuffle comes out in few parts, and a task of those would hash for all replicates alone
    base = written(df.select(key, *[v.cast("double").alias(f"__{k}") for k, v in values.items()]).repartition(n, key))
    rows = base.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rows = rows.withColumn("__h", F.substring(hashed(seed, key, "b"), 1, 12)).withColumn("__w", sum((F.col("__h") >= f"{math.ceil(c * (1 << 48)):012x}").cast("int") for c in cut))
    sums = rows.groupBy("b").agg(*[(F.sum(F.col("__w") * F.col(f"__{k}")) / F.sum("__w")).alias(k) for k in values])
    long = sums.select("b", F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), (F.col(k) - F.col(baseline)).alias("d")) for k in values if k != baseline])))
    point = base.agg(*[F.avg(f"__{k}").alias(k) for k in values]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), (F.col(k) - F.col(baseline)).alias("diff")) for k in values if k != baseline])))
    ci = long.groupBy("policy").agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return point.join(ci, "policy").select("policy", "diff", F.col("q")[0].alias("diff_low"), F.col("q")[1].alias("diff_high"), (F.col("q")[0] > 0).alias("beats_baseline"))


def oracle_gap(df: DataFrame, chosen: str, true_net: Sequence[str]) -> DataFrame:
    """(realised, oracle, regret, pct_match): the chosen arms' true net value against that of each row's best arm."""
    arr = F.array(*[F.col(c).cast("double") for c in true_net])
    best = first_argmax(arr)
    got = F.element_at(arr, (F.col(chosen) + 1).cast("int"))
    return df.agg(F.sum(got).alias("realised"), F.sum(F.array_max(arr)).alias("oracle"), (F.sum(F.array_max(arr)) - F.sum(got)).alias("regret"), (100 * F.avg((best == F.col(chosen)).cast("double"))).alias("pct_match"))


def fairness_audit(df: DataFrame, arm: str, group: str, net: str | None = None) -> DataFrame:
    """(grp, n, treat_rate, mean_net, opportunity, parity_diff, parity_ratio): per group and OVERALL; a missing group is 'unknown'.

    opportunity is the treat rate among rows with a positive net value; differences and ratios are against the best group.
    """
    g = F.coalesce(F.col(group).cast("string"), F.lit("unknown"))
    t, v = (F.col(arm) > 0).cast("double"), (F.col(net) if net else F.lit(None)).cast("double")
    rows = df.select(g.alias("grp"), t.alias("t"), v.alias("v"))
    agg = [F.count("*").alias("n"), F.avg("t").alias("treat_rate"), F.avg("v").alias("mean_net"), F.avg(F.when(F.col("v") > 0, F.col("t"))).alias("opportunity")]
    groups = rows.groupBy("grp").agg(*agg)
    every = rows.agg(*agg).select(F.lit("OVERALL").alias("grp"), "n", "treat_rate", "mean_net", "opportunity")
    top = groups.agg(F.max("treat_rate").alias("__top"))
    out = groups.unionByName(every).crossJoin(F.broadcast(top))
    return out.select("grp", "n", "treat_rate", "mean_net", "opportunity", (F.col("treat_rate") - F.col("__top")).alias("parity_diff"), F.when(F.col("__top") > 0, F.col("treat_rate") / F.col("__top")).alias("parity_ratio"))


def disparate_impact(df: DataFrame, arm: str, group: str) -> DataFrame:
    """(ratio): the lowest treat rate of a group over the highest; 1 for a single group or if nobody is treated."""
    rates = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("g")).agg(F.avg((F.col(arm) > 0).cast("double")).alias("r"))
    return rates.agg(F.when(F.count("*") == 0, float("nan")).when((F.count("*") == 1) | (F.max("r") == 0), 1.0).otherwise(F.min("r") / F.max("r")).alias("ratio"))
