"""Survival operators on (time, event) columns. Curves are aggregates over distinct times, summed by ranges of time, so times may be continuous."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.tables import written

#: Curves of more steps than this are joined by ranges instead of travelling as one array.
ARRAY_STEPS = 4096
#: Bits of a digit of a time's place in ``concordance``.
DIGIT = 3


def person_period(df: DataFrame, time: str, event: str, horizon: int, keep: Sequence[str]) -> DataFrame:
    """A row per unit and period lived, up to the horizon: (keep, period from 0, event = 1 in the last one if it ended there)."""
    whole = F.ceil(F.col(time) - 1e-9)
    n = F.greatest(F.least(whole, F.lit(horizon)), F.lit(1)).cast("int")
    rows = df.select(*keep, n.alias("__n"), (F.col(event).cast("boolean") & (whole <= horizon)).alias("__e"), F.explode(F.sequence(F.lit(0), n - 1)).alias("period"))
    return rows.select(*keep, "period", (F.col("__e") & (F.col("period") == F.col("__n") - 1)).cast("int").alias("event"))


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, n_events, n_at_risk, survival, greenwood) at the times of events; rows without a time take no part.

    Rows are counted by time, and running sums over ranges of time give those at risk and the logarithms of the curve,
    so no task holds all times of a group. greenwood is the sum of d / (n (n - d)) so far, null once nobody is left.
    """
    times = df.where(F.col(time).isNotNull()).groupBy(*by, F.col(time).cast("double").alias("t")).agg(F.sum(F.col(event).cast("int")).alias("n_events"), F.count("*").alias("__n"))
    # from the last time back, the running count is the number at risk
    counted = written(running(written(times), -F.col("t"), [], {"n_at_risk": F.col("__n")}, "__rn", by=by).where("n_events > 0"))
    d, n = F.col("n_events"), F.col("n_at_risk")
    sums = {"__log": F.when(n > d, F.log1p(-d / n)).otherwise(0.0), "__gone": (n == d).cast("int"), "__green": F.when(n > d, d / (n * (n - d))).otherwise(0.0)}
    curve = running(counted, F.col("t"), [], sums, "__rn", by=by)
    alive = F.col("__gone") == 0
    return curve.select(*by, "t", "n_events", "n_at_risk", F.when(alive, F.exp("__log")).otherwise(0.0).alias("survival"), F.when(alive, F.col("__green")).alias("greenwood"))


def censoring_survival(df: DataFrame, time: str, event: str, least: float = 1e-3, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, g): the probability to be uncensored beyond t, at least ``least``."""
    flipped = df.withColumn("__censored", 1 - F.col(event).cast("int"))
    return kaplan_meier(flipped, time, "__censored", by).select(*by, "t", F.greatest(F.col("survival"), F.lit(least)).alias("g"))


def step_lookup(df: DataFrame, at: Column, curve: DataFrame, value: str, name: str, before: float = 1.0, left: bool = False) -> DataFrame:
    """Adds the value of a step curve (t, value) at ``at``: of the last t not above it, or with ``left`` of the last below; ``before`` ahead of the first and where ``at`` is null.

    A curve of at most ARRAY_STEPS steps travels as one sorted array. The steps of a longer one are numbered together
    with the distinct places asked for, over ranges of time: a place's number of steps names its step.
    """
    curve = written(curve.select(F.col("t").cast("double").alias("t"), F.col(value).alias("v")))
    if curve.count() <= ARRAY_STEPS:
        steps = curve.agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("__steps"))
        below = F.filter("__steps", lambda s: (s["t"] < at) if left else (s["t"] <= at))
        found = df.crossJoin(F.broadcast(steps))  # a single row of at most ARRAY_STEPS steps
        return found.withColumn(name, F.coalesce(F.try_element_at(below, F.lit(-1))["v"], F.lit(before))).drop("__steps")
    rows = df.withColumn("__at", at.cast("double"))
    asked = rows.select(F.col("__at").alias("t")).where("t IS NOT NULL").distinct()
    marks = curve.withColumn("__step", F.lit(1)).unionByName(asked.withColumn("__step", F.lit(0)), allowMissingColumns=True)
    numbered = written(running(written(marks), F.col("t"), [F.col("__step") if left else F.desc("__step")], {"__upto": F.col("__step")}, "__rn"))
    steps = numbered.where("__step = 1").select("__upto", "v")
    found = numbered.where("__step = 0").select(F.col("t").alias("__at"), "__upto").join(steps, "__upto", "left").select("__at", F.col("v").alias("__found"))
    out = rows.join(found, "__at", "left").withColumn(name, F.coalesce("__found", F.lit(before)))
    return out.select(*[c for c in df.columns if c != name], name)


def restricted_outcome(df: DataFrame, time: str, event: str, horizon: int, rate: float = 0.0) -> DataFrame:
    """Adds periods (whole periods survived within the horizon), follow_up, complete and value (the periods discounted)."""
    k = F.greatest(F.ceil(F.col(time) - 1e-9), F.lit(1))
    periods = F.least(F.greatest(F.least(k - F.col(event).cast("int"), F.lit(horizon)), F.lit(0)), F.lit(horizon))
    value = periods.cast("double") if rate == 0 else (1 - F.pow(F.lit(1 + rate), -periods)) / rate
    complete = F.col(event).cast("boolean") | (k >= horizon)
    return df.withColumns({"periods": periods, "follow_up": F.least(k, F.lit(horizon)), "complete": complete, "value": value})


def ipcw(df: DataFrame, time: str, event: str, horizon: int, rate: float = 0.0, least: float = 1e-3) -> DataFrame:
    """Adds weight (1 / G just before the observed end for complete rows, else 0) and pseudo (value times weight)."""
    out = restricted_outcome(df, time, event, horizon, rate)
    g = step_lookup(out, F.col("follow_up").cast("double"), censoring_survival(df, time, event, least), "g", "__g", left=True)
    weight = F.when(F.col("complete"), 1 / F.greatest(F.col("__g"), F.lit(least))).otherwise(0.0)
    return g.withColumn("weight", weight).withColumn("pseudo", F.col("value") * weight).drop("__g")


def concordance(df: DataFrame, time: str, event: str, risk: str) -> DataFrame:
    """(concordant, tied, pairs, c_index): of pairs in which one unit's event comes before the other's end, how often it had the higher risk.

    A unit censored at the time of an event counts as ending later. Units are counted by (time, event, risk) and the
    distinct (time, event) are numbered in order. Two numbers differ first in one digit, so every pair meets once, in
    the block of those whose higher digits agree; there running counts over risk, one for each digit, tell how many of
    larger digit had a lower risk. Rows grow with the units times the digits of the number of distinct times, and a
    block is cut into ranges of risk, so both may be continuous. Rows with a null in any of the three take no part.
    """
    cells = df.groupBy(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r")).agg(F.count("*").alias("n")).where("t IS NOT NULL AND e IS NOT NULL AND r IS NOT NULL")
    cells = written(cells)
    places = written(running(cells.select("t", "e").distinct(), F.col("t"), [F.desc("e")], number="place"))
    levels = max(1, -(-places.count().bit_length() // DIGIT))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cells.agg(F.array_distinct(F.percentile_approx("r", [i / parts for i in range(1, parts)] or [0.5], 1000)).alias("cuts"))  # a single row
    ranged = cells.join(places, ["t", "e"]).crossJoin(F.broadcast(cuts)).select("place", "e", "r", "n", F.size(F.filter("cuts", lambda b: b < F.col("r"))).alias("range"))
    rows = ranged.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    rows = rows.withColumn("block", F.expr(f"shiftright(place, {DIGIT} * (level + 1))")).withColumn("digit", F.expr(f"shiftright(place, {DIGIT} * level) & {(1 << DIGIT) - 1}"))
    digits = range((1 << DIGIT) - 1)  # nothing is larger than the last digit
    sums = [F.sum(F.when(F.col("digit") > d, F.col("n")).otherwise(0)).alias(f"o{d}") for d in digits] + [F.sum(F.when((F.col("digit") == d) & (F.col("e") == 1), F.col("n")).otherwise(0)).alias(f"c{d}") for d in digits]
    met = written(rows.groupBy("level", "block", "range", "r").agg(*sums))
    block = ["level", "block"]
    whole = Window.partitionBy(*block)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = met.groupBy(*block, "range").agg(*[F.sum(f"o{d}").alias(f"o{d}") for d in digits])
    offsets = totals.select(*block, "range", *[F.coalesce(F.sum(f"o{d}").over(before), F.lit(0)).alias(f"b{d}") for d in digits], *[F.sum(f"o{d}").over(whole).alias(f"a{d}") for d in digits])
    inside = Window.partitionBy(*block, "range").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    lower = met.select("*", *[F.coalesce(F.sum(f"o{d}").over(inside), F.lit(0)).alias(f"l{d}") for d in digits]).join(offsets, [*block, "range"])
    over = lambda f: F.coalesce(F.sum(sum((F.col(f"c{d}") * f(d) for d in digits), F.lit(0))), F.lit(0))
    got = lower.agg(
        over(lambda d: F.col(f"l{d}") + F.col(f"b{d}")).alias("concordant"), over(lambda d: F.col(f"o{d}")).alias("tied"), over(lambda d: F.col(f"a{d}")).alias("pairs"),
    )
    return got.withColumn("c_index", F.when(F.col("pairs") > 0, (F.col("concordant") + F.col("tied") / 2) / F.col("pairs")))


def time_dependent_auc(df: DataFrame, time: str, event: str, risk: str, times: Sequence[float], least: float = 1e-3, before: Column | None = None) -> DataFrame:
    """(tau, n_cases, n_controls, auc): cases with an event up to tau, weighted by 1 / G before it, against units that live longer.

    ``before``: each row's own probability to be uncensored until its end, where censoring depends on the features.
    """
    g = step_lookup(df, F.col(time).cast("double"), censoring_survival(df, time, event, least), "g", "__g", left=True) if before is None else df.withColumn("__g", before)
    rows = g.select(F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("tau"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r"), "__g")
    case = (F.col("t") <= F.col("tau")) & (F.col("e") == 1)
    control = F.col("t") > F.col("tau")
    cells = rows.groupBy("tau", "r").agg(F.coalesce(F.sum(F.when(case, 1 / F.col("__g"))), F.lit(0.0)).alias("w"), F.count_if(case).alias("n"), F.count_if(control).alias("c"))
    scored = running(cells, F.col("r"), [], {"upto": F.col("c")}, "__rn", by=["tau"]).withColumn("below", F.col("upto") - F.col("c"))
    sums = scored.groupBy("tau").agg(F.sum(F.col("w") * (F.col("below") + F.col("c") / 2)).alias("won"), F.sum("w").alias("w"), F.sum("n").alias("n_cases"), F.sum("c").alias("n_controls"))
    return sums.select("tau", "n_cases", "n_controls", F.when((F.col("w") > 0) & (F.col("n_controls") > 0), F.col("won") / (F.col("w") * F.col("n_controls"))).alias("auc"))


def brier(df: DataFrame, time: str, event: str, survival: Column, times: Sequence[float], least: float = 1e-3, before: Column | None = None, at: Column | None = None) -> DataFrame:
    """(tau, brier): the inverse-probability weighted squared error of ``survival`` (an expression of the column tau).

    ``before`` and ``at`` (of tau): each row's own probabilities to be uncensored until its end and beyond tau, where
    censoring depends on the features; else one curve serves all rows.
    """
    rows = df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    if before is None or at is None:
        curve = censoring_survival(df, time, event, least)
        rows = step_lookup(rows, F.col(time).cast("double"), curve, "g", "__before", left=True)
        rows = step_lookup(rows, F.col("tau"), curve, "g", "__at")
    else:
        rows = rows.withColumns({"__before": before, "__at": at})
    dead = (F.col(time) <= F.col("tau")) & F.col(event).cast("boolean")
    error = F.when(dead, F.pow(survival, 2) / F.col("__before")).when(F.col(time) > F.col("tau"), F.pow(1 - survival, 2) / F.col("__at")).otherwise(0.0)
    return rows.groupBy("tau").agg(F.avg(error).alias("brier"))


def trapezoid(df: DataFrame, x: str, y: str, normalise: bool = True) -> DataFrame:
    """(area): the trapezoid area under the few points (x, y), divided by the range of x if asked."""
    w = Window.orderBy(x)
    steps = df.select(F.col(x), ((F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).alias("a"))
    area = F.sum("a") / (F.max(x) - F.min(x)) if normalise else F.sum("a")
    return steps.agg(area.alias("area"))


def calibration(df: DataFrame, time: str, event: str, survival: str, t: float, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_predicted, observed): bins of equal counts by predicted survival, each with its Kaplan-Meier value at t.

    A row of rank i (from 0) of n is in bin floor(i * bins / n).
    """
    ranked = running(df, F.col(survival), [F.col(key)])
    n = df.count()
    binned = ranked.withColumn("bin", F.floor((F.col("rn") - 1) * bins / n).cast("int"))
    curves = kaplan_meier(binned, time, event, ["bin"]).where(F.col("t") <= t).groupBy("bin").agg(F.max_by("survival", "t").alias("s"))
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(survival).alias("mean_predicted"))
    return means.join(curves, "bin", "left").select("bin", "n", "mean_predicted", F.coalesce("s", F.lit(1.0)).alias("observed"))
