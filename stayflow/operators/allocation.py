"""Budgeted allocation over the upper hull of each unit's offers.

Per unit the offers that no mix of others beats form a chain of upgrades with falling value per further cost. All
upgrades of all units in order of that ratio, with running costs, hold the answer for every budget: the price of a
budget is the ratio of the first upgrades that do not fit, and the linear relaxation takes part of those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.scalars import first_argmax
from ..functions.tables import written
from .economics import COSTS
from .splits import hashed

_STEP = "struct<slope:double,upto:double,arm:int,dv:double,dc:double>"


def upgrades(net: Column, costs: Sequence[float] = COSTS) -> Column:
    """The chain of upgrades from doing nothing: (slope, upto, arm, dv, dc) with falling slopes; missing values are no offer."""
    cost = F.array(*[F.lit(float(c)) for c in costs])
    value = F.transform(net, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(float("-inf"))).otherwise(v))

    def take(chain, _):
        at = F.coalesce(F.try_element_at(chain, F.lit(-1))["arm"], F.lit(0))
        v0, c0 = F.when(at > 0, F.element_at(value, at + 1)).otherwise(0.0), F.element_at(cost, at + 1)
        options = F.transform(value, lambda v, a: F.struct(((v - v0) / F.nullif(F.element_at(cost, a + 1) - c0, F.lit(0.0))).alias("slope"), F.element_at(cost, a + 1).alias("upto"), a.alias("arm"), (v - v0).alias("dv"), (F.element_at(cost, a + 1) - c0).alias("dc")))
        best = F.array_max(F.filter(options, lambda o: (o["dc"] > 0) & (o["dv"] > 0)))
        return F.when(best.isNull(), chain).otherwise(F.concat(chain, F.array(best)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(costs) - 1)), F.array().cast(f"array<{_STEP}>"), take)


def with_upgrades(df: DataFrame, net: str, costs: Sequence[float] = COSTS, name: str = "__chain") -> DataFrame:
    """Adds the chain of ``upgrades`` as the column ``name``.

    Each step is a column of its own over the one before it, so that it is worked out once a row; as nested array
    functions the chain would be evaluated again for every offer and every use of it. A written table: a filter pushed
    below the steps would nest them again.
    """
    paid = [float(c) for c in costs]
    cost = F.array(*[F.lit(c) for c in paid])
    values = [F.when(v.isNull() | F.isnan(v), F.lit(float("-inf"))).otherwise(v) for v in (F.element_at(F.col(net), a + 1).cast("double") for a in range(len(paid)))]
    out = df.withColumn("__v", F.array(*values))
    steps = [f"__s{i}" for i in range(1, len(paid))]
    for last, step in zip([None, *steps], steps):  # noqa: B905
        at = F.lit(0) if last is None else F.col(f"{last}.arm")
        out = out.withColumns({"__v0": F.lit(0.0) if last is None else F.element_at("__v", at + 1), "__c0": F.element_at(cost, at + 1)})
        options = []
        for a, c in enumerate(paid):
            dv, dc = F.col("__v")[a] - F.col("__v0"), F.lit(c) - F.col("__c0")
            options.append(F.when((dc > 0) & (dv > 0), F.struct((dv / F.nullif(dc, F.lit(0.0))).alias("slope"), F.lit(c).alias("upto"), F.lit(a).alias("arm"), dv.alias("dv"), dc.alias("dc"))))
        out = out.withColumn(step, F.greatest(*options))
    return written(out.withColumn(name, F.array_compact(F.array(*steps))).drop("__v", "__v0", "__c0", *steps))


def prices(df: DataFrame, net: str, budgets: Sequence[float], costs: Sequence[float] = COSTS) -> list[dict]:
    """Per budget its price, spent, value, bound (also the value of the linear relaxation) and treated units, from one ordered table of all upgrades."""
    return _prices(with_upgrades(df.select(net), net, costs), budgets)


def _prices(chains: DataFrame, budgets: Sequence[float]) -> list[dict]:
    steps = chains.select(F.inline("__chain"))
    cells = written(steps.groupBy("slope").agg(F.sum("dc").alias("dc"), F.sum("dv").alias("dv")))
    ordered = running(cells, -F.col("slope"), [], {"upto": F.col("dc")}).persist()
    budgets = [float(b) for b in budgets]
    # a running sum that rounding alone lifts above the budget fits
    first = ordered.agg(*[F.coalesce(F.max(F.when(F.col("upto") > b * (1 + 1e-12), F.col("slope"))), F.lit(0.0)).alias(f"p{i}") for i, b in enumerate(budgets)]).first()
    took = lambda i: F.col("slope") > first[f"p{i}"]
    got = ordered.agg(*[F.coalesce(F.sum(F.when(took(i), F.col(c))), F.lit(0.0)).alias(f"{c}{i}") for i in range(len(budgets)) for c in ("dc", "dv")]).first()
    ordered.unpersist()
    return [
        {"budget": b, "price": first[f"p{i}"], "spent": got[f"dc{i}"], "value": got[f"dv{i}"], "bound": got[f"dv{i}"] + first[f"p{i}"] * (b - got[f"dc{i}"])}
        for i, b in enumerate(budgets)
    ]


def fill(items: DataFrame, lead: Column, key: str, cost: str, budget: float) -> DataFrame:
    """The items that fit one after another in descending order of ``lead`` (ties by the column ``key``, which tells all items apart): one that does not fit is passed over.

    Until an item does not fit, those that do are a prefix, found by running sums; from then on no item of that cost or
    more can fit. So there are at most as many rounds as there are distinct costs.
    """
    rows = written(items.withColumn("__order", lead))
    taken, left, after = None, float(budget), None
    while True:
        now = rows.where(F.col(cost) <= left + 1e-9)
        if after is not None:
            now = now.where((F.col("__order") < after[0]) | ((F.col("__order") == after[0]) & (F.col(key) > after[1])))
        now = running(now, -F.col("__order"), [F.col(key)], {"__upto": F.col(cost)}).persist()
        over = now.where(F.col("__upto") > left + 1e-9).agg(F.min("rn").alias("rn")).first()["rn"]
        part = now if over is None else now.where(F.col("rn") < over)
        taken = part if taken is None else taken.unionByName(part)
        if over is None:
            return taken.select(*items.columns)
        left -= part.agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
        stop = now.where(F.col("rn") == over).first()
        after = (stop["__order"], stop[key])


def lagrangian_allocate(df: DataFrame, net: str, key: str, budget: float, costs: Sequence[float] = COSTS, top_up: bool = True) -> tuple[DataFrame, dict]:
    """Adds arm under a budget, and tells (price, spent, value, bound) before what is left is spent.

    Each unit takes its upgrades worth more than the price. With ``top_up`` the rest of the budget goes to each unit's
    next upgrade, in order of value per cost, passing over what does not fit.
    """
    chain = with_upgrades(df, net, costs)
    told = _prices(chain, [budget])[0]
    taken = F.filter("__chain", lambda s: s["slope"] > told["price"])
    chain = chain.withColumn("__n", F.size(taken)).withColumn("arm", F.coalesce(F.try_element_at(taken, F.lit(-1))["arm"], F.lit(0)))
    left = budget - told["spent"]
    if top_up and left > 0:
        following = chain.select(key, F.try_element_at("__chain", F.col("__n") + 1).alias("s")).where("s IS NOT NULL").select(key, F.col("s.arm").alias("__more"), F.col("s.dc").alias("__dc"), F.col("s.slope").alias("__slope"))
        more = fill(following, F.col("__slope"), key, "__dc", left).select(key, "__more")
        chain = chain.join(more, key, "left").withColumn("arm", F.coalesce("__more", "arm")).drop("__more")
    return chain.drop("__chain", "__n"), told


def efficient_frontier(df: DataFrame, net: str, budgets: Sequence[float], costs: Sequence[float] = COSTS) -> DataFrame:
    """(budget, value, spent, price, bound, marginal): all budgets from one table; values never fall, marginal is the value per further unit of budget."""
    grid = df.sparkSession.createDataFrame([(r["budget"], r["value"], r["spent"], r["price"], r["bound"]) for r in prices(df, net, sorted(budgets), costs)], "budget double, raw double, spent double, price double, bound double")
    w = Window.orderBy("budget")  # a row per budget
    top = grid.withColumn("value", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    marginal = (F.col("value") - F.lag("value").over(w)) / (F.col("budget") - F.lag("budget").over(w))
    return top.select("budget", "value", "spent", "price", "bound", marginal.alias("marginal"))


def greedy_allocate(df: DataFrame, net: str, key: str, budget: float, costs: Sequence[float] = COSTS) -> DataFrame:
    """(key, arm, cost, value) of the units funded: each by its best arm on value per cost, in that order, passing over what does not fit."""
    cost = F.array(*[F.lit(float(c)) for c in costs])
    ratio = F.transform(net, lambda v, i: F.when((i > 0) & (v > 0), v / F.greatest(F.element_at(cost, i + 1), F.lit(1e-12))).otherwise(F.lit(float("-inf"))))
    rows = df.withColumn("__ratio", F.array_max(ratio)).withColumn("arm", first_argmax(ratio)).where(F.col("__ratio") > 0)
    rows = rows.select(key, "arm", F.element_at(cost, F.col("arm") + 1).alias("cost"), F.element_at(F.col(net), F.col("arm") + 1).alias("value"), "__ratio")
    return fill(rows, F.col("__ratio"), key, "cost", budget).select(key, "arm", "cost", "value")


def repair_budget(df: DataFrame, key: str, cost: str, value: str, budget: float) -> DataFrame:
    """The rows that stay when those of least value per cost go until the rest fits."""
    paid = df.where(F.col(cost) > 0)
    total = paid.agg(F.coalesce(F.sum(cost), F.lit(0.0))).first()[0]
    out = running(paid, F.col(value) / F.col(cost), [F.col(key)], {"__upto": F.col(cost)})
    return out.where(total - (F.col("__upto") - F.col(cost)) <= budget).select(*df.columns).unionByName(df.where(~(F.col(cost) > 0)))


def pareto_keep(net: Column, costs: Sequence[float] = COSTS) -> Column:
    """The arms that no other one beats in value at the same cost or less, of equal ones the first."""
    cost = [float(c) for c in costs]
    value = lambda a: F.coalesce(F.element_at(net, a + 1), F.lit(float("-inf")))
    beaten = lambda a: [(value(b) >= value(a)) if cost[b] < cost[a] or b < a else (value(b) > value(a)) for b in range(len(cost)) if b != a and cost[b] <= cost[a]]
    flags = []
    for a in range(len(cost)):
        any_ = F.lit(False)
        for c in beaten(a):
            any_ = any_ | c
        flags.append(F.when(~any_, F.lit(a)))
    return F.array_compact(F.array(*flags))


def baseline_policies(df: DataFrame, key: str, risk: str, value: str, cost: float, budget: float, seed: int = 7) -> DataFrame:
    """(policy, key): the units that the cheapest offer reaches by each rule; treat_none reaches nobody.

    All units cost the same, so passing over what does not fit and stopping there are the same, and a top-n suffices.
    """
    n = int((budget + 1e-9) // cost) if cost > 0 else df.count()
    order = {
        "treat_all": [F.col(key)], "highest_risk": [F.desc_nulls_last(risk), F.col(key)], "highest_clv": [F.desc_nulls_last(value), F.col(key)],
        "risk_x_clv": [(F.col(risk) * F.col(value)).desc_nulls_last(), F.col(key)], "random": [hashed(seed, key), F.col(key)],
    }
    out = df.select(F.lit("treat_none").alias("policy"), F.col(key)).limit(0)
    for name, by in order.items():
        out = out.unionByName(df.orderBy(*by).limit(n).select(F.lit(name).alias("policy"), F.col(key)))
    return out


def summary(df: DataFrame, arm: str, net: str, budget: float, costs: Sequence[float] = COSTS) -> DataFrame:
    """(n, n_treated, spent, value, roi, utilisation) of an allocation."""
    at = (F.col(arm) + 1).cast("int")
    s = df.agg(F.count("*").alias("n"), F.count_if(F.col(arm) > 0).alias("n_treated"), F.sum(F.element_at(F.array(*[F.lit(float(c)) for c in costs]), at)).alias("spent"), F.sum(F.when(F.col(arm) > 0, F.element_at(F.col(net), at)).otherwise(0.0)).alias("value"))
    return s.withColumn("roi", F.when(F.col("spent") > 0, F.col("value") / F.col("spent"))).withColumn("utilisation", F.when(F.lit(budget) > 0, F.col("spent") / budget))


def parity_allocate(df: DataFrame, net: str, key: str, group: str, budget: float, costs: Sequence[float] = COSTS, steps: int = 200) -> tuple[DataFrame, float]:
    """(key, group, arm of the units treated, the share): the largest share, in steps, such that treating that share of every group fits.

    A group's units are ordered by their best arm's value; costs by group and step are all that reaches the driver.
    """
    cost = F.array(*[F.lit(float(c)) for c in costs])
    rows = df.select(key, F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias(group), first_argmax(F.col(net)).alias("arm"), F.array_max(net).alias("__v")).withColumn("__c", F.element_at(cost, F.col("arm") + 1))
    sizes = {r[group]: r["n"] for r in rows.groupBy(group).agg(F.count("*").alias("n")).collect()}
    ranked = None
    for g, n in sorted(sizes.items()):  # few groups
        own = running(rows.where((F.col(group) == g) & (F.col("arm") > 0)), -F.col("__v"), [F.col(key)]).withColumn("__step", F.ceil(F.col("rn") * steps / n))
        ranked = own if ranked is None else ranked.unionByName(own)
    ranked = ranked.persist()
    spent = {(r[group], r["__step"]): r["c"] for r in ranked.groupBy(group, "__step").agg(F.sum("__c").alias("c")).collect()}
    most = {g: max((s for h, s in spent if h == g), default=0) for g in sizes}
    best, total = 0, 0.0
    for step in range(1, min(most.values(), default=0) + 1):  # no group is asked for more than has a use for an offer
        total += sum(spent.get((g, step), 0.0) for g in sizes)
        if total > budget:
            break
        best = step
    return ranked.where(F.col("__step") <= best).select(key, group, "arm"), best / steps
