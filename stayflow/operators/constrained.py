"""Allocation under further constraints: a capacity per arm, equal treatment of groups, and the policies to compare with.

Prices are found from sums: one aggregate tells for a whole grid of candidate prices what units would choose, so a
search over a price takes two or three passes, and no unit reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..functions.tables import written
from .allocation import fill, prices
from .economics import COSTS
from .splits import hashed

#: Candidate prices of a pass.
GRID = 16


def _choice(net: str, costs: Sequence[float], price: float | Column, capacity_prices: Sequence[float | Column]) -> Column:
    """(worth, arm) of the arm that is worth most after prices; arm 0 where none is worth anything, the lower arm of equal ones."""
    value = lambda a: F.coalesce(F.nanvl(F.col(net)[a].cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    options = [F.struct(F.lit(0.0).alias("worth"), F.lit(0).alias("arm"))]
    options += [F.struct((value(a) - price * float(costs[a]) - capacity_prices[a]).alias("worth"), F.lit(-a).alias("arm")) for a in range(1, len(costs))]
    best = F.array_max(F.array(*options))
    return F.struct(best["worth"].alias("worth"), (-best["arm"]).alias("arm"))


def _asked(rows: DataFrame, net: str, costs: Sequence[float], candidates: Sequence[tuple[float, Sequence[float]]]) -> list[tuple[float, list[int], float]]:
    """Per candidate (price, capacity prices): what is spent, how many take each arm, and the sum of their worth, in one aggregate."""
    # the grid is a literal that rows are exploded over, so the same compiled code serves every pass
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(lam)).alias("lam"), F.array(*[F.lit(float(m)) for m in mu]).alias("mu")) for k, (lam, mu) in enumerate(candidates)])
    each = rows.select(F.col(net), F.explode(grid).alias("p")).select("p.k", _choice(net, costs, F.col("p.lam"), [F.col("p.mu")[a] for a in range(len(costs))]).alias("c"))
    one = each.groupBy("k").agg(F.sum("c.worth").alias("worth"), *[F.count_if(F.col("c.arm") == a).alias(f"n{a}") for a in range(len(costs))])
    got = {r["k"]: r for r in one.collect()}
    out = []
    for k in range(len(candidates)):
        n = [got[k][f"n{a}"] if k in got else 0 for a in range(len(costs))]
        out.append((sum(float(c) * m for c, m in zip(costs, n, strict=True)), n, float(got[k]["worth"] or 0.0) if k in got else 0.0))
    return out


def capacity_allocate(df: DataFrame, net: str, key: str, budget: float, capacity: Sequence[float | None], costs: Sequence[float] = COSTS, sweeps: int = 8) -> tuple[DataFrame, dict]:
    """(key, arm, cost, value) of the units treated under a budget and at most ``capacity[a]`` units in arm a (None: any number), and what the prices tell.

    Besides the budget's price every arm has one of its own. Prices are searched in turn, each as low as its constraint
    allows given the others; any prices bound the value from above (``bound``, the least one seen). What is left then goes, arm
    by arm, to the units that gain most after prices. A null or NaN value is no offer; nobody is treated at a loss.
    """
    rows = written(df.select(key, F.col(net).alias("__net")))
    arms = len(costs)
    top = rows.agg(*[F.max(F.when(~F.isnan(F.col("__net")[a].cast("double")), F.col("__net")[a].cast("double"))).alias(f"m{a}") for a in range(arms)]).first()
    highest = max([0.0, *[top[f"m{a}"] or 0.0 for a in range(1, arms)]])
    mu, lam, bound = [0.0] * arms, 0.0, float("inf")
    limits = [float("inf") if c is None else float(c) for c in capacity]
    paid = [float(c) for c in costs]

    def seen(candidates):
        nonlocal bound
        told = _asked(rows, "__net", paid, candidates)
        for (p, m), (_, _, worth) in zip(candidates, told, strict=True):
            bound = min(bound, worth + p * budget + sum(v * limits[a] for a, v in enumerate(m) if v > 0))
        return told

    def search(make, fits, high: float) -> float:
        """The least price in [0, high] that fits, to a part in GRID ** 3."""
        low = 0.0
        for step in range(3):
            grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
            told = seen([make(g) for g in grid])
            first = next((i for i, t in enumerate(told) if fits(t)), GRID - 1)
            if first == 0:
                return grid[0]
            low, high = grid[first - 1], grid[first]
        return high

    cheapest = min((c for c in paid[1:] if c > 0), default=1.0)
    for _ in range(sweeps):
        before = [lam, *mu]
        # arms first: from no prices at all theirs only rise, as a dearer arm sends its units to the others
        for a in range(1, arms):
            if limits[a] < float("inf"):
                mu[a] = search(lambda g, a=a: (lam, [*mu[:a], g, *mu[a + 1 :]]), lambda t, a=a: t[1][a] <= limits[a], highest)
        lam = search(lambda g: (g, mu), lambda t: t[0] <= budget * (1 + 1e-12), highest / cheapest)
        if max(abs(x - y) for x, y in zip(before, [lam, *mu], strict=True)) <= highest / GRID**3:
            break
    chosen = written(rows.select(key, "__net", _choice("__net", paid, lam, mu).alias("c")).select(key, "__net", "c.arm", "c.worth"))
    # the last search of one price may have moved the others' demand: who gains least stays out
    kept, spent, left = None, 0.0, budget
    for a in sorted(range(1, arms), key=lambda a: -mu[a]):
        most = min(limits[a], left // paid[a] if paid[a] > 0 else float("inf"))
        own = chosen.where(F.col("arm") == a)
        taken = own if most == float("inf") else running(own, -F.col("worth"), [F.col(key)]).where(F.col("rn") <= most).drop("rn")
        taken = written(taken.select(key, "arm", F.col("__net")[a].cast("double").alias("value")))
        n = taken.count()
        left -= n * paid[a]
        limits[a] -= n
        kept = taken if kept is None else kept.unionByName(taken)
    for a in sorted(range(1, arms), key=lambda a: mu[a] + lam * paid[a]):
        most = min(limits[a], left // paid[a] if paid[a] > 0 else float("inf"))
        if most < 1:
            continue
        free = rows.join(kept.select(key), key, "left_anti").select(key, F.lit(a).alias("arm"), F.nanvl(F.col("__net")[a].cast("double"), F.lit(None).cast("double")).alias("value")).where("value > 0")
        more = written((free if most == float("inf") else running(free, -F.col("value"), [F.col(key)]).where(F.col("rn") <= most)).select(key, "arm", "value"))
        left -= more.count() * paid[a]
        kept = kept.unionByName(more)
    cost = F.element_at(F.array(*[F.lit(c) for c in paid]), F.col("arm") + 1)
    return kept.select(key, "arm", cost.alias("cost"), "value"), {"price": lam, "capacity_prices": mu, "bound": bound, "left": left}


def cheapest_offer(net: str, cost: Column) -> Column:
    """(cost, arm) of the cheapest arm that can be offered: one with a value and a cost above 0; null without any."""
    offers = F.transform(cost, lambda c, a: F.when((a > 0) & (c > 0) & F.get(F.col(net), a).isNotNull() & ~F.isnan(F.get(F.col(net), a).cast("double")), F.struct(c.cast("double").alias("cost"), a.alias("arm"))))
    return F.array_min(F.array_compact(offers))


def reference_policies(df: DataFrame, key: str, risk: str, value: str, net: str, cost: Column, budget: float, seed: int = 7) -> DataFrame:
    """(policy, key, arm, cost) of the units that each rule reaches with their cheapest offer, passing over what no longer fits; treat_none reaches nobody.

    ``cost`` is an array per row. treat_all takes the cheapest first and equal ones by a seeded draw; highest_risk,
    highest_clv and risk_x_clv rank by their number, unknown ones last; random by another draw.
    """
    rows = written(df.select(key, F.col(risk).cast("double").alias("__r"), F.col(value).cast("double").alias("__v"), cheapest_offer(net, cost).alias("o")).where("o IS NOT NULL").select(key, "__r", "__v", "o.cost", "o.arm"))
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    draw = lambda s: F.conv(F.substring(hashed(s, key), 1, 12), 16, 10).cast("double")
    low = lambda c: F.coalesce(number(c), F.lit(-1e300))
    rules = {"treat_all": -F.col("cost"), "highest_risk": low(F.col("__r")), "highest_clv": low(F.col("__v")), "risk_x_clv": low(F.col("__r") * F.col("__v")), "random": draw(seed + 1)}
    out = None
    for name, lead in rules.items():
        tied = rows.withColumn("__tie", F.concat(hashed(seed, key), F.lit("|"), F.col(key).cast("string")) if name == "treat_all" else F.col(key))
        one = fill(tied, lead, "__tie", "cost", budget).select(F.lit(name).alias("policy"), key, "arm", "cost")
        out = one if out is None else out.unionByName(one)
    return out


def parity_reweight(df: DataFrame, net: str, key: str, group: str, budget: float, tolerance: float = 0.1, costs: Sequence[float] = COSTS) -> tuple[DataFrame, dict]:
    """(key, group, arm, cost, value) of the units treated such that every group's share lies within ``tolerance`` of the overall one, and what was found.

    The budget's own solution gives the share to aim at. A group's units come in order of value per cost, each with its
    best arm on that, at a loss if the group has no others; the largest common share whose head-counts the budget pays
    is found by bisection over sums. What is left goes to units worth it, best first, in groups below that share plus
    half the tolerance. A null group is 'unknown'. Groups must be few.
    """
    paid = [float(c) for c in costs]
    cost = F.array(*[F.lit(c) for c in paid])
    value = F.transform(F.col(net), lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))))
    ratio = F.transform(value, lambda v, a: F.struct((F.when(a > 0, v / F.greatest(F.get(cost, a), F.lit(1e-12))).otherwise(float("-inf"))).alias("ratio"), (-a).alias("arm")))
    units = df.select(key, F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias("group"), value.alias("__v"), F.array_max(ratio).alias("__b"))
    units = units.select(key, "group", (-F.col("__b.arm")).alias("arm"), F.col("__b.ratio").alias("ratio"), F.get("__v", -F.col("__b.arm")).alias("value")).withColumn("cost", F.get(cost, F.col("arm")))
    offered = units.where(F.col("ratio") > float("-inf"))
    ranked = written(running(offered, -F.col("ratio"), [F.col(key)], number="place", by=["group"]))
    sizes = {r["group"]: r["n"] for r in units.groupBy("group").agg(F.count("*").alias("n")).collect()}
    able = {r["group"]: r["n"] for r in ranked.groupBy("group").agg(F.count("*").alias("n")).collect()}
    if not able:
        return ranked.select(key, F.col("group").alias(group), "arm", "cost", "value"), {"aim": 0.0, "share": 0.0, "left": budget}
    free = prices(df, net, [budget], costs)[0]
    aim = units.join(df.select(key, net), key).where(_worth_at(net, paid, free["price"])).count() / max(1, sum(sizes.values()))
    heads = lambda p: {g: min(able.get(g, 0), int(p * n + 0.5)) for g, n in sizes.items()}

    def pays(shares: Sequence[float]) -> list[float]:
        """What the head-counts of each share cost."""
        sums = []
        for i, p in enumerate(shares):
            limit = F.lit(0)
            for g, n in heads(p).items():
                limit = F.when(F.col("group") == g, F.lit(n)).otherwise(limit)
            sums.append(F.coalesce(F.sum(F.when(F.col("place") <= limit, F.col("cost"))), F.lit(0.0)).alias(f"s{i}"))
        got = ranked.agg(*sums).first()
        return [got[f"s{i}"] for i in range(len(shares))]

    low, high = 0.0, aim
    if pays([aim])[0] <= budget:
        low = aim
    else:
        while heads(low) != heads(high) and high - low > 1e-12:
            grid = [low + (high - low) * i / GRID for i in range(1, GRID)]
            spent = pays(grid)
            fit = [g for g, s in zip(grid, spent, strict=True) if s <= budget]
            over = [g for g, s in zip(grid, spent, strict=True) if s > budget]
            low, high = max(fit, default=low), min(over, default=high)
    floor = heads(low)
    bound = lambda limits: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in limits.items() for v in pair]), F.col("group")), F.lit(0))
    base = ranked.where(F.col("place") <= bound(floor))
    left = budget - (base.agg(F.sum("cost")).first()[0] or 0.0)
    more = fill(ranked.where((F.col("place") > bound(floor)) & (F.col("place") <= bound({g: int((low + tolerance / 2) * n) for g, n in sizes.items()})) & (F.col("value") > 0)), F.col("ratio"), key, "cost", left)
    taken = written(base.unionByName(more))
    spent = taken.agg(F.sum("cost")).first()[0] or 0.0
    marginal = {r["group"]: r["m"] for r in taken.groupBy("group").agg(F.min("ratio").alias("m")).collect()}
    return taken.select(key, F.col("group").alias(group), "arm", "cost", "value"), {"aim": aim, "share": low, "left": budget - spent, "prices": marginal}


def _worth_at(net: str, costs: Sequence[float], price: float) -> Column:
    """Whether some arm is worth more than its cost at the price."""
    out = F.lit(False)
    for a in range(1, len(costs)):
        v = F.col(net)[a].cast("double")
        out = out | F.coalesce(~F.isnan(v) & (v - price * costs[a] > 0), F.lit(False))
    return out
