"""Capacities, parity and reference policies against enumeration and rules checked row by row."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayflow.operators import constrained
from stayflow.operators.splits import hashed

COSTS = (0.0, 1.0, 2.0, 3.0)


def frame(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    net = np.round(rng.normal(1.0, 2.0, (n, 4)) * [0, 1, 1.5, 2], 3)
    net[:, 0] = 0
    d = pd.DataFrame({"id": np.arange(n), "net": list(net.tolist()), "g": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]), "risk": rng.random(n), "clv": rng.random(n) * 100})
    d.loc[d.g == "b", "net"] = pd.Series([[0.0, *(v - 1.5 for v in x[1:])] for x in d.net[d.g == "b"]], index=d.index[d.g == "b"])
    return d, spark.createDataFrame(d).repartition(3)


@pytest.mark.parametrize("seed", [2])
def test_capacities_against_every_assignment(spark, seed):
    """On seven units the best of all assignments; the bound holds, constraints are kept."""
    d, df = frame(spark, 7, seed)
    net, best = np.array(d.net.tolist()), 0.0
    for arms in itertools.product(range(4), repeat=7):
        n = np.bincount(arms, minlength=4)
        if n[1] <= 2 and n[2] <= 1 and n[3] <= 1 and sum(COSTS[a] for a in arms) <= 6:
            best = max(best, net[np.arange(7), list(arms)].sum())
    out, told = constrained.capacity_allocate(df, "net", "id", 6.0, (None, 2, 1, 1), COSTS)
    got = out.toPandas()
    assert told["bound"] >= best - 1e-9 and got.value.sum() <= best + 1e-9 and got.value.sum() >= 0.75 * best
    assert got.cost.sum() <= 6 and not got.id.duplicated().any()


@pytest.mark.parametrize("budget, capacity", [(500.0, (None, 80, 60, 50)), (250.0, (None, 60, None, 20)), (90.0, (None, None, None, None))])
def test_capacities_are_kept_and_the_bound_is_near(spark, budget, capacity):
    """The bound is at least the value of the linear program, so within 1 % of it is within 1 % of that program."""
    _, df = frame(spark)
    out, told = constrained.capacity_allocate(df, "net", "id", budget, capacity, COSTS)
    got = out.toPandas()
    assert got.cost.sum() <= budget + 1e-9 and (got.value > 0).all() and not got.id.duplicated().any()
    assert all(c is None or (got.arm == a).sum() <= c for a, c in enumerate(capacity))
    assert told["bound"] * (1 + 1e-9) >= got.value.sum() >= 0.99 * told["bound"]


def test_parity_holds_and_pays_no_more_than_the_budget(spark):
    d, df = frame(spark)
    for budget, tolerance in ((300.0, 0.1), (80.0, 0.02), (1e6, 0.05)):
        out, told = constrained.parity_reweight(df, "net", "id", "g", budget, tolerance, COSTS)
        got = out.toPandas()
        overall, sizes = len(got) / len(d), d.g.value_counts()
        rates = got.g.value_counts() / sizes
        slack = 0.5 / sizes.min() + 0.5 * 3 / len(d)
        assert got.cost.sum() <= budget and (abs(rates - overall) <= tolerance + slack).all() and told["share"] <= told["aim"] + 1e-12
        # by hand: the largest share whose head-counts the budget pays, then what is worth it, best first
        v = np.array(d.net.tolist())
        ratio = v[:, 1:] / np.array(COSTS[1:])
        arm = ratio.argmax(axis=1) + 1
        rows = pd.DataFrame({"id": d.id, "g": d.g, "arm": arm, "r": ratio.max(axis=1), "v": v[np.arange(len(v)), arm], "c": np.array(COSTS)[arm]}).sort_values(["r", "id"], ascending=[False, True])
        rows["rn"] = rows.groupby("g").cumcount() + 1
        heads = lambda p: {g: math.floor(p * n + 0.5) for g, n in sizes.items()}
        cost = lambda p: rows.c[rows.rn <= rows.g.map(heads(p))].sum()
        steps = sorted({(k - 0.5) / n for n in sizes for k in range(1, n + 1)} | {0.0, told["aim"]})
        share = max(p for p in steps if p <= told["aim"] and cost(p) <= budget)
        assert heads(share) == heads(told["share"])
        floor, roof = rows.g.map(heads(told["share"])), rows.g.map({g: int((told["share"] + tolerance / 2) * n) for g, n in sizes.items()})
        taken, left = set(rows.id[rows.rn <= floor]), budget - rows.c[rows.rn <= floor].sum()
        for r in rows[(rows.rn > floor) & (rows.rn <= roof) & (rows.v > 0)].itertuples():
            if r.c <= left + 1e-9:
                taken.add(r.id)
                left -= r.c
        assert set(got.id) == taken and dict(zip(got.id, got.arm)) == dict(zip(rows.id, rows.arm)) | {} if len(got) == len(d) else set(got.id) == taken


def test_reference_policies_fill_by_their_rule(spark):
    d, df = frame(spark, 200)
    df = df.withColumn("net", F.when(F.col("id") % 9 == 0, F.array(F.lit(0.0), F.lit(None), F.lit(float("nan")), F.lit(1.0))).otherwise(F.col("net"))).withColumn("risk", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("risk")))
    cost = F.array(F.lit(0.0), F.lit(2.0) + F.col("id") % 3, F.lit(3.0), F.lit(9.0))
    got = constrained.reference_policies(df, "id", "risk", "clv", "net", cost, 120.0).toPandas()
    rows = df.withColumn("h", hashed(7, "id")).withColumn("h2", F.conv(F.substring(hashed(8, "id"), 1, 12), 16, 10).cast("double")).toPandas()
    offer = []
    for r in rows.itertuples():
        costs = (0.0, 2.0 + r.id % 3, 3.0, 9.0)
        offer.append(min((costs[a], a) for a in range(1, 4) if r.net[a] is not None and not np.isnan(r.net[a])))
    rows["c"], rows["arm"] = zip(*offer, strict=True)
    low = rows.risk.fillna(-1e300)
    orders = {"treat_all": [rows.c, rows.h], "highest_risk": [-low, rows.id], "highest_clv": [-rows.clv, rows.id], "risk_x_clv": [-(rows.risk * rows.clv).fillna(-1e300), rows.id], "random": [-rows.h2, rows.id]}
    for name, by in orders.items():
        want, left = {}, 120.0
        for i in np.lexsort(tuple(b.to_numpy().astype(str) if b.dtype == object else b.to_numpy() for b in reversed(by))):
            if rows.c[i] <= left + 1e-9:
                want[rows.id[i]] = rows.arm[i]
                left -= rows.c[i]
        own = got[got.policy == name]
        assert dict(zip(own.id, own.arm, strict=True)) == want
    assert "treat_none" not in set(got.policy)
