"""Survival operators on continuous times, against brute force, and by either way of looking a curve up."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayflow.operators import survival


def units(n, seed, digits):
    rng = random.Random(seed)
    return [(i, round(rng.expovariate(0.1), digits), int(rng.random() < 0.6), round(rng.gauss(0, 1), digits)) for i in range(n)]


@pytest.mark.parametrize(("n", "digits"), [(700, 9), (700, 1), (1, 3), (0, 3)])
def test_concordance_counts_every_pair_once(spark, n, digits):
    rows = units(n, 3, digits)
    df = spark.createDataFrame([*rows, (-1, None, 1, 0.5), (-2, 1.0, None, 0.5), (-3, 1.0, 1, None)], "id int, t double, e int, r double")
    got = survival.concordance(df, "t", "e", "r").first()
    t, e, r = (np.array([x[i] for x in rows]) for i in (1, 2, 3))
    pair = (e[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (e[None] == 0)))
    assert got.pairs == pair.sum()
    assert got.concordant == (pair & (r[:, None] > r[None])).sum() and got.tied == (pair & (r[:, None] == r[None])).sum()
    assert (got.c_index is None) == (pair.sum() == 0)


def test_curves_by_group_equal_the_product_limit(spark):
    rows = [(*x, "ab"[x[0] % 2]) for x in units(300, 4, 2)] + [(900, 200.0, 1, 0.0, "a")]
    got = {(r.g, r.t): r for r in survival.kaplan_meier(spark.createDataFrame(rows, "id int, t double, e int, r double, g string"), "t", "e", ["g"]).collect()}
    for g in "ab":
        own = [x for x in rows if x[4] == g]
        s, green = 1.0, 0.0
        for t in sorted({x[1] for x in own if x[2]}):
            n, d = sum(x[1] >= t for x in own), sum(x[1] == t and x[2] for x in own)
            s *= 1 - d / n
            green += d / (n * (n - d)) if n > d else 0.0
            row = got.pop((g, t))
            assert (row.n_at_risk, row.n_events) == (n, d) and row.survival == pytest.approx(s, abs=1e-12)
            assert row.greenwood is None if n == d else row.greenwood == pytest.approx(green)
    assert not got


@pytest.mark.parametrize("left", [False, True])
@pytest.mark.parametrize("most", [4096, 0])
def test_either_way_finds_the_same_step(spark, monkeypatch, left, most):
    monkeypatch.setattr(survival, "ARRAY_STEPS", most)
    rng = random.Random(5)
    steps = sorted({round(rng.random() * 10, 1) for _ in range(60)})
    curve = spark.createDataFrame([(t, 1 - t / 20) for t in steps], "t double, g double")
    rows = [(i, rng.choice([None, -1.0, 99.0, round(rng.random() * 10, 1)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, at double")
    got = {r.id: r.found for r in survival.step_lookup(df, F.col("at"), curve, "g", "found", 0.75, left).collect()}
    assert len(got) == 200
    for i, at in rows:
        held = [t for t in steps if at is not None and (t < at if left else t <= at)]
        assert got[i] == pytest.approx(1 - held[-1] / 20 if held else 0.75)
