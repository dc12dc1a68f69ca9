"""Histogram trees, boosting, meta-learners and the causal forest against brute force and on data with known effects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayflow.operators import forest, meta, trees

X = ("a", "b", "c")
SMALL = {"rounds": 8, "depth": 3, "bins": 16}


def toy(n=3000, seed=0):
    """A confounded treatment whose effect depends on a."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-1.2 * x[:, 1]))
    w = (rng.random(n) < p).astype(int)
    tau = 1.0 + 1.5 * (x[:, 0] > 0) * np.abs(x[:, 0])
    y = 2 * x[:, 1] + np.sin(x[:, 2]) + w * tau + rng.normal(size=n) * 0.5
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "w": w, "y": y, "tau": tau})


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(toy()).repartition(3)
    df.persist().count()
    return df


@pytest.fixture(scope="module")
def ready(data):
    return meta.nuisances(data, "y", "w", X, 2, "id", 3, **SMALL)


def brute_tree(bins, num, den, width, depth, least, l2, node=0):
    """{node: (feature, cut) or None} by trying every split of every node on the rows themselves."""
    worth = lambda m: num[m].sum() ** 2 / (den[m].sum() + l2)
    every = np.ones(len(bins), dtype=bool)
    best = None
    for f in range(bins.shape[1] if depth else 0):
        for cut in range(width - 1):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least and den[left].sum() > 0 and den[~left].sum() > 0:
                gain = worth(left) + worth(~left) - worth(every)
                if gain > 1e-9 * max(1, worth(every)) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut)
    if best is None:
        return {node: None}
    left = bins[:, best[1]] <= best[2]
    out = {node: best[1:]}
    for side, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        out |= brute_tree(bins[side], num[side], den[side], width, depth - 1, least, l2, child)
    return out


def same_tree(t, s, want):
    for node, split in want.items():
        assert (t.feature[s, node] == -1) if split is None else (t.feature[s, node], t.cut[s, node]) == split


def test_boosting_equals_brute_force(data):
    """Two rounds of two slots, one over part of the rows; a missing feature lies beyond the last bin."""
    df = data.withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    m = trees.fit_boosted(df, X, [F.col("y"), F.col("tau")], [F.lit(1.0), (F.col("w") == 1).cast("double") * 2], rounds=2, depth=3, bins=8, rate=0.5, least=25)
    rows = df.toPandas()
    bins = trees.to_bins(rows[list(X)].to_numpy(dtype=float), m.edges)
    for s, (t, w) in enumerate([(rows.y, np.ones(len(rows))), (rows.tau, 2.0 * (rows.w == 1))]):
        t, keep = t.to_numpy(), np.asarray(w) > 0
        w = np.asarray(w)[keep]
        now = np.full(keep.sum(), np.average(t[keep], weights=w))
        for tr, values in m.rounds:
            same_tree(tr, s, brute_tree(bins[keep], w * (t[keep] - now), w, 8 + 1, 3, 25, 1.0))
            leaf = tr.leaves(bins[keep])[:, s]
            for n in np.unique(leaf):
                at = leaf == n
                assert values[s, n] == pytest.approx(0.5 * (w * (t[keep] - now))[at].sum() / (w[at].sum() + 1.0))
            now = now + values[s, leaf]
    got = trees.predict_boosted(df, m, ["p", "q"]).toPandas().sort_values("id")
    assert np.allclose(got[["p", "q"]], m.predict(trees.to_bins(got[list(X)].to_numpy(dtype=float), m.edges)))


def test_nuisances_never_saw_their_row(spark, data):
    """Another outcome in one fold changes no prediction in it, and those of other folds."""
    rows = meta.nuisances(data, "y", "w", X, 2, "id", 2, rounds=3, depth=2, bins=8)
    turned = meta.nuisances(rows.select("id", *X, "w", F.when(F.col("fold") == 0, F.col("y") * -3).otherwise(F.col("y")).alias("y")), "y", "w", X, 2, "id", 2, rounds=3, depth=2, bins=8)
    a, b = (r.toPandas().sort_values("id") for r in (rows, turned))
    own = (a.fold == 0).to_numpy()
    assert np.allclose(a.mu_1[own], b.mu_1[own]) and not np.allclose(a.mu_1[~own], b.mu_1[~own])
    assert np.allclose(a.e_0 + a.e_1, 1) and a.e_0.between(0.01, 0.99).all()


def test_learners_differ_and_find_the_effect(ready):
    got = meta.boosted_effects(ready, "y", "w", X, 2, "id", ready=True, **SMALL).toPandas()
    naive = got.y[got.w == 1].mean() - got.y[got.w == 0].mean()
    constant = np.sqrt(((got.tau - got.tau.mean()) ** 2).mean())
    assert abs(naive - got.tau.mean()) > 0.5
    for name in ("t", "x", "dr", "r", "s"):
        tau = got[f"{name}_1"]
        assert abs(tau.mean() - got.tau.mean()) < abs(naive - got.tau.mean()) / 2
        if name != "s":
            assert np.sqrt(((tau - got.tau) ** 2).mean()) < constant and np.corrcoef(tau, got.tau)[0, 1] > 0.45
    columns = got[[f"{n}_1" for n in meta.LEARNERS]].to_numpy()
    assert all(np.abs(columns[:, i] - columns[:, j]).max() > 0.05 for i in range(5) for j in range(i))


def test_a_small_arm_takes_the_pooled_outcome(spark, data):
    rows = data.withColumn("w", F.when(F.col("id") < 20, 2).otherwise(F.col("w")))
    got = meta.nuisances(rows, "y", "w", X, 3, "id", 2, rounds=1, depth=1, bins=4)
    assert got.where("mu_2 <> m").isEmpty() and not got.where("mu_1 <> m").isEmpty()


def test_forest_equals_brute_force_and_recovers_effects(ready):
    m = forest.fit_forest(ready, "y", "w", X, 2, "id", bags=8, per_bag=3, depth=4, bins=16, ready=True)
    got = forest.predict_forest(ready, m).withColumn("h", F.xxhash64("id")).toPandas()
    assert np.sqrt(((got.cate_1 - got.tau) ** 2).mean()) < np.sqrt(((got.tau - got.tau.mean()) ** 2).mean())
    assert np.corrcoef(got.cate_1, got.tau)[0, 1] > 0.4 and m.importances()[0].argmax() == 0 and m.importances().sum() == pytest.approx(1)
    share = got.e_1 / (got.e_0 + got.e_1)
    ry, rw = (got.y - (1 - share) * got.mu_0 - share * got.mu_1).to_numpy(), (got.w - share).to_numpy()
    bins, leaf = trees.to_bins(got[list(X)].to_numpy(), m.edges), None
    split, fill = forest._bag(got.h.to_numpy().view(np.uint64), 24, 24, 3, 0.5, 0.45, 0.5, 0)
    assert not (split & fill).any()
    leaf = m.trees.leaves(bins)
    for t in (0, 11, 23):
        s = split[:, t]
        same_tree(m.trees, t, brute_tree(bins[s], (rw * ry)[s], (rw * rw)[s], max(map(len, m.edges)) + 1, 4, 15, 0.0))
        for node in np.unique(leaf[:, t]):
            up = node
            while True:  # the nearest ancestor with enough rows of both kinds
                below = leaf[:, t].copy()
                while (below > up).any():
                    below = np.where(below > up, (below - 1) // 2, below)
                at = fill[:, t] & (below == up)
                if up == 0 or min((got.w[at] == 1).sum(), (got.w[at] == 0).sum()) >= 3:
                    break
                up = (up - 1) // 2
            assert m.value[t, node] == pytest.approx((rw * ry)[at].sum() / (rw * rw)[at].sum())
    # the kernel, row by row
    first = leaf[:200]
    num, den = np.zeros(200), np.zeros(200)
    for t in range(24):
        together = (first[:, t][:, None] == leaf[:, t][None, :]) & fill[:, t][None, :]
        n = np.maximum(together.sum(axis=1), 1)
        num, den = num + together @ (rw * ry) / n, den + together @ (rw * rw) / n
    assert np.allclose(got.kernel_1[:200], num / den)
    assert (got.low_1 <= got.cate_1).all() and (got.cate_1 <= got.high_1).all() and (got.high_1 - got.low_1).mean() > 0.05


def test_an_arm_nobody_got_and_missing_values(spark):
    rows = toy(300)
    rows.loc[:20, "a"] = np.nan
    df = spark.createDataFrame(rows).withColumn("y", F.when(F.col("id") % 50 > 0, F.col("y")))
    near = meta.nuisances(df, "y", "w", X, 3, "id", 2, rounds=1, depth=1, bins=4)
    m = forest.fit_forest(near, "y", "w", X, 3, "id", bags=2, per_bag=2, depth=2, bins=4, ready=True)
    got = forest.predict_forest(near, m).toPandas()
    assert len(got) == 300 and got[["cate_1", "cate_2", "kernel_1"]].notna().all().all()
