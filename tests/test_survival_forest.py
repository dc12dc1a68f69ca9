"""The survival forest against exhaustive search on the rows, and on non-linear data against the Cox model."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stayflow.operators import cox, survival
from stayflow.operators import survival_forest as sf_


def toy(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    rate = 0.05 * np.exp(2.0 * (np.abs(x[:, 0]) > 1))  # a risk that no line in a expresses
    t, c = np.ceil(rng.exponential(1 / rate)), np.ceil(rng.exponential(25, n))
    return pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "t": np.minimum(np.minimum(t, c), 40), "e": ((t <= c) & (t <= 40)).astype(int)})


def statistic(t, e, left):
    """The log-rank statistic, event time by event time."""
    u = v = 0.0
    for at in np.unique(t[e == 1]):
        risk, now = t >= at, (t == at) & (e == 1)
        n, n1, d, d1 = risk.sum(), (risk & left).sum(), now.sum(), (now & left).sum()
        u += d1 - d * n1 / n
        if n > 1:
            v += d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)
    return u * u / v if v > 1e-12 else 0.0


def brute(bins, t, e, width, depth, least, node=0):
    best = None
    for f in range(bins.shape[1] if depth else 0):
        for cut in range(width - 1):
            left = bins[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                gain = statistic(t, e, left)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut)
    if best is None:
        return {node: None}
    left = bins[:, best[1]] <= best[2]
    return {node: best[1:]} | brute(bins[left], t[left], e[left], width, depth - 1, least, 2 * node + 1) | brute(bins[~left], t[~left], e[~left], width, depth - 1, least, 2 * node + 2)


def test_a_tree_equals_exhaustive_search(spark):
    data = toy(300)
    data["t"] = np.ceil(data["t"] / 4)
    df = spark.createDataFrame(data).repartition(3)
    model = sf_.fit_survival_forest(df, "t", "e", ("a", "b", "c"), "id", trees=1, depth=3, least=15, mtry=3, bins=8, bootstrap=False)
    bins = sf_.to_bins(data[["a", "b", "c"]].to_numpy(), model.edges)
    t, e = data["t"].to_numpy(), data["e"].to_numpy()
    assert model.grid.tolist() == sorted(set(t[e == 1]))
    for node, split in brute(bins, t, e, max(len(x) for x in model.edges) + 1, 3, 15).items():
        assert (model.trees.feature[0, node] == -1) if split is None else (model.trees.feature[0, node], model.trees.cut[0, node]) == split
    leaf = model.trees.leaves(bins)[:, 0]
    for node in set(leaf):
        own = leaf == node
        hazard = np.cumsum([((t == g) & (e == 1) & own).sum() / max(1, ((t >= g) & own).sum()) for g in model.grid])
        assert np.allclose(model.hazard[0, node], hazard)
    told = sf_.predict_survival_forest(df, model, (0.5, 3.0), 5.0).orderBy("id").toPandas()
    assert np.allclose(np.stack(told["survival"])[:, 0], 1)
    steps = np.diff(np.minimum([0.0, *model.grid, 99.0], 5.0))
    curve = np.exp(-np.concatenate([np.zeros((300, 1)), model.hazard[0, leaf]], axis=1))
    assert np.allclose(told["rmst"], curve @ steps) and np.allclose(told["mortality"], model.hazard[0, leaf].sum(axis=1))


def test_a_risk_without_a_line_is_ranked_better_than_by_the_cox_model(spark):
    df = spark.createDataFrame(toy()).repartition(4)
    model = sf_.fit_survival_forest(df, "t", "e", ("a", "b", "c"), "id", trees=12, depth=4, mtry=2)
    fresh = spark.createDataFrame(toy(800, 2))
    forest = survival.concordance(sf_.predict_survival_forest(fresh, model, (), 20.0).withColumn("r", F.round("mortality", 3)), "t", "e", "r").first()["c_index"]
    line = survival.concordance(fresh.withColumn("r", F.round(cox.fit_cox(df, "t", "e", ("a", "b", "c")).risk(), 3)), "t", "e", "r").first()["c_index"]
    assert forest > 0.6 and forest > line + 0.05
    again = sf_.fit_survival_forest(df, "t", "e", ("a", "b", "c"), "id", trees=12, depth=4, mtry=2)
    assert np.array_equal(again.trees.feature, model.trees.feature) and np.allclose(again.hazard, model.hazard)


def test_missing_values_and_empty_tables(spark):
    data = toy(200)
    data.loc[:20, "a"], data.loc[30:40, "t"] = np.nan, np.nan
    df = spark.createDataFrame(data).withColumn("e", F.when(F.col("id") % 50 != 7, F.col("e")))
    model = sf_.fit_survival_forest(df, "t", "e", ("a", "b"), "id", trees=3, depth=2, points=6)
    told = sf_.predict_survival_forest(df, model, (5.0,), 10.0)
    assert told.count() == 200 and told.where("rmst IS NULL OR isnan(rmst) OR rmst > 10").count() == 0
    none = sf_.fit_survival_forest(df.where("false"), "t", "e", ("a", "b"), "id", trees=2, depth=2)
    assert [r.rmst for r in sf_.predict_survival_forest(df.limit(2), none, (5.0,), 10.0).collect()] == [10.0, 10.0]
    assert sf_.predict_survival_forest(df.where("false"), model, (5.0,), 10.0).count() == 0
