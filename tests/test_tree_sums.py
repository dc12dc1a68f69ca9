"""Tree fits work on sums of rows that have equal bins, and on small pieces of a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stayflow.functions import tables
from stayflow.operators import forest, trees


def _rows(spark):
    return spark.range(6000).select(F.col("id"), (F.col("id") % 4).cast("double").alias("a"), F.floor(F.col("id") / 7 % 3).cast("double").alias("b"), (F.col("id") * 37 % 11).cast("double").alias("y"), (F.col("id") * 13 % 3).cast("int").alias("arm"))


def test_boosting_goes_over_distinct_bins(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(trees, "written", lambda df: seen.append(tables.written(df)) or seen[-1])
    df = _rows(spark).withColumn("y", F.when(F.col("id") % 50 != 0, F.col("y")))
    m = trees.fit_boosted(df, ("a", "b"), [F.col("y"), F.col("y")], [F.lit(1.0), (F.col("arm") == 1).cast("double")], rounds=1, depth=2, rate=1.0, bins=8, l2=0.0)
    assert seen[0].count() == 12
    got = df.toPandas()
    for s, own in ((0, got[got.y.notna()]), (1, got[got.y.notna() & (got.arm == 1)])):
        assert abs(m.first[s] - own.y.mean()) < 1e-9
        assert m.rounds[0][0].sums[s, 0, 0] == len(own)


def test_added_up_tells_every_row_once(monkeypatch):
    monkeypatch.setattr(trees, "HELD", 40)
    monkeypatch.setattr(trees, "SLICE", 8)
    rng = np.random.default_rng(1)
    bins, sums = rng.integers(0, 3, (200, 2)).astype(np.uint8), rng.integers(0, 9, (200, 3)).astype(float)
    out = pa.Table.from_batches(list(trees.added_up(((bins[k : k + 8], sums[k : k + 8]) for k in range(0, 200, 8)), 2, 3)))
    told = np.array(out.column("sums").to_pylist())
    keys = np.array([list(b) for b in out.column("bins").to_pylist()])
    for b in np.unique(bins, axis=0):
        assert np.array_equal(told[(keys == b).all(axis=1)].sum(axis=0), sums[(bins == b).all(axis=1)].sum(axis=0))
    assert not list(trees.added_up(iter([]), 2, 3))


def test_forest_adds_up_rows_of_equal_bins(spark, monkeypatch):
    df = _rows(spark).select("*", *[F.lit(1 / 3).alias(f"e_{a}") for a in range(3)], *[F.lit(5.0).alias(f"mu_{a}") for a in range(3)])
    seen = []

    def grow(table, inputs, *rest):
        for batch in table.toArrow().to_batches():
            for part in trees.sliced([batch], 1000):
                b, n, num, den = inputs(part)
                seen.append((part.num_rows, len(b), n, num))
        return trees.grow(table, inputs, *rest)

    monkeypatch.setattr(forest, "grow", grow)
    m = forest.fit_forest(df, "y", "arm", ("a", "b"), 3, "id", bags=2, per_bag=2, depth=2, bins=8, ready=True)
    assert sum(rows for rows, *_ in seen) == 6000 and sum(k for _, k, *_ in seen) < 200
    assert np.array_equal(sum(n.sum(axis=0) for *_, n, _ in seen), m.trees.sums[:, 0, 0])


def test_spread_has_as_many_parts_as_shuffles(spark):
    got = tables.spread(_rows(spark).coalesce(1), "id")
    assert got.count() == 6000 and len(got.inputFiles()) == 4
