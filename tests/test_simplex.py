"""Probabilities are scaled onto the simplex once per row, however often the result is used."""

import numpy as np
from pyspark.sql import functions as F

from stayflow.functions.scalars import clip_to_simplex


def test_scaled_within_bounds_and_evaluated_once(spark):
    rows = [(0, [0.2, 0.3, 0.5]), (1, [0.0, 0.001, 0.999]), (2, [None, 0.5, 0.5]), (3, [None, None, None]), (4, [0.9, 0.9, 0.9]), (5, None), (6, [0.4, 0.6])]
    df = spark.createDataFrame(rows, "id int, p array<double>").select("id", clip_to_simplex(F.col("p"), 0.01, 0.9).alias("e"))
    out = df.select("id", *[F.try_element_at("e", F.lit(a)).alias(f"e{a}") for a in (1, 2, 3)])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction") <= 4
    got = {r.id: [r.e1, r.e2, r.e3] for r in out.collect()}
    assert got[5] == [None] * 3 and got[6][2] is None
    assert got[3] == [0.01] * 3
    for i in (0, 1, 2, 4):
        p = np.array([v or 0.0 for v in rows[i][1]])
        held = lambda s: np.clip(p * s, 0.01, 0.9)
        lo, hi = 0.0, 0.9 / p[p > 0].min()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if held(mid).sum() < 1 else (lo, mid)
        assert np.allclose(got[i], held((lo + hi) / 2), atol=1e-12)
        assert abs(sum(got[i]) - 1) < 1e-9
