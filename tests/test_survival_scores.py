"""Promises of the hazards are worked out on batches of rows, and hazards are fitted on counted units."""

import numpy as np
from pyspark.sql import functions as F

from stayflow.operators import hazard, survival_uplift

H = 6


def _rows(spark):
    df = spark.range(1200).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(7)).cast("double"))
    return df.withColumns({"arm": (F.col("id") % 2).cast("int"), "t": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9)) + 1, "e": (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) > 0).cast("int"), "m": F.when(F.col("id") % 5 > 0, F.col("x") + 1)})


def test_weights_stand_for_rows(spark):
    df = _rows(spark)
    one = hazard.fit_hazard(df, "t", "e", H, ("x",), "arm")
    counted = df.groupBy("t", "e", "x", "arm").agg(F.count("*").alias("n"))
    two = hazard.fit_hazard(counted, "t", "e", H, ("x",), "arm", weight="n")
    for a in (0, 1):
        assert np.allclose(one[a].levels, two[a].levels, atol=1e-9) and np.allclose(one[a].slopes, two[a].slopes, atol=1e-9)


def test_promises_equal_the_curves(spark):
    df = _rows(spark).withColumn("x", F.when(F.col("id") > 0, F.col("x"))).withColumn("fold", F.lit(0)).withColumn("at", F.when(F.col("id") != 3, F.least(F.col("t"), F.lit(H))))
    models = hazard.fit_hazard(df, "t", "e", H, ("x",), "arm")
    gone = survival_uplift.fit_censoring(df, "t", "e", H, ("x",))[None]
    names = ["rmst_0", "rmst_1", "worth_0", "worth_1", "g"]
    told = survival_uplift._promises(models, {0: gone}, 2, 1, H, names, 0.01, 0.05)
    want = {f"want_rmst_{a}": hazard.mean_time(m.survival(), H) for a, m in models.items()} | {f"want_worth_{a}": hazard.value_of(m.survival(), F.col("m"), 0.01) for a, m in models.items()}
    want |= {"want_g": survival_uplift.uncensored_before(gone, F.col("at"), 0.05)}
    for r in df.withColumn("told", told("fold", "m", F.col("at").cast("double"), "x")).withColumns(want).collect():
        for n in names:
            got, plain = r["told"][n], r[f"want_{n}"]
            if r["x"] is None and n == "g":
                continue
            assert (got is None) == (plain is None) and (got is None or abs(got - plain) < 1e-9 * max(1, abs(plain)))


def test_no_array_is_built_per_row(spark):
    out = survival_uplift.robust_scores(_rows(spark), "t", "e", "arm", 2, H, ("x",), "id", margin=F.col("m"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
