"""Queries: effects by boosted learners, by the causal forest and, under censoring, by doubly robust scores; nuisances are fitted in the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, learners, meta, survival, survival_forest, survival_uplift
from .features import _rounded
from .inputs import UNITS, frame

ARMS, HORIZON = 4, 12
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
X = ("x1", "x2", *[f"in_{s.lower()}" for s in SEGMENTS])
BOOST = {"rounds": 6, "depth": 3, "bins": 32}
TAU = ("tau1", "tau2", "tau3")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of a unit: balance, nation and a mark per segment."""
    units = frame(spark, sf_dir, UNITS).withColumn("half_years", F.ceil(F.col("t") / 6))
    return units.withColumns({f"in_{s.lower()}": F.coalesce((F.col("grp") == s).cast("double"), F.lit(0.0)) for s in SEGMENTS})


def _effects(spark, sf_dir):
    return meta.boosted_effects(_units(spark, sf_dir), "y", "arm", X, ARMS, "unit_id", **BOOST)


def boosted_effects(spark, sf_dir):
    names = [f"{n}_{a}" for n in meta.LEARNERS for a in range(1, ARMS)]
    return _rounded(_effects(spark, sf_dir), *names).select("unit_id", *names)


def boosted_leaderboard(spark, sf_dir):
    found = _effects(spark, sf_dir)
    each = {n: found.select(*TAU, *[F.col(f"{n}_{a}").alias(f"cate_{a}") for a in range(1, ARMS)]) for n in meta.LEARNERS}
    return _rounded(learners.compare_learners(each, TAU), "pehe", "eps_ate", digits=4)


def cross_fitted_nuisances(spark, sf_dir):
    names = [*[f"mu_{a}" for a in range(ARMS)], "m", *[f"e_{a}" for a in range(ARMS)]]
    return _rounded(meta.nuisances(_units(spark, sf_dir), "y", "arm", X, ARMS, "unit_id", **BOOST).select("unit_id", "fold", *names), *names)


def _forest(spark, sf_dir):
    ready = meta.nuisances(_units(spark, sf_dir), "y", "arm", X, ARMS, "unit_id", **BOOST)
    return ready, forest.fit_forest(ready, "y", "arm", X, ARMS, "unit_id", bags=10, per_bag=5, depth=5, ready=True)


def causal_forest(spark, sf_dir):
    ready, model = _forest(spark, sf_dir)
    names = [f"{n}_{a}" for a in range(1, ARMS) for n in ("cate", "low", "high", "kernel")]
    return _rounded(forest.predict_forest(ready, model), *names).select("unit_id", *names)


def forest_importances(spark, sf_dir):
    _, model = _forest(spark, sf_dir)
    return spark.createDataFrame([(a, c, round(float(v), 6)) for a, row in enumerate(model.importances(), 1) for c, v in zip(X, row, strict=True)], "arm int, feature string, importance double")


def robust_survival_uplift(spark, sf_dir):
    out, _ = survival_uplift.robust_uplift(_units(spark, sf_dir).withColumn("x1", F.col("x1") / 1000), "half_years", "event", "arm", ARMS, HORIZON, ("x1", "x2"), "unit_id", margin=F.col("y"), rounds=6, depth=2)
    names = [f"{n}_{a}" for a in range(1, ARMS) for n in ("psi", "psi_value", "cate", "cate_value")]
    return _rounded(out, *names, digits=4).select("unit_id", *names)


def conditional_censoring(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("x1", F.col("x1") / 1000)
    out = survival_uplift.conditional_ipcw(units, "half_years", "event", HORIZON, ("x1", "x2"))
    return _rounded(out.select("unit_id", "periods", "follow_up", "complete", "g", "weight", "pseudo"), "g", "weight", "pseudo")


def conditional_brier(spark, sf_dir):
    units = _units(spark, sf_dir).withColumn("x1", F.col("x1") / 1000)
    model = survival_uplift.fit_censoring(units, "half_years", "event", HORIZON, ("x1", "x2"))[None]
    g = survival_uplift.uncensored_before
    out = survival.brier(units, "half_years", "event", F.exp(-F.col("tau") / 20), [3.0, 6.0, 9.0], before=g(model, F.least(F.col("half_years"), F.lit(HORIZON))), at=g(model, F.col("tau") + 1))
    return _rounded(out, "brier")


def _survival(spark, sf_dir):
    units = _units(spark, sf_dir)
    model = survival_forest.fit_survival_forest(units, "half_years", "event", X, "unit_id", trees=30, depth=4)
    return survival_forest.predict_survival_forest(units, model, (2.0, 4.0, 8.0), HORIZON)


def survival_forest_curves(spark, sf_dir):
    out = _survival(spark, sf_dir).select("unit_id", *[F.col("survival")[i].alias(f"survival_{t}") for i, t in enumerate((2, 4, 8))], "rmst", "mortality")
    return _rounded(out, *out.columns[1:], digits=5)


def survival_forest_concordance(spark, sf_dir):
    return _rounded(survival.concordance(_survival(spark, sf_dir), "half_years", "event", "mortality"), "c_index")


QUERIES = {
    f.__name__: f for f in (
        boosted_effects, boosted_leaderboard, cross_fitted_nuisances, causal_forest, forest_importances, robust_survival_uplift, conditional_censoring, conditional_brier,
        survival_forest_curves, survival_forest_concordance,
    )
}

#: Trees and iterated fits have no SQL; tests/test_trees.py, tests/test_survival_forest.py and tests/test_survival_uplift.py hold them against brute force.
SQL: dict[str, str] = {}
