"""Meta-learners over boosted trees, with nuisances that never saw the row they judge.

One booster holds all nuisances (each arm's outcome, the pooled outcome, each arm's probability) of all folds, a second
one the second stages of all learners: slots of one model share its jobs. Effects are against arm 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip_to_simplex
from ..functions.tables import spread, written
from .learners import pseudo_outcomes
from .splits import folds
from .trees import fit_boosted, predict_boosted

LEARNERS = ("s", "t", "x", "dr", "r")


def nuisances(df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int, key: str, k: int = 3, low: float = 0.01, high: float = 0.99, small: int = 40, seed: int = 0, **boost) -> DataFrame:
    """Adds fold, mu_a (the arm's expected outcome), m (any arm's) and e_a (the arms' probabilities, summing to 1 within [low, high]), all from the other folds.

    An arm with fewer than ``small`` rows takes the pooled outcome, as its own model would learn noise. A row without
    outcome or arm takes no part in fits and gets predictions all the same. The result is a written table.
    """
    rows = spread(folds(df, arm, key, k, seed), key)
    has = F.col(arm).isNotNull() & F.col(y).isNotNull()
    names = [*[f"mu_{a}" for a in range(arms)], "m", *[f"e_{a}" for a in range(arms)]]
    targets = [*[F.col(y)] * (arms + 1), *[(F.col(arm) == a).cast("double") for a in range(arms)]]
    who = [*[F.col(arm) == a for a in range(arms)], *[F.lit(True)] * (arms + 1)]
    others = lambda f: F.coalesce(F.col("fold") != f, F.lit(True))
    fits = [(t, (has & w & others(f)).cast("double")) for t, w in zip(targets, who, strict=True) for f in range(k)]
    model = fit_boosted(rows, x, [t for t, _ in fits], [w for _, w in fits], **boost)
    out = predict_boosted(rows, model, names, F.col("fold"), k)
    n = rows.where(has).agg(*[F.count_if(F.col(arm) == a).alias(f"n{a}") for a in range(arms)]).first()
    out = out.withColumns({f"mu_{a}": F.col("m") for a in range(arms) if n[f"n{a}"] < small})
    e = F.array(*[F.greatest(F.col(f"e_{a}"), F.lit(1e-6)) for a in range(arms)])
    out = out.withColumn("__e", e).withColumn("__e", clip_to_simplex(F.transform("__e", lambda v: v / F.aggregate("__e", F.lit(0.0), lambda s, t: s + t)), low, high))
    return written(out.withColumns({f"e_{a}": F.col("__e")[a] for a in range(arms)}).drop("__e"))


def centred(y: str, arm: str, a: int) -> tuple[Column, Column]:
    """Residuals of outcome and treatment of the pair of arms 0 and ``a``, from the columns of ``nuisances``."""
    share = F.col(f"e_{a}") / (F.col("e_0") + F.col(f"e_{a}"))
    return F.col(y) - ((1 - share) * F.col("mu_0") + share * F.col(f"mu_{a}")), (F.col(arm) == a).cast("double") - share


def boosted_effects(df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int, key: str, learners: Sequence[str] = LEARNERS, k: int = 3, seed: int = 0, ready: bool = False, **boost) -> DataFrame:
    """Adds, per learner and arm but 0, a column such as ``dr_1``: the effect that the learner expects of the row.

    s: one model with the arm among its features; t: the arms' own models; x: imputed effects of treated and control rows,
    blended by propensity; dr: doubly robust scores; r: residuals of the outcome on those of the treatment. ``ready``:
    ``df`` has the columns of ``nuisances`` already.
    """
    rows = df if ready else nuisances(df, y, arm, x, arms, key, k, seed=seed, **boost)
    mu, e = [f"mu_{a}" for a in range(arms)], [f"e_{a}" for a in range(arms)]
    has = F.col(arm).isNotNull() & F.col(y).isNotNull()
    stages: dict[str, tuple[Column, Column]] = {}
    for a in range(1, arms):
        if "x" in learners:
            stages[f"__on_{a}"] = (F.col(y) - F.col("mu_0"), has & (F.col(arm) == a))
            stages[f"__off_{a}"] = (F.col(f"mu_{a}") - F.col(y), has & (F.col(arm) == 0))
        if "dr" in learners:
            stages[f"dr_{a}"] = (pseudo_outcomes(df, y, arm, e, mu)[a - 1], has)
        if "r" in learners:
            left_y, left_w = centred(y, arm, a)
            stages[f"r_{a}"] = (left_y / left_w, F.when(has & F.col(arm).isin(0, a), left_w * left_w).otherwise(0.0))
    if stages:
        model = fit_boosted(rows, x, [t for t, _ in stages.values()], [w.cast("double") for _, w in stages.values()], **boost)
        rows = predict_boosted(rows, model, list(stages))
    out = {}
    for a in range(1, arms):
        if "t" in learners:
            out[f"t_{a}"] = F.col(f"mu_{a}") - F.col("mu_0")
        if "x" in learners:
            g = F.col(f"e_{a}") / (F.col("e_0") + F.col(f"e_{a}"))
            out[f"x_{a}"] = g * F.col(f"__off_{a}") + (1 - g) * F.col(f"__on_{a}")
    rows = rows.withColumns(out).drop(*[c for c in stages if c.startswith("__")])
    if "s" in learners:
        marks = [f"__arm_{a}" for a in range(1, arms)]
        marked = rows.withColumns({m: F.coalesce((F.col(arm) == a).cast("double"), F.lit(0.0)) for a, m in enumerate(marks, 1)})
        model = fit_boosted(marked, [*x, *marks], [F.col(y)], [has.cast("double")], **boost)
        swaps = {f"__s_{a}": {m: float(b == a) for b, m in enumerate(marks, 1)} for a in range(arms)}
        told = predict_boosted(marked, model, [], swaps=swaps)
        rows = told.withColumns({f"s_{a}": F.col(f"__s_{a}") - F.col("__s_0") for a in range(1, arms)}).drop(*marks, *swaps)
    return rows
