"""Propensities and effects of several offers by meta-learners with linear bases, cross-fitted by folds.

Every fit is an aggregate over (arm, fold): the fit for a fold is the whole less that fold's sums, so cross-fitting
costs one pass however many folds there are. Effects are columns ``cate_1`` and so on, against arm 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip_to_simplex
from ..functions.tables import spread
from .balance import auc, calibration_error
from .linear import by_fold, design, dot, logistic, moments, out_of_fold, solve
from .splits import folds


def outcome_models(df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int, k: int = 0, key: str | None = None, seed: int = 0) -> DataFrame:
    """Adds mu_0, mu_1, ...: each arm's linear outcome model, fitted on the other folds of ``k`` (on all rows for 0)."""
    xs = design(x)
    if k < 2:
        fits = moments(df, xs, [F.col(y)], [F.col(arm)])
        return df.withColumns({f"mu_{a}": dot(solve(*fits[(a,)][:2])[:, 0], xs) if (a,) in fits else F.lit(None).cast("double") for a in range(arms)})
    rows = df if "fold" in df.columns else folds(df, arm, key, k, seed)
    parts = moments(rows, xs, [F.col(y)], [F.col(arm), F.col("fold")])
    return rows.withColumns({f"mu_{a}": by_fold(out_of_fold(parts, a, k), xs, F.col("fold")) for a in range(arms)})


def propensity(df: DataFrame, arm: str, x: Sequence[str], arms: int, key: str, k: int = 5, low: float = 0.01, high: float = 0.99, seed: int = 0) -> DataFrame:
    """Adds fold and e_0, e_1, ...: out-of-fold probabilities of the arms, scaled to sum 1 within [low, high].

    Each arm has a logistic regression against the others per fold, fitted on the other folds, all in one aggregate a
    round; a row then counts once for each fold but its own.
    """
    rows = spread(folds(df, arm, key, k, seed), key)
    scale = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in x], *[F.stddev_pop(c).alias(f"s_{c}") for c in x]).first()
    xs = [F.lit(1.0), *[(F.col(c) - F.lit(scale[f"m_{c}"] or 0.0)) / F.lit(scale[f"s_{c}"] or 1.0) for c in x]]
    train = rows.withColumn("__model", F.explode(F.array(*[F.lit(f) for f in range(k)]))).where("__model <> fold")
    beta = logistic(train, xs, [(F.col(arm) == a).cast("int") for a in range(arms)], F.col("__model"), l2=1e-3)
    raw = F.array(*[1 / (1 + F.exp(-by_fold([beta[f][a] if f in beta else np.zeros(len(xs)) for f in range(k)], xs, F.col("fold")))) for a in range(arms)])
    held = rows.withColumn("__e", raw).withColumn("__e", clip_to_simplex(F.transform("__e", lambda v: v / F.aggregate("__e", F.lit(0.0), lambda s, t: s + t)), low, high))
    return held.select("*", *[F.col("__e")[a].alias(f"e_{a}") for a in range(arms)]).drop("__e")


def propensity_diagnostics(df: DataFrame, arm: str, e: Sequence[str]) -> DataFrame:
    """(arm, n, mean_e, auc, ece, brier) per arm."""
    out = None
    for a, c in enumerate(e):
        own = df.select((F.col(arm) == a).cast("int").alias("is_arm"), F.col(c).alias("p"))
        one = own.agg(F.sum("is_arm").alias("n"), F.avg("p").alias("mean_e"), F.avg(F.pow(F.col("p") - F.col("is_arm"), 2)).alias("brier"))
        one = one.crossJoin(auc(own, "p", "is_arm").select("auc")).crossJoin(calibration_error(own, "p", "is_arm")).select(F.lit(a).alias("arm"), "n", "mean_e", "auc", "ece", "brier")
        out = one if out is None else out.unionByName(one)
    return out


def _effects(df: DataFrame, effect: Mapping[int, Column]) -> DataFrame:
    return df.withColumns({f"cate_{a}": c for a, c in effect.items()})


def s_learner(df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int) -> DataFrame:
    """One model with a column per arm: the arm's coefficient is its effect for everybody."""
    xs = [*design(x), *[(F.col(arm) == a).cast("double") for a in range(1, arms)]]
    b = solve(*moments(df, xs, [F.col(y)])[()][:2])[:, 0]
    return _effects(df, {a: F.lit(float(b[len(x) + a])) for a in range(1, arms)})


def t_learner(df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int, k: int = 0, key: str | None = None) -> DataFrame:
    """The difference of the arms' outcome models."""
    out = outcome_models(df, y, arm, x, arms, k, key)
    return _effects(out, {a: F.col(f"mu_{a}") - F.col("mu_0") for a in range(1, arms)})


def x_learner(df: DataFrame, y: str, arm: str, x: Sequence[str], e: Sequence[str], k: int = 0, key: str | None = None) -> DataFrame:
    """Imputed effects of treated and control rows are regressed by themselves and blended by propensity."""
    arms, xs = len(e), design(x)
    rows = outcome_models(df, y, arm, x, arms, k, key)
    on_treated = moments(rows.where(F.col(arm) > 0), xs, [F.col(y) - F.col("mu_0")], [F.col(arm)])
    on_control = moments(rows.where(F.col(arm) == 0), xs, [F.col(f"mu_{a}") - F.col(y) for a in range(1, arms)])[()]
    control = solve(*on_control[:2])
    effect = {}
    for a in range(1, arms):
        g = F.col(e[a]) / (F.col(e[0]) + F.col(e[a]))
        effect[a] = g * dot(control[:, a - 1], xs) + (1 - g) * dot(solve(*on_treated[(a,)][:2])[:, 0], xs)
    return _effects(rows, effect)


def pseudo_outcomes(df: DataFrame, y: str, arm: str, e: Sequence[str], mu: Sequence[str]) -> list[Column]:
    """Per arm but 0 the doubly robust score of its effect."""
    residual = lambda a: F.when(F.col(arm) == a, (F.col(y) - F.col(mu[a])) / F.col(e[a])).otherwise(0.0)
    return [F.col(mu[a]) - F.col(mu[0]) + residual(a) - residual(0) for a in range(1, len(e))]


def dr_learner(df: DataFrame, y: str, arm: str, x: Sequence[str], e: Sequence[str], mu: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df with effects, (arm, ate, se)): doubly robust scores regressed on the features, and their means."""
    scores, xs = pseudo_outcomes(df, y, arm, e, mu), design(x)
    b = solve(*moments(df, xs, scores)[()][:2])
    long = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), s.cast("double").alias("psi")) for a, s in enumerate(scores, 1)])))
    ate = long.groupBy("arm").agg(F.avg("psi").alias("ate"), (F.stddev_samp("psi") / F.sqrt(F.count("psi"))).alias("se"))
    return _effects(df, {a: dot(b[:, a - 1], xs) for a in range(1, len(e))}), ate


def r_learner(df: DataFrame, y: str, arm: str, x: Sequence[str], e: Sequence[str], mu: Sequence[str]) -> DataFrame:
    """Per pair of arm 0 and another: residuals of the outcome regressed on residuals of the treatment times the features."""
    xs, effect = design(x), {}
    for a in range(1, len(e)):
        share = F.col(e[a]) / (F.col(e[0]) + F.col(e[a]))
        left_y = F.col(y) - ((1 - share) * F.col(mu[0]) + share * F.col(mu[a]))
        left_w = (F.col(arm) == a).cast("double") - share
        b = solve(*moments(df.where(F.col(arm).isin(0, a)), [left_w * c for c in xs], [left_y])[()][:2])[:, 0]
        effect[a] = dot(b, xs)
    return _effects(df, effect)


def local_centering(df: DataFrame, y: str, arm: str, x: Sequence[str], e: Sequence[str], mu: Sequence[str]) -> DataFrame:
    """(arm, ate): Robinson's estimate per arm, the residuals' cross product over the treatment residuals' square."""
    out = []
    for a in range(1, len(e)):
        share = F.col(e[a]) / (F.col(e[0]) + F.col(e[a]))
        left_y = F.col(y) - ((1 - share) * F.col(mu[0]) + share * F.col(mu[a]))
        left_w = (F.col(arm) == a).cast("double") - share
        out.append(df.where(F.col(arm).isin(0, a)).agg((F.sum(left_w * left_y) / F.sum(left_w * left_w)).alias("ate")).select(F.lit(a).alias("arm"), "ate"))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def compare_learners(results: Mapping[str, DataFrame], truth: Sequence[str]) -> DataFrame:
    """(learner, pehe, eps_ate, rank): root mean square and mean error of the effects against the columns ``truth``, best first."""
    rows = None
    for name, df in results.items():
        errors = [F.col(f"cate_{a}") - F.col(t) for a, t in enumerate(truth, 1)]
        pehe = sum(F.sqrt(F.avg(d * d)) for d in errors) / len(errors)
        one = df.agg(pehe.alias("pehe"), (sum(F.abs(F.avg(d)) for d in errors) / len(errors)).alias("eps_ate")).select(F.lit(name).alias("learner"), "pehe", "eps_ate")
        rows = one if rows is None else rows.unionByName(one)
    better = rows.alias("b").join(rows.alias("a"), F.expr("b.pehe < a.pehe OR (b.pehe = a.pehe AND b.learner < a.learner)"), "right")  # a row per learner
    return better.groupBy("a.learner", "a.pehe", "a.eps_ate").agg((F.count("b.learner") + 1).alias("rank")).orderBy("rank")


def confounding(df: DataFrame, y: str, arm: str, e: Sequence[str], truth: Sequence[str], least: int = 20) -> DataFrame:
    """(arm, n, true_ate, naive, ipw, naive_error, ipw_error, sign_flip) per arm with ``least`` rows on both sides."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(y)))
    weighted = lambda a: F.avg(F.when(F.col(arm) == a, F.col(y) / F.col(e[a])).otherwise(0.0))
    rows = [F.struct(F.lit(a).alias("arm"), F.count_if(F.col(arm) == a).alias("n"), F.count_if(F.col(arm) == 0).alias("n0"), F.avg(t).alias("true_ate"), (mean(a) - mean(0)).alias("naive"), (weighted(a) - weighted(0)).alias("ipw")) for a, t in enumerate(truth, 1)]
    out = df.agg(F.array(*rows).alias("r")).select(F.inline("r")).where(F.least("n", "n0") >= least)
    return out.select("arm", "n", "true_ate", "naive", "ipw", (F.col("naive") - F.col("true_ate")).alias("naive_error"), (F.col("ipw") - F.col("true_ate")).alias("ipw_error"), (F.signum("naive") != F.signum("true_ate")).alias("sign_flip"))
