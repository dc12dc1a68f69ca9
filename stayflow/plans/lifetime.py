"""Queries: lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifetime, pit
from .features import SQL as _FEATURES
from .features import _rounded
from .inputs import EVENTS, frame

#: Parameters of the queries that SQL repeats.
PURCHASES, SPENDING = lifetime.Purchases(0.8, 4.0, 0.6, 2.4), lifetime.Spending(2.5, 3.5, 90000.0)


def _summary(spark, sf_dir):
    return _rounded(pit.rfm_summary(frame(spark, sf_dir, EVENTS), "2000-01-01"), "recency", "T").withColumn("monetary_value", F.round("monetary_value", 7)).select("customer_id", "frequency", "recency", "T", "monetary_value")


def alive(spark, sf_dir):
    out = _summary(spark, sf_dir).select("customer_id", PURCHASES.alive().alias("p_alive"), SPENDING.profit().alias("profit"))
    return _rounded(out, "p_alive", "profit", digits=5)


def value(spark, sf_dir):
    out = lifetime.lifetime_value(_summary(spark, sf_dir), PURCHASES, SPENDING, 3)
    return _rounded(out.select("customer_id", "expected", "clv"), "expected", "clv", digits=4)


def fitted(spark, sf_dir):
    rows = _summary(spark, sf_dir).persist()
    m, s = lifetime.fit_purchases(rows), lifetime.fit_spending(rows)
    rows.unpersist()
    return spark.createDataFrame([(k, float(v)) for k, v in (("r", m.r), ("alpha", m.alpha), ("a", m.a), ("b", m.b), ("p", s.p), ("q", s.q), ("v", s.v))], "parameter string, estimate double")


def fit_quality(spark, sf_dir):
    return _rounded(lifetime.goodness_of_fit(_summary(spark, sf_dir), PURCHASES), "expected", digits=3)


QUERIES = {"probability_alive": alive, "lifetime_value": value, "lifetime_fit": fitted, "purchase_fit": fit_quality}

_R = f"(SELECT customer_id, frequency AS x, recency AS t, T AS age, monetary_value AS m FROM ({_FEATURES['rfm_summary']}))"
_P, _S = PURCHASES, SPENDING
_ODDS = f"CASE WHEN x > 0 THEN {_P.a}::DOUBLE / ({_P.b}::DOUBLE + x - 1) * (({_P.alpha}::DOUBLE + age) / ({_P.alpha}::DOUBLE + t)) ** ({_P.r}::DOUBLE + x) ELSE 0 END"
_MEAN = f"({_S.p * _S.v / (_S.q - 1)!r}::DOUBLE)"
_PROFIT = f"CASE WHEN x > 0 THEN (1 - w) * {_MEAN} + w * m ELSE {_MEAN} END"
_W = f"({_S.p}::DOUBLE * x / ({_S.p}::DOUBLE * x + {_S.q - 1!r}::DOUBLE)) AS w"


def _series(z: str) -> str:
    term = f"lgamma({_P.r}::DOUBLE + x + i) - lgamma({_P.r}::DOUBLE + x) + lgamma({_P.b}::DOUBLE + x + i) - lgamma({_P.b}::DOUBLE + x) - lgamma({_P.a + _P.b - 1!r}::DOUBLE + x + i) + lgamma({_P.a + _P.b - 1!r}::DOUBLE + x) - lgamma(i + 1.0::DOUBLE)"
    return f"sum(exp({term} + i * ln({z})))"


SQL = {
    "probability_alive": f"SELECT customer_id, round(1 / (1 + o), 5) AS p_alive, round({_PROFIT}, 5) AS profit FROM (SELECT *, {_ODDS} AS o, {_W} FROM {_R})",
    "lifetime_value": f"""WITH r AS (SELECT *, {_ODDS} AS o, {_W} FROM {_R}), k AS (SELECT unnest([1, 2, 3]) AS k), e AS (
  SELECT customer_id, k, any_value(x) AS x, any_value(m) AS m, any_value(w) AS w, any_value(({_P.a + _P.b - 1!r}::DOUBLE + x) / ({_P.a - 1!r}::DOUBLE) / (1 + o)) * (1 - any_value((({_P.alpha}::DOUBLE + age) / ({_P.alpha}::DOUBLE + age + k)) ** ({_P.r}::DOUBLE + x)) * {_series(f"k / ({_P.alpha}::DOUBLE + age + k)")}) AS e
  FROM r, k, range(200) s(i) GROUP BY customer_id, k), g AS (SELECT *, e - coalesce(lag(e) OVER (PARTITION BY customer_id ORDER BY k), 0) AS gain FROM e)
SELECT customer_id, round(max(e) FILTER (k = 3), 4) AS expected, round(sum(gain * 1.01::DOUBLE ** -k) * any_value({_PROFIT}) * 0.3, 4) AS clv FROM g GROUP BY customer_id""",
}
