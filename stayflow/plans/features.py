"""Queries: point-in-time features, RFM, cleaning, contracts, splits and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, pit, quality, splits
from .inputs import DIRTY, EVENTS, SPINE, UNITS, frame, plain

SPECS = pit.DEFAULT_SPECS


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def panel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.as_of_join(frame(spark, sf_dir, EVENTS), frame(spark, sf_dir, SPINE), SPECS, seq="seq")
    return _rounded(out, "monetary_12m", "avg_order_value", "basket_diversity", "recency_days", "monetary_lifetime", "days_since_last_session", digits=4)


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pit.leakage_report(frame(spark, sf_dir, EVENTS), frame(spark, sf_dir, SPINE), SPECS, ["customer_id", "as_of_date"], seq="seq"), "corr_with_future", "mean_abs_diff", "frac_changed", digits=4)


def rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pit.rfm_summary(frame(spark, sf_dir, EVENTS), "2000-01-01")
    return _rounded(out, "recency", "T", digits=6).withColumns({"monetary_value": F.round("monetary_value", 7), "monetary_total": F.round("monetary_total", 2)})


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = cleaning.clean_panel(frame(spark, sf_dir, DIRTY), ranges={"monetary_12m": (0.0, 500000.0)}, k=3.0)
    return out.select("customer_id", "period", "ingest_seq", F.round("monetary_12m", 4).alias("monetary_12m"), "plan_tier", "split")


def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_panel(frame(spark, sf_dir, DIRTY), ranges={"monetary_12m": (0.0, 500000.0)}, k=3.0)[1]


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = quality.Expectation
    rules = quality.Contract("dirty", [
        rule("*", "row_count", {"min": 1}), rule("customer_id", "not_null"), rule("monetary_12m", "in_range", {"min": 0.0, "max": 500000.0}),
        rule("plan_tier", "in_set", {"values": ["basic", "plus", "pro", "enterprise"]}), rule("customer_id", "unique", {"subset": ["customer_id", "period"]}),
        rule("ingest_seq", "monotonic", {"within": "customer_id", "by": ("period", "ingest_seq")}, "warn"), rule("split", "regex", {"pattern": "tr"}), rule("gone", "not_null"), rule("split", "column_exists"), rule("period", "dtype", {"dtype": "str"}, "warn"),
    ])
    return rules.validate(frame(spark, sf_dir, DIRTY)).select("column", "kind", "severity", "n_bad", F.round("frac_bad", 6).alias("frac_bad"))


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.purged_split(frame(spark, sf_dir, DIRTY), 40, 55, 3).groupBy("split").agg(F.count("*").alias("n"), F.min("period").alias("first"), F.max("period").alias("last"))


def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.temporal_split(frame(spark, sf_dir, DIRTY), 40, 55).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("customer_id").alias("customers"))


def decision_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.decision_sample(frame(spark, sf_dir, DIRTY), row="ingest_seq").select("customer_id", "split", "ingest_seq", "period")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = frame(spark, sf_dir, UNITS).withColumn("gap", F.when(F.col("unit_id") % 5 != 0, F.col("x1")))
    model = splits.fit_encoder(units, ["gap", "x2"], {"grp": ("building", "machinery")})
    return model.transform(units, ["unit_id"])


QUERIES = {
    "panel_features": panel_features, "leakage_report": leakage, "rfm_summary": rfm, "clean_panel": clean, "clean_log": clean_log, "contract_validate": contract,
    "purged_split": purged, "temporal_split": temporal, "decision_sample": decision_sample, "design_matrix": encoded,
}

_E, _S, _D, _U = (f"({plain(x)})" for x in (EVENTS, SPINE, DIRTY, UNITS))
_WHEN, _AT, _DAY = "epoch_us(e.event_ts)", "epoch_us(s.as_of_date)", "86400000000"


def _features(when: str, prefix: str, rounded: bool = True) -> str:
    """The standard features as aggregates of rows for which ``when`` holds."""
    r = (lambda x: f"round({x}, 4)") if rounded else (lambda x: x)
    only = lambda x: f"FILTER ({when} {x})"
    forms = {
        "frequency_12m": f"count(event_type) {only('p AND recent')}", "monetary_12m": r(f"coalesce(sum(amount) {only('p AND recent')}, 0)"), "avg_order_value": r(f"avg(amount) {only('p AND recent')}"),
        "max_order_value_12m": f"max(amount) {only('p AND recent')}", "n_categories_12m": f"count(DISTINCT category) {only('p AND recent')}", "basket_diversity": r(f"avg(n_items) {only('p AND recent')}"),
        "last_order_amount": f"arg_max(amount, (event_ts, seq)) {only('p')}", "recency_days": r(f"(epoch_us(d) - max(epoch_us(event_ts)) {only('p')}) / 86400e6"), "monetary_lifetime": r(f"coalesce(sum(amount) {only('p')}, 0)"),
        "sessions_30d": "count(event_type) " + only("event_type = 'session' AND month"), "days_since_last_session": r("(epoch_us(d) - max(epoch_us(event_ts)) " + only("event_type = 'session'") + ") / 86400e6"),
        "support_tickets_90d": "count(event_type) " + only("event_type = 'support_ticket' AND quarter"), "payment_failures_12m": "count(event_type) " + only("event_type = 'payment_failure' AND recent"),
    }
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in forms.items())


_LONG = " UNION ALL ".join(f"SELECT '{s.name}' AS feature, p_{s.name}::DOUBLE AS p, f_{s.name}::DOUBLE AS f FROM b" for s in SPECS)
SQL = {
    "panel_features": f"""
WITH e AS {_E}, s AS {_S}, j AS (
  SELECT s.customer_id AS c, s.as_of_date AS d, e.*, {_WHEN} > {_AT} - 365 * {_DAY} AS recent, {_WHEN} > {_AT} - 30 * {_DAY} AS month, {_WHEN} > {_AT} - 90 * {_DAY} AS quarter, e.event_type IN ('order', 'purchase') AS p
  FROM s LEFT JOIN e ON e.customer_id = s.customer_id AND e.event_ts <= s.as_of_date)
SELECT c AS customer_id, d AS as_of_date, {_features('', '')} FROM j GROUP BY c, d""",
    "leakage_report": f"""
WITH e AS {_E}, s AS {_S}, j AS (
  SELECT s.customer_id AS c, s.as_of_date AS d, e.*, e.event_ts <= s.as_of_date AS past, abs({_WHEN} - {_AT}) AS gap, e.event_type IN ('order', 'purchase') AS p FROM s LEFT JOIN e ON e.customer_id = s.customer_id), w AS (
  SELECT *, gap < 365 * {_DAY} OR NOT past AND gap = 365 * {_DAY} AS recent, gap < 30 * {_DAY} OR NOT past AND gap = 30 * {_DAY} AS month, gap < 90 * {_DAY} OR NOT past AND gap = 90 * {_DAY} AS quarter FROM j), x AS (
  SELECT c, {_features('past AND', 'p_', False)} FROM w GROUP BY c, d), y AS (SELECT c, d, {_features('NOT past AND', 'f_', False)} FROM w GROUP BY c, d), b AS (
  SELECT * FROM (SELECT c, d, {_features('past AND', 'p_', False)} FROM w GROUP BY c, d) JOIN y USING (c, d)), l AS ({_LONG})
SELECT feature, count(*) AS n_rows, round(corr(p, f), 4) AS corr_with_future, round(avg(abs(p - f)), 4) AS mean_abs_diff,
  round(avg(CASE WHEN abs(p - f) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(f) OR p IS NULL AND f IS NULL THEN 0 ELSE 1 END), 4) AS frac_changed FROM l GROUP BY feature""",
    "rfm_summary": f"""
WITH e AS {_E}, d AS (SELECT customer_id, event_ts::DATE AS day, min(event_ts) AS ts, sum(amount) AS amount, count(*) AS n FROM e WHERE event_ts <= TIMESTAMP '2000-01-01' AND event_type IN ('order', 'purchase') GROUP BY 1, 2)
SELECT customer_id, count(*) - 1 AS frequency, round((epoch_us(max(ts)) - epoch_us(min(ts))) / (86400000000 * 30.436875::DOUBLE), 6) AS recency, round((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(min(ts))) / (86400000000 * 30.436875::DOUBLE), 6) AS T,
  round(CASE WHEN count(*) > 1 THEN (sum(amount) - arg_min(amount, day)) / (count(*) - 1) ELSE 0 END, 7) AS monetary_value, round(sum(amount), 2) AS monetary_total, sum(n)::BIGINT AS n_transactions, min(ts) AS first_purchase, max(ts) AS last_purchase
FROM d GROUP BY customer_id""",
    "clean_panel": f"""
WITH d AS {_D}, one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY customer_id, period ORDER BY ingest_seq) = 1), kept AS (
  SELECT customer_id, period, ingest_seq, least(greatest(monetary_12m, 0), 500000) AS m, split,
    CASE trim(lower(plan_tier)) WHEN 'ent' THEN 'enterprise' WHEN 'basic-v2' THEN 'basic' WHEN 'pro' THEN 'pro' WHEN 'plus' THEN 'plus' END AS plan_tier
  FROM one WHERE late_arriving <> 'Yes'), q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS b FROM kept WHERE split = 'train')
SELECT customer_id, period, ingest_seq, round(least(greatest(m, a - 3 * (b - a)), b + 3 * (b - a)), 4) AS monetary_12m, plan_tier, split FROM kept, q""",
    "clean_log": f"""
WITH d AS {_D}, r AS (SELECT *, row_number() OVER w AS rn, (monetary_12m, plan_tier, late_arriving, split) = first_value((monetary_12m, plan_tier, late_arriving, split)) OVER w AS same FROM d WINDOW w AS (PARTITION BY customer_id, period ORDER BY ingest_seq)), k AS (SELECT * FROM r WHERE rn = 1 AND late_arriving <> 'Yes'), c AS (
  SELECT least(greatest(monetary_12m, 0), 500000) AS m, split FROM k), q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS b FROM c WHERE split = 'train')
SELECT 'drop_exact_duplicates' AS step, '*' AS column, count(*) FILTER (rn > 1 AND same) AS n_affected FROM r UNION ALL SELECT 'drop_near_duplicates', '*', count(*) FILTER (rn > 1 AND NOT same) FROM r
UNION ALL SELECT 'drop_late', 'late_arriving', count(*) FROM r WHERE rn = 1 AND late_arriving = 'Yes' UNION ALL SELECT 'clip_range', 'monetary_12m', count(*) FROM k WHERE monetary_12m < 0 OR monetary_12m > 500000
UNION ALL SELECT 'normalise', 'plan_tier', count(*) FROM k WHERE plan_tier NOT IN ('pro', 'plus') UNION ALL SELECT 'iqr_fence', 'monetary_12m', count(*) FROM c, q WHERE m < a - 3 * (b - a) OR m > b + 3 * (b - a)
UNION ALL SELECT 'missing', 'monetary_12m', count(*) FROM k WHERE monetary_12m IS NULL UNION ALL SELECT 'missing', 'plan_tier', count(*) FROM k WHERE plan_tier = 'n/a'""",
    "contract_validate": f"""
WITH d AS {_D}, n AS (SELECT count(*) AS n FROM d), r AS (
  SELECT 'monetary_12m' AS "column", 'in_range' AS kind, 'error' AS severity, count(*) AS n_bad FROM d WHERE monetary_12m < 0 OR monetary_12m > 500000
  UNION ALL SELECT 'plan_tier', 'in_set', 'error', count(*) FROM d WHERE plan_tier NOT IN ('basic', 'plus', 'pro', 'enterprise')
  UNION ALL SELECT 'customer_id', 'unique', 'error', sum(c - 1)::BIGINT FROM (SELECT count(*) AS c FROM d GROUP BY customer_id, period)
  UNION ALL SELECT 'split', 'regex', 'error', count(*) FROM d WHERE split NOT LIKE 'tr%' UNION ALL SELECT 'gone', 'not_null', 'error', n FROM n
  UNION ALL SELECT 'period', 'dtype', 'warn', n FROM n UNION ALL SELECT 'ingest_seq', 'monotonic', 'warn', count(DISTINCT customer_id) FROM (
    SELECT customer_id, ingest_seq < lag(ingest_seq) OVER (PARTITION BY customer_id ORDER BY period, ingest_seq) AS down FROM d) WHERE down)
SELECT "column", kind, severity, n_bad, round(n_bad / n, 6) AS frac_bad FROM r, n WHERE n_bad > 0""",
    "purged_split": f"""
SELECT CASE WHEN period BETWEEN 38 AND 40 OR period BETWEEN 53 AND 55 THEN 'embargo' WHEN period <= 40 THEN 'train' WHEN period <= 55 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(period) AS first, max(period) AS last FROM {_D} GROUP BY 1""",
    "temporal_split": f"""
SELECT CASE WHEN period <= 40 THEN 'train' WHEN period <= 55 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT customer_id) AS customers FROM {_D} GROUP BY 1""",
    "decision_sample": f"SELECT customer_id, split, ingest_seq, period FROM {_D} QUALIFY row_number() OVER (PARTITION BY customer_id, split ORDER BY md5(concat_ws('|', '0', customer_id, split, ingest_seq)), ingest_seq) = 1",
    "design_matrix": f"""
WITH u AS (SELECT *, CASE WHEN unit_id % 5 <> 0 THEN x1 END AS gap FROM {_U}), m AS (SELECT quantile_cont(gap, 0.5) AS m FROM u)
SELECT unit_id, coalesce(gap, m) AS gap, x2, (gap IS NULL)::DOUBLE AS gap__isna, 0::DOUBLE AS x2__isna, (lower(grp) = 'building')::DOUBLE AS grp__building, (lower(grp) = 'machinery')::DOUBLE AS grp__machinery,
  (lower(grp) NOT IN ('building', 'machinery'))::DOUBLE AS grp__other FROM u, m""",
}
