"""Queries: the table catalogue, content hashes and an adapter."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir
from ..operators import cleaning, pit
from ..sources import adapters, warehouse
from .features import _rounded
from .inputs import DIRTY, EVENTS, SPINE, frame, plain

LINES = """
SELECT o.o_orderkey AS invoice, l.l_partkey AS stock_code, CASE WHEN l.l_linenumber = 7 THEN -l.l_quantity ELSE l.l_quantity END AS quantity, o.o_orderdate AS invoice_date,
  l.l_extendedprice / l.l_quantity AS price, CASE WHEN o.o_custkey % 50 = 0 THEN NULL ELSE o.o_custkey END AS customer_id, o.o_orderpriority AS country
FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
"""
ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _house(spark: SparkSession, sf_dir: str) -> warehouse.Warehouse:
    path = f"{shared_dir(spark)}/medallion/{uuid.uuid4().hex}"
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    clean, _ = cleaning.clean_panel(frame(spark, sf_dir, DIRTY), ranges={"monetary_12m": (0.0, 500000.0)}, k=3.0)
    gold = clean.groupBy("customer_id").agg(F.count("*").alias("n_periods"), F.sum("monetary_12m").alias("spent"))
    return warehouse.build_medallion(spark, path, {"events": read("events"), "customers": read("customer")}, {"panel": clean}, {"panel": gold})


def tables(spark, sf_dir):
    return _house(spark, sf_dir).tables()


def lineage(spark, sf_dir):
    house = _house(spark, sf_dir)
    house.write("gold", "panel", house.read("gold", "panel").where("n_periods > 3"))
    house.drop("bronze", "customers")
    return house.lineage().select("table", "action", "n_rows", "n_cols")


def catalogue_sql(spark, sf_dir):
    out = _house(spark, sf_dir).sql("SELECT n_periods, count(*) AS n, sum(spent) AS spent FROM gold_panel GROUP BY n_periods")
    return _rounded(out, "spent", digits=2)


def content(spark, sf_dir):
    return warehouse.content_hash(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def retail(spark, sf_dir):
    out = adapters.map_to_panel(frame(spark, sf_dir, LINES), "online_retail")
    names = ("tenure_months", "recency_days", "monetary_12m", "avg_order_value", "event_time", "value_h")
    return _rounded(out.select("customer_id", "frequency_12m", "n_categories_12m", "churn_next", "event_observed", "split", "src_country", *names), *names, digits=4)


def schema(spark, sf_dir):
    rows = frame(spark, sf_dir, DIRTY).select(F.col("customer_id"), (F.col("period") + 0.5).cast("string").alias("period"), "plan_tier", F.lit("x").alias("nps"), F.col("ingest_seq"))
    return cleaning.enforce_schema(rows)


def future(spark, sf_dir):
    spine = frame(spark, sf_dir, SPINE)
    joined = frame(spark, sf_dir, EVENTS).join(spine, "customer_id")
    return pit.future_rows(joined)


def one_to_one(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    spent = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return pit.aligned(pit.one_to_one(read("customer").select("c_custkey", "c_nationkey"), read("customer").select("c_custkey", "c_mktsegment"), ["c_custkey"]), "c_custkey", spent)


QUERIES = {"medallion_tables": tables, "medallion_lineage": lineage, "catalogue_sql": catalogue_sql, "content_hash": content, "online_retail_panel": retail, "enforce_schema": schema, "future_rows": future, "one_to_one_join": one_to_one}

from .features import SQL as _FEATURES  # noqa: E402

_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"
_GOLD = f"(SELECT customer_id, count(*) AS n_periods, sum(monetary_12m) AS spent FROM ({_FEATURES['clean_panel']}) GROUP BY customer_id)"
_COUNTS = f"(SELECT (SELECT count(*) FROM events) AS e, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM ({_FEATURES['clean_panel']})) AS p, (SELECT count(*) FROM {_GOLD}) AS g, (SELECT count(*) FROM {_GOLD} WHERE n_periods > 3) AS g3)"
SQL = {
    "medallion_tables": f"""SELECT unnest(['bronze_events', 'bronze_customers', 'silver_panel', 'gold_panel']) AS "table", unnest(['bronze', 'bronze', 'silver', 'gold']) AS layer, unnest(['events', 'customers', 'panel', 'panel']) AS name,
  unnest([e, c, p, g]) AS n_rows, unnest([6, 5, 6, 3]) AS n_cols FROM {_COUNTS}""",
    "medallion_lineage": f"""SELECT unnest(['bronze_events', 'bronze_customers', 'silver_panel', 'gold_panel', 'gold_panel', 'bronze_customers']) AS "table", unnest(['write', 'write', 'write', 'write', 'write', 'drop']) AS action,
  unnest([e, c, p, g, g3, 0]) AS n_rows, unnest([6, 5, 6, 3, 3, 0]) AS n_cols FROM {_COUNTS}""",
    "catalogue_sql": f"SELECT n_periods, count(*) AS n, round(sum(spent), 2) AS spent FROM {_GOLD} GROUP BY n_periods",
    "content_hash": f"""WITH r AS (SELECT ('0x' || substr(md5({" || ".join(_FIELD.format(f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if t.startswith("timestamp") else f"{c}::VARCHAR") for c, t in ORDERS.items())}), 1, 15))::BIGINT::HUGEINT AS v FROM orders)
SELECT count(*) AS n_rows, sha256('{",".join(f"{c}:{t}" for c, t in ORDERS.items())}|' || count(*) || '|' || coalesce(sum(v), 0)) AS sha256 FROM r""",
    "online_retail_panel": f"""WITH l AS (SELECT *, quantity * price AS spent, epoch_us(invoice_date) AS us FROM ({plain(LINES)}) WHERE customer_id IS NOT NULL AND quantity > 0 AND price > 0), c AS (SELECT max(us) - 90 * 86400000000 AS cut FROM l), r AS (
  SELECT *, us <= cut AS past, us <= cut AND us > cut - 365 * 86400000000 AS recent FROM l, c), p AS (
  SELECT customer_id, any_value(cut) AS cut, min(us) FILTER (past) AS f, max(us) FILTER (past) AS z, count(DISTINCT invoice) FILTER (recent) AS n, coalesce(sum(spent) FILTER (recent), 0) AS m, count(DISTINCT stock_code) FILTER (recent) AS k, min(us) FILTER (NOT past) AS nx,
    arg_max(country, (us, invoice)) FILTER (past) AS country, coalesce(sum(spent) FILTER (NOT past), 0) AS later FROM r GROUP BY customer_id HAVING f IS NOT NULL)
SELECT customer_id::VARCHAR AS customer_id, n::DOUBLE AS frequency_12m, k::DOUBLE AS n_categories_12m, (nx IS NULL)::BIGINT AS churn_next, (nx IS NULL)::BIGINT AS event_observed, 'train' AS split, country AS src_country, round((cut - f) / (86400e6 * 30.4375::DOUBLE), 4) AS tenure_months,
  round((cut - z) / 86400e6, 4) AS recency_days, round(m, 4) AS monetary_12m, round(m / nullif(n, 0), 4) AS avg_order_value, round(coalesce((nx - cut) / 86400e6, 90) / 30.4375::DOUBLE, 4) AS event_time, round(later, 4) AS value_h FROM p""",
    "enforce_schema": f"SELECT customer_id::VARCHAR AS customer_id, round_even(period + 0.5, 0)::BIGINT AS period, lower(trim(plan_tier)) AS plan_tier, NULL::DOUBLE AS nps, ingest_seq FROM ({plain(DIRTY)})",
    "future_rows": f"SELECT as_of_date, count(*) AS n_rows, count(*) FILTER (event_ts > as_of_date) AS n_future FROM ({plain(EVENTS)}) e JOIN ({plain(SPINE)}) s ON s.customer_id = e.customer_id GROUP BY as_of_date",
    "one_to_one_join": "SELECT c.c_custkey, c_nationkey, c_mktsegment, coalesce(n, 0) AS n_orders FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey",
}
