"""Domain tables derived from the star schema, as SQL that Spark and the reference database both read.

``{orders}`` and the like stand for the tables; Spark gets DataFrames for them, so files are read with their columns pruned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: An event log of orders and of browsing events; those of the stream are set back by 9344 days, into the time of the orders.
EVENTS = """
SELECT o.o_custkey AS customer_id, o.o_orderkey AS seq, CAST(o.o_orderdate AS TIMESTAMP) AS event_ts, 'order' AS event_type,
  o.o_totalprice AS amount, o.o_orderpriority AS category, l.n_items AS n_items
FROM {orders} o JOIN (SELECT l_orderkey, COUNT(*) AS n_items FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
UNION ALL SELECT user_id, 1000000000 + event_id, CAST(ts - INTERVAL '9344' DAY AS TIMESTAMP),
  CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'payment_failure' ELSE 'support_ticket' END WHEN 'purchase' THEN 'purchase' ELSE 'session' END,
  CASE WHEN event_type = 'purchase' THEN value ELSE 0e0 END, event_type, CAST(1 AS BIGINT)
FROM {events}
"""

#: Three dates per customer.
SPINE = """
SELECT c.c_custkey AS customer_id, CAST(d.as_of_date AS TIMESTAMP) AS as_of_date
FROM {customer} c, (SELECT DATE '1997-01-01' AS as_of_date UNION ALL SELECT DATE '1998-07-01' UNION ALL SELECT DATE '2000-01-01') d
"""

#: A row per customer with a logged arm, propensities, outcome, predicted effects and a survival time.
UNITS = """
SELECT c.c_custkey AS unit_id, CAST(c.c_custkey % 4 AS INT) AS arm, CASE WHEN c.c_custkey % 4 > 0 THEN 1 ELSE 0 END AS w,
  COALESCE(o.spend, 0e0) / 1e5 AS y, c.c_acctbal AS x1, CAST(c.c_nationkey AS DOUBLE) AS x2, c.c_mktsegment AS grp,
  c.c_acctbal / 1e3 - (c.c_nationkey % 5) AS effect, c.c_acctbal / 9e2 - (c.c_nationkey % 4) AS effect2,
  c.c_acctbal / 2e2 - 5e0 AS tau1, c.c_acctbal / 15e1 - 1e1 AS tau2, c.c_acctbal / 1e2 - 3e1 AS tau3,
  25e-2 + 5e-2 * ((c.c_nationkey % 3) - 1) AS e0, 25e-2 AS e1, 25e-2 - 5e-2 * ((c.c_nationkey % 3) - 1) AS e2, 25e-2 AS e3,
  5e0 + c.c_acctbal / 5e3 AS mu0, 55e-1 + c.c_acctbal / 5e3 AS mu1, 6e0 + c.c_acctbal / 4e3 AS mu2, 65e-1 + c.c_acctbal / 6e3 AS mu3,
  o.months + 1 AS t, CASE WHEN o.last_month < 24012 THEN 1 ELSE 0 END AS event, FLOOR(c.c_acctbal / 1e3) AS risk,
  CAST(c.c_nationkey % 2 AS INT) AS label, (c.c_acctbal + 1e3) / 11e3 AS prob
FROM {customer} c LEFT JOIN (
  SELECT o_custkey, SUM(o_totalprice) AS spend, MAX(YEAR(o_orderdate) * 12 + MONTH(o_orderdate)) AS last_month,
    MAX(YEAR(o_orderdate) * 12 + MONTH(o_orderdate)) - MIN(YEAR(o_orderdate) * 12 + MONTH(o_orderdate)) AS months
  FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

#: Spending per customer and month, with flaws planted by arithmetic.
DIRTY = """
SELECT o_custkey AS customer_id, (YEAR(o_orderdate) - 1995) * 12 + MONTH(o_orderdate) - 1 AS period, o_orderkey AS ingest_seq,
  CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice WHEN o_orderkey % 89 = 0 THEN o_totalprice * 1e3 ELSE o_totalprice END AS monetary_12m,
  CASE WHEN o_orderkey % 7 = 0 THEN ' Ent ' WHEN o_orderkey % 7 = 1 THEN 'BASIC-V2' WHEN o_orderkey % 7 = 2 THEN 'n/a' WHEN o_orderkey % 7 = 3 THEN 'pro' ELSE 'plus' END AS plan_tier,
  CASE WHEN o_orderkey % 41 = 0 THEN 'Yes' ELSE '0' END AS late_arriving, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split
FROM {orders}
"""

#: Orders before and after a date, for drift.
DRIFT = """
SELECT o_orderkey AS id, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customer, o_orderpriority AS priority, o_orderstatus AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 2 END AS half, CASE WHEN o_orderdate < TIMESTAMP '1998-06-01 00:00:00' THEN 0 ELSE 1 END AS now,
  YEAR(o_orderdate) AS period, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done
FROM {orders}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The table that ``sql`` describes over the files in ``sf_dir``."""
    used = sorted(set(re.findall(r"{(\w+)}", sql)))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def plain(sql: str) -> str:
    """The same SQL over tables by name."""
    return re.sub(r"{(\w+)}", r"\1", sql)
