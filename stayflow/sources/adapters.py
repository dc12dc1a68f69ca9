"""Public data sets as rows of the panel: projections of their own columns, with what they lack left null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import running
from ..operators.splits import uniform
from ..schema import PANEL

MONTH_DAYS = 30.4375
# The services that the telephone data set lists, and the arms of the mail experiment.
TELCO_SERVICES = ("PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")
MAIL_ARMS = {"no e-mail": 0, "mens e-mail": 1, "womens e-mail": 2}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV (with a header) or Parquet data set; None if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)


def sample_rows(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """``most`` rows at most, those whose keys hash lowest: the same ones under any partitioning.

    Rows are numbered over ranges of the hash, so ``most`` may be any share of the table. Null keys hash alike; of rows
    with equal keys at the border any are taken.
    """
    numbered = running(df.withColumn("__sampled", uniform(seed, key)), F.col("__sampled"), [F.col(key)], number="__number")
    return numbered.where(F.col("__number") <= most).drop("__sampled", "__number")


def finalise(df: DataFrame, mapped: Mapping[str, Column], extras: Mapping[str, Column] | None = None) -> DataFrame:
    """The panel's columns with their types, null where ``mapped`` has none, and further ones as ``src_``."""
    columns = [(mapped[c] if c in mapped else F.lit(None)).cast(t).alias(c) for c, t in PANEL.items()]
    return df.select(*columns, *[c.alias(f"src_{name}") for name, c in (extras or {}).items()])


def map_telco(df: DataFrame) -> DataFrame:
    """A row per customer of the telephone churn data; event_time is the tenure itself, so tenure leaks it."""
    months, charge = F.col("tenure").cast("double"), F.col("MonthlyCharges").cast("double")
    services = sum((F.lower(F.col(c)) == "yes").cast("int") for c in TELCO_SERVICES) + (F.lower("InternetService") != "no").cast("int")
    gone = (F.lower("Churn") == "yes").cast("bigint")
    mapped = {
        "customer_id": F.col("customerID"), "period": F.lit(0), "tenure_months": months, "monetary_12m": charge * F.least(months, F.lit(12.0)), "frequency_12m": F.least(months, F.lit(12.0)), "avg_order_value": charge,
        "n_categories_12m": services.cast("double"), "basket_diversity": services / float(len(TELCO_SERVICES) + 1), "is_autopay": F.when(F.lower("PaymentMethod").contains("automatic"), "yes").otherwise("no"),
        "contract_type": F.when(F.lower("Contract") == "month-to-month", "monthly").otherwise("annual"), "arm": F.lit(0), "treated": F.lit(0), "offer_cost": F.lit(0.0), "churn_next": gone, "event_observed": gone,
        "event_time": F.greatest(months, F.lit(1.0)), "split": F.lit("train"), "assignment_block": F.lit("observational"),
    }
    return finalise(df, mapped, {"total_charges": F.col("TotalCharges").try_cast("double")})


def map_hillstrom(df: DataFrame) -> DataFrame:
    """A row per customer of the mail experiment: three arms at random, spending in the two weeks after."""
    arms = F.create_map(*[F.lit(x) for kv in MAIL_ARMS.items() for x in kv])
    arm = F.element_at(arms, F.lower(F.trim("segment")))
    numbered = df.withColumn("__id", F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)) if "customer_id" not in df.columns else df.withColumn("__id", F.col("customer_id").cast("string"))
    channel = F.lower("channel")
    mapped = {
        "customer_id": F.col("__id"), "period": F.lit(0), "recency_days": F.col("recency") * MONTH_DAYS, "monetary_12m": F.col("history").cast("double"), "n_categories_12m": (F.col("mens") + F.col("womens")).cast("double"),
        "tenure_months": F.when(F.col("newbie") == 1, 6.0).otherwise(12.0), "channel": F.when(channel == "web", "organic").when(channel == "phone", "paid").otherwise("partner"), "arm": arm, "treated": (arm > 0).cast("int"),
        "offer_cost": F.lit(0.0), "churn_next": 1 - F.col("visit"), "value_h": F.col("spend").cast("double"), "split": F.lit("train"), "assignment_block": F.lit("rct"),
    }
    return finalise(numbered, mapped, {"conversion": F.col("conversion")})


def map_online_retail(df: DataFrame, label_days: int = 90, window_days: int = 365) -> DataFrame:
    """A row per customer of invoice lines (invoice, stock_code, quantity, invoice_date, price, customer_id, country).

    Returns and lines without a customer go. The cutoff lies ``label_days`` before the last line; features are of lines
    up to it, those of twelve months of the ``window_days`` that end there, and the label is of lines strictly after.
    """
    lines = df.where("customer_id IS NOT NULL AND quantity > 0 AND price > 0").withColumn("ts", F.col("invoice_date").cast("timestamp")).withColumn("spent", F.col("quantity") * F.col("price"))
    ends = lines.agg(F.max("ts").alias("last")).select((F.unix_micros("last") - label_days * 86_400_000_000).alias("cut"))
    rows = lines.crossJoin(F.broadcast(ends)).withColumn("us", F.unix_micros("ts"))  # one row
    past = F.col("us") <= F.col("cut")
    recent = past & (F.col("us") > F.col("cut") - window_days * 86_400_000_000)
    day = 86_400_000_000.0
    per = rows.groupBy("customer_id").agg(
        F.first("cut").alias("cut"), F.min(F.when(past, F.col("us"))).alias("first"), F.max(F.when(past, F.col("us"))).alias("last"), F.count_distinct(F.when(recent, F.col("invoice"))).alias("frequency"),
        F.coalesce(F.sum(F.when(recent, F.col("spent"))), F.lit(0.0)).alias("money"), F.count_distinct(F.when(recent, F.col("stock_code"))).alias("kinds"), F.min(F.when(~past, F.col("us"))).alias("next"),
        F.max_by("country", F.when(past, F.struct("us", "invoice"))).alias("country"), F.coalesce(F.sum(F.when(~past, F.col("spent"))), F.lit(0.0)).alias("later"),
    ).where("first IS NOT NULL")
    lapsed = F.col("next").isNull().cast("bigint")
    mapped = {
        "customer_id": F.col("customer_id").cast("string"), "period": F.lit(0), "as_of_date": F.timestamp_micros("cut"), "tenure_months": (F.col("cut") - F.col("first")) / (day * MONTH_DAYS), "recency_days": (F.col("cut") - F.col("last")) / day,
        "frequency_12m": F.col("frequency").cast("double"), "monetary_12m": F.col("money"), "avg_order_value": F.col("money") / F.nullif(F.col("frequency"), F.lit(0)), "n_categories_12m": F.col("kinds").cast("double"),
        "arm": F.lit(0), "treated": F.lit(0), "offer_cost": F.lit(0.0), "churn_next": lapsed, "event_observed": lapsed, "event_time": F.coalesce((F.col("next") - F.col("cut")) / day, F.lit(float(label_days))) / MONTH_DAYS,
        "value_h": F.col("later"), "split": F.lit("train"), "assignment_block": F.lit("observational"),
    }
    return finalise(per, mapped, {"country": F.col("country")})


ADAPTERS = {"telco": map_telco, "hillstrom": map_hillstrom, "online_retail": map_online_retail}


def map_to_panel(df: DataFrame, name: str) -> DataFrame:
    return ADAPTERS[name](df)
