"""Point-in-time features: for each (entity, date) aggregates of the events in a window that ends there."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Event types that count as purchases.
PURCHASES = ("order", "purchase", "transaction")


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: ``agg`` of ``column`` over events of ``event_types`` (all if None) in the last ``days`` (all history if None)."""

    name: str
    column: str
    agg: str
    days: int | None
    event_types: tuple[str, ...] | None = None
    fill: float | None = None


# The standard catalogue of features.
DEFAULT_SPECS = (
    FeatureSpec("frequency_12m", "event_type", "count", 365, PURCHASES),
    FeatureSpec("monetary_12m", "amount", "sum", 365, PURCHASES),
    FeatureSpec("avg_order_value", "amount", "mean", 365, PURCHASES),
    FeatureSpec("max_order_value_12m", "amount", "max", 365, PURCHASES),
    FeatureSpec("n_categories_12m", "category", "nunique", 365, PURCHASES),
    FeatureSpec("basket_diversity", "n_items", "mean", 365, PURCHASES),
    FeatureSpec("last_order_amount", "amount", "last", None, PURCHASES),
    FeatureSpec("recency_days", "amount", "days_since", None, PURCHASES),
    FeatureSpec("monetary_lifetime", "amount", "sum", None, PURCHASES),
    FeatureSpec("sessions_30d", "event_type", "count", 30, ("session",)),
    FeatureSpec("days_since_last_session", "event_type", "days_since", None, ("session",)),
    FeatureSpec("support_tickets_90d", "event_type", "count", 90, ("support_ticket",)),
    FeatureSpec("payment_failures_12m", "event_type", "count", 365, ("payment_failure",)),
)


def _feature(spec: FeatureSpec, window) -> Column:
    """The aggregate over the window of rows that are events of the spec's types; spine rows hold nulls and never count."""
    is_event = F.col("__event") & (F.col("event_type").isin(*spec.event_types) if spec.event_types is not None else F.lit(True))
    value = F.when(is_event, F.col(spec.column))
    number = F.when(is_event, F.col(spec.column).try_cast("double"))
    n = F.count(F.when(is_event, 1)).over(window)
    empty = F.lit(spec.fill)
    if spec.agg == "count":
        out = F.count(value).over(window)
        return out if spec.fill is None else F.when(n == 0, empty).otherwise(out)
    if spec.agg == "nunique":
        out = F.size(F.collect_set(value).over(window)).cast("long")
        return out if spec.fill is None else F.when(n == 0, empty).otherwise(out)
    if spec.agg == "sum":
        out = F.coalesce(F.sum(number).over(window), F.lit(0.0))
        return out if spec.fill is None else F.when(n == 0, empty).otherwise(out)
    if spec.agg == "days_since":
        out = (F.col("__us") - F.max(F.when(is_event, F.col("__us"))).over(window)) / F.lit(float(DAY_US))
        return out if spec.fill is None else F.coalesce(out, empty)
    if spec.agg == "last":
        out = F.max_by(value, F.when(value.isNotNull(), F.struct("__us", "__seq"))).over(window)
    else:
        out = {"mean": F.avg, "max": F.max}[spec.agg](number).over(window)
    return out if spec.fill is None else F.coalesce(out, empty)


def as_of_join(
    events: DataFrame, spine: DataFrame, specs: Sequence[FeatureSpec] = DEFAULT_SPECS, entity: str = "customer_id",
    event_ts: str = "event_ts", as_of: str = "as_of_date", seq: str | None = None, forward: bool = False,
) -> DataFrame:
    """All spine rows with a column per spec; a window is (as_of - days, as_of], or (as_of, as_of + days] if ``forward``.

    Events and spine rows of an entity are ordered by time in one shuffle; every spec with the same length shares its
    window. Times are compared in microseconds, so an event at the very moment counts. Sums, counts and distinct counts
    are 0 over no events, the rest null, unless a spec fills them; ``last`` takes the latest non-null value, of equal
    times the one with the largest ``seq``. Spine columns that a spec names are replaced.
    """
    kept = [c for c in spine.columns if c not in {s.name for s in specs}]
    columns = sorted({s.column for s in specs} | {"event_type"} | {c for c in ("amount",) if c in events.columns})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = events.select(
        F.col(entity).alias("__entity"), us(event_ts).alias("__us"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("__seq"),
        F.lit(True).alias("__event"), F.lit(None).cast(spine.select(F.struct(*kept)).schema[0].dataType).alias("__row"), *columns,
    )
    types = dict(events.dtypes)
    s = spine.select(
        F.col(entity).alias("__entity"), us(as_of).alias("__us"), F.lit(0).cast("long").alias("__seq"), F.lit(False).alias("__event"),
        F.struct(*kept).alias("__row"), *[F.lit(None).cast(types[c]).alias(c) for c in columns],
    )
    order = Window.partitionBy("__entity").orderBy("__us")

    def window(days: int | None):
        if forward:
            return order.rangeBetween(1, Window.unboundedFollowing if days is None else days * DAY_US)
        return order.rangeBetween(Window.unboundedPreceding if days is None else 1 - days * DAY_US, 0)

    out = e.unionByName(s).select("__event", "__row", *[_feature(x, window(x.days)).alias(x.name) for x in specs])
    return out.where(~F.col("__event")).select("__row.*", *[x.name for x in specs])


def leakage_report(events: DataFrame, spine: DataFrame, specs: Sequence[FeatureSpec], key: Sequence[str], **names) -> DataFrame:
    """Per spec how the feature differs from the same aggregate over the time after the date: a feature that leaks would agree.

    (feature, n_rows, corr_with_future, mean_abs_diff, frac_changed); a row counts as changed unless both values are equal
    within a relative 1e-5 and an absolute 1e-8, or both are null.
    """
    past, future = (as_of_join(events, spine, specs, forward=f, **names) for f in (False, True))
    both = past.alias("p").join(future.alias("f"), list(key))
    long = [F.struct(F.lit(s.name).alias("feature"), F.col(f"p.{s.name}").cast("double").alias("p"), F.col(f"f.{s.name}").cast("double").alias("f")) for s in specs]
    rows = both.select(F.inline(F.array(*long)))
    close = F.coalesce(F.abs(F.col("p") - F.col("f")) <= 1e-8 + 1e-5 * F.abs(F.col("f")), F.col("p").isNull() & F.col("f").isNull())
    return rows.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.corr("p", "f").alias("corr_with_future"), F.avg(F.abs(F.col("p") - F.col("f"))).alias("mean_abs_diff"),
        F.avg((~close).cast("double")).alias("frac_changed"),
    )


class LeakageError(ValueError):
    """Events lie after the date that their features are for."""


def assert_no_leakage(events: DataFrame, spine: DataFrame, entity: str = "customer_id", as_of: str = "as_of_date", event_ts: str = "event_ts") -> DataFrame:
    """Raises LeakageError if a joined table (events with the date they were joined for) holds an event after that date; else returns it."""
    late = future_rows(events, as_of, event_ts).agg(F.sum("n_future").alias("n")).first()["n"]
    if late:
        raise LeakageError(f"{late} events lie after {as_of}")
    return events


def future_rows(joined: DataFrame, as_of: str = "as_of_date", event_ts: str = "event_ts") -> DataFrame:
    """(as_of, n_rows, n_future) per date: rows of a joined table, and those whose event lies after the date."""
    late = F.col(event_ts).cast("timestamp") > F.col(as_of).cast("timestamp")
    return joined.groupBy(as_of).agg(F.count("*").alias("n_rows"), F.count_if(late).alias("n_future"))


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """The join of two tables that hold each key at most once; ValueError if one does not."""
    for name, df in (("left", left), ("right", right)):
        if not df.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"the {name} side repeats keys")
    return left.join(right, list(key), how)


def aligned(base: DataFrame, key: str, *others: DataFrame, fill: float = 0.0) -> DataFrame:
    """All rows of ``base`` with the columns of the others, which hold a row per key at most; missing numbers are ``fill``."""
    out = base
    for o in others:
        numbers = [c for c, t in o.dtypes if c != key and t in ("int", "bigint", "float", "double")]
        out = out.join(o, key, "left").fillna(fill, numbers)
    return out


def rfm_summary(
    events: DataFrame, as_of: str, entity: str = "customer_id", event_ts: str = "event_ts", amount: str = "amount", types: Sequence[str] = PURCHASES, month_days: float = 30.436875,
) -> DataFrame:
    """One row per entity with a purchase up to ``as_of``: repeat days, recency and age in months, and mean and total spend.

    Purchases of one day are one transaction at the day's first moment. frequency counts days after the first,
    monetary_value is the mean spend of those (0 without any).
    """
    end = F.to_timestamp(F.lit(as_of))
    ts = F.col(event_ts).cast("timestamp")
    rows = events.where(F.col("event_type").isin(*types) & (ts <= end)).select(F.col(entity).alias("entity"), ts.alias("ts"), F.col(amount).cast("double").alias("amount"))
    days = rows.groupBy("entity", F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"), F.sum("amount").alias("amount"), F.count("*").alias("n"))
    months = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(DAY_US * month_days)
    agg = days.groupBy("entity").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("days"), F.sum("amount").alias("total"), F.sum("n").alias("n"),
        F.min_by("amount", "day").alias("first_amount"),
    )
    return agg.select(
        F.col("entity").alias(entity), (F.col("days") - 1).alias("frequency"), months(F.col("last"), F.col("first")).alias("recency"), months(end, F.col("first")).alias("T"),
        F.when(F.col("days") > 1, (F.col("total") - F.col("first_amount")) / (F.col("days") - 1)).otherwise(0.0).alias("monetary_value"),
        F.col("total").alias("monetary_total"), F.col("n").alias("n_transactions"), F.col("first").alias("first_purchase"), F.col("last").alias("last_purchase"),
    )
