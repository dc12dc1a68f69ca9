"""Running sums in a global order without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    df: DataFrame, lead: Column, then: list[Column], sums: Mapping[str, Column] | None = None, number: str = "rn", buckets: int | None = None, by: Sequence[str] = (), mean_rank: str | None = None,
) -> DataFrame:
    """Adds the row's number from 1 and running sums in ascending order of ``lead`` (a number, nulls last) and ``then``, within groups ``by``.

    Each group's rows are cut into ranges of ``lead`` at its approximate quantiles; a range is summed by itself, and the
    totals of the group's ranges before it, a row per range, are added. The result equals a ROWS window over the
    group, whatever the cuts are; only a value of ``lead`` that many rows share is one range. A row per group and range
    is broadcast, so groups must be few; ``df`` is computed three times, so write what is costly first.
    ``mean_rank`` names a further column: the mean of the numbers of all rows with the same ``lead``.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = [F.col(b).alias(f"__b{i}") for i, b in enumerate(by)]
    own = [f"__b{i}" for i in range(len(by))]
    keyed = df.withColumn("__running_lead", F.when(F.isnan(lead.cast("double")), None).otherwise(lead.cast("double"))).select("*", *groups)
    cuts = keyed.groupBy(*own).agg(F.array_distinct(F.percentile_approx("__running_lead", [i / n for i in range(1, n)] or [0.5], 1000)).alias("__cuts"))
    same = lambda left, right: [F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}")) for b in own]
    # a row per group
    keyed = keyed.alias("k").join(F.broadcast(cuts).alias("c"), same("k", "c")) if own else keyed.alias("k").crossJoin(F.broadcast(cuts).alias("c"))
    place = F.when(F.col("__running_lead").isNull(), F.size("__cuts") + 1).otherwise(F.size(F.filter("__cuts", lambda b: b < F.col("__running_lead"))))
    parts = {number: F.lit(1).cast("long"), **(sums or {})}
    keyed = keyed.select("k.*", F.coalesce(place, F.lit(0)).alias("__range")).select("*", *[c.alias(f"__v_{k}") for k, c in parts.items()])
    totals = keyed.groupBy(*own, "__range").agg(*[F.sum(f"__v_{k}").alias(k) for k in parts])
    before = Window.partitionBy(*own).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*own, "__range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__o_{k}") for k in parts])
    inside = Window.partitionBy(*own, "__range").orderBy(F.col("__running_lead").asc_nulls_last(), *then).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.alias("k").join(F.broadcast(offsets).alias("o"), [*same("k", "o"), F.col("k.__range") == F.col("o.__range")])  # a row per range
    out = out.select("k.*", *[f"__o_{k}" for k in parts])
    added = {k: F.coalesce(F.sum(f"__v_{k}").over(inside), F.lit(0)) + F.col(f"__o_{k}") for k in parts}
    if mean_rank:  # rows of one value are in one range
        peers = Window.partitionBy(*own, "__range").orderBy(F.col("__running_lead").asc_nulls_last())
        last = F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        added[mean_rank] = F.col(f"__o_{number}") + last - (F.count(F.lit(1)).over(peers.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    return out.select(*[F.col(c) for c in df.columns], *[c.alias(k) for k, c in added.items()])
