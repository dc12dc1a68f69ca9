"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Only (id, source, size, hash bucket) leave the scan. Sizes are summed by source and hash bucket before any
shuffle, so a source with a third of all rows costs each task one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import global_row_number, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source are cut at a border of one of so many hash buckets.
BUCKETS = 4096


def water_fill(sources: DataFrame, total: int, cap: float) -> DataFrame:
    """Of sources (source, source_size, weight): the same with ``target``; together they get ``total`` shared by weight.

    A target stops at ``cap`` times its source's size, and the excess is reshared by weight among those below, until
    none is above. Each round clamps every source over the common level; only three sums reach the driver.
    """
    limit = F.col("source_size") * F.lit(cap)
    level = 0.0
    clamped = -1
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        s = sources.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if s["n"] == clamped or not s["weight"]:
            break
        clamped, level = s["n"], (total - s["capped"]) / s["weight"]
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level))))


def _bucket(key, seed: int):
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 3), 16, 10).cast("int")


def mixing_plan(docs: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """Of docs (source, size, bucket): a row per source with source_size, target, epochs, whole repetitions and the cut bucket."""
    sums = written(docs.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = global_row_number(sizes.select(F.col("source").isNull().alias("last"), "source", "source_size"), ["last", "source"], "rank")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = written(ranked.select("source", "source_size", turn.cast("long").alias("weight")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = water_fill(sources, total if share == 1.0 else int(total * share), float(cap)).withColumn("epochs", epochs)
    whole = F.floor("epochs")
    goal = (F.col("epochs") - whole) * F.col("source_size")
    # a source has one row per bucket at most here, whatever its documents
    run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).withColumn("before", F.col("upto") - F.col("words"))
    cuts = (
        run.alias("c").join(filled.withColumn("goal", goal).alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        # a bucket is taken if that brings its source nearer to the goal than stopping before it
        .where((F.col("goal") > 0) & (F.col("upto") - F.col("goal") <= F.col("goal") - F.col("before")))
        .groupBy(F.col("s.source").alias("source")).agg(F.max("bucket").alias("cut"))
    )
    return written(
        filled.alias("f").join(cuts.alias("k"), F.col("f.source").eqNullSafe(F.col("k.source")), "left")
        .select("f.source", "source_size", "target", "epochs", whole.cast("int").alias("whole"), F.coalesce("cut", F.lit(-1)).alias("cut"))
    )


def _sized(df: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(df[text], F.lit(WORD)), F.lit(0)).cast("long")
    return written(df.select(df[key].alias("key"), df[source].alias("source"), size.alias("size"), _bucket(df[key], seed).alias("bucket")))


def _repeats():
    return F.col("p.whole") + (F.col("d.bucket") <= F.col("p.cut")).cast("int")


def mix_sources(
    df: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, share: float = 1.0, seed: int = 17,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``df``: key, source, size, source_size, target, epochs, repeats, taken.

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0). Sources in code-point order, null last, weigh ``weights``
    in turn and share ``share`` of all sizes. A source taken e = target / source_size times takes each document
    floor(e) times, and once more those whose seeded hash of the id falls below a cut; the cut is the border of a hash
    bucket that brings the source's words nearest to its target. No document is taken more than ``cap`` times. Rows
    with one id share their fate, so ids should be spread. A source without words gets 0; an empty table gives an
    empty result; other columns are not read.
    """
    docs = _sized(df, seed, key, text, source)
    plan = mixing_plan(docs, weights, cap, share)
    return (
        docs.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select(F.col("d.key").alias(key), F.col("d.source").alias(source), "size", "source_size", "target", "epochs", _repeats().alias("repeats"), (F.col("size") * _repeats()).alias("taken"))
    )


def repeat_rows(
    df: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, share: float = 1.0, seed: int = 17,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of ``df`` as often as ``mix_sources`` takes them; ``df``'s columns stay as they are.

    Rows meet the plan by source, a row per source, so texts are not shuffled as long as Spark can broadcast that.
    """
    plan = mixing_plan(_sized(df, seed, key, text, source), weights, cap, share)
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[source].alias("source"), _bucket(df[key], seed).alias("bucket"))
    joined = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.where(_repeats() > 0).select(F.explode(F.array_repeat(F.lit(1), _repeats())), "row").select("row.*")
