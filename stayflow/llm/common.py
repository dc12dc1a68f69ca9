"""What several operators share: written intermediate tables, global row numbers and connected components.

Every table that is used twice is written to the folder in ``spark.checkpoint.dir`` and read again, so that a
lost executor costs a rerun of single tasks and never of the whole lineage.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, one of this machine serves a local session; a cluster needs the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stayflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(run):
    """The batch function of a task that gives freed memory back when it ends: worker processes stay for later tasks, which share their executor's memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform.startswith("linux"):
                with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
                    ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def global_row_number(df: DataFrame, order: list, name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """Adds the row's number from 0 in the order of the columns ``order`` (nulls first), over all rows.

    One range shuffle sorts the rows; each partition then needs only the number of rows before it, which is a
    table of one row per partition (so its broadcast is bounded by the partition count). Rows that are equal in
    every order column are interchangeable: which of them comes first is not defined. The result is a written table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__before"))
    return (
        placed.join(F.broadcast(before), "__part")
        .withColumn(name, F.col("__seq") + F.col("__before"))
        .drop("__part", "__seq", "__before")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (src, dst) of longs: a row (node, component) for each node, where component is the smallest node reachable.

    Contraction: each round maps every node to the smallest of itself and its neighbours and rewrites the edges to
    those; the smallest node of a component always maps to itself, and every other node loses at least half of its
    fellows in each round, so the rounds grow with the logarithm of the longest path. Each round's tables are
    written. Self loops and repeated edges do no harm; null ends are dropped.
    """
    links = written(
        edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    )
    rounds = []
    while True:
        both = links.union(links.select("dst", "src"))
        parents = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("src")).alias("parent")))
        rounds.append(parents)
        p, q = parents.select(F.col("node").alias("src"), F.col("parent").alias("ps")), parents.select(F.col("node").alias("dst"), F.col("parent").alias("pd"))
        links = written(
            links.join(p, "src").join(q, "dst").where("ps <> pd")
            .select(F.least("ps", "pd").alias("src"), F.greatest("ps", "pd").alias("dst")).distinct()
        )
        if links.isEmpty():
            break
    labels = rounds[-1].select("node", F.col("parent").alias("component"))
    for parents in reversed(rounds[:-1]):
        up = labels.select(F.col("node").alias("parent"), F.col("component").alias("__up"))
        labels = parents.join(up, "parent", "left").select("node", F.coalesce("__up", "parent").alias("component"))
    return written(labels)


def star_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of links between ids ``left`` and ``right``: for each id the smallest one it is connected with in the block.

    Stars to these roots connect what the block's links connect, with one row per id. ``same``: both sides are one set.
    """
    top = np.iinfo(np.int64).max
    a, b = left, right
    while True:
        down = np.minimum(b, np.where(linked, a[:, None], top).min(axis=0))
        up = np.minimum(a, np.where(linked, down[None, :], top).min(axis=1))
        if same:
            down = up = np.minimum(down, up)
        if (down == b).all() and (up == a).all():
            return a, b
        a, b = up, down
