"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Row i of n goes to place p(i) of a seeded permutation p of 0..n-1, shard p(i) mod s and slot p(i) div s. Shard and slot
of a row can thus be computed from its number alone, and the permutation can be inverted to find the row of a slot.
Only ids, sizes and checksums are shuffled; texts are read once and never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_row_number

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def permute(numbers: np.ndarray, n: int, seed: int, invert: bool = False) -> np.ndarray:
    """The places of ``numbers`` in the seeded permutation of 0..n-1, or with ``invert`` the numbers of places.

    The network permutes 0..4**b - 1, the least such range with n values or more; values from n on walk on along
    their cycle until they fall below n, which takes under four steps on average and always ends.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, keys = np.uint64((1 << int(half)) - 1), _keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys[::-1] if invert else keys:
            if invert:
                left, right = right ^ (_mix(left ^ key) & mask), left
            else:
                left, right = right, left ^ (_mix(right ^ key) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(numbers).astype(np.uint64))
        while len(walk := np.flatnonzero(out >= np.uint64(n))):
            out[walk] = once(out[walk])
    return out.astype(np.int64)


def assign_shards(df: DataFrame, shards: int, seed: int = 20240501, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    ``size`` is the UTF-8 length of the text plus 16 (null text: 16) and ``text_crc32`` its unsigned checksum (null: 0,
    that of no bytes). Rows are numbered by key (nulls first), checksum and size, so rows that repeat are
    interchangeable. Shards differ by at most one row; slots of a shard run from 0 without a gap. The law ``rows``
    looks at numbers alone: equal texts, like any others, go to places of their own. An empty table gives an empty
    result; columns other than key and text are not read.
    """
    narrow = df.select(
        df[key].alias("key"),
        (F.coalesce(F.octet_length(df[text]), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(df[text], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered = global_row_number(narrow, ["key", "text_crc32", "size"], "number", partitions)
    n = numbered.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("number").to_numpy(), n, seed)
            cols = [batch.column(c) for c in ("key", "size", "text_crc32")]
            cols += [pa.array((at % shards).astype(np.int32)), pa.array(at // shards)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "size", "text_crc32", "shard", "slot"])

    kind = df.schema[key].dataType.simpleString()
    placed = numbered.mapInArrow(place, f"key {kind}, size long, text_crc32 long, shard int, slot long")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text", seed: int = 20240501) -> None:
    """Writes ``df`` as ``path/shard=k`` Parquet folders with the slot as a column, sorted by slot. Keys must be unique.

    A shard is written by as many tasks as the shuffle has partitions for it, so no task holds a whole shard.
    """
    placed = assign_shards(df, shards, seed, key, text).select(key, "shard", "slot")
    out = df.join(placed, key)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(max(n, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
