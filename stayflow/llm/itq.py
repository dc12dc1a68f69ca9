"""Iterative quantisation: a rotation of the principal components that makes sign codes balanced and faithful.

Gong & Lazebnik, "Iterative Quantization: A Procrustean Approach to Learning Binary Codes" (CVPR 2011). The model is
a mean and one matrix, fitted on a bounded sample; every row is then coded where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Itq:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """An uint64 code of up to 64 sign bits for each row."""
        bits = (vectors - self.mean) @ self.rotation > 0
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64))


def fit_itq(vectors: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 7) -> Itq:
    """Alternates codes = sign(V R) and the orthogonal R nearest to them, from a seeded random rotation.

    ``bits`` is cut to the dimensions; with fewer rows than dimensions the missing components are any orthogonal ones.
    """
    dims = vectors.shape[1]
    bits = min(bits, dims, 64)
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(dims)
    centred = vectors - mean
    _, _, components = np.linalg.svd(centred.T @ centred)
    basis = components[:bits].T
    projected = centred @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(projected.T @ signs)
        rotation = u @ vt
    return Itq(mean, basis @ rotation)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part: not null, not zero, no null or non-finite component.

    Rows that repeat an id and a vector count once, and of different vectors with one id the smallest stays.
    """
    v = F.transform(df[vector], lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0.0)
    rows = df.select(df[key].cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    return rows.where(finite & some).groupBy("id").agg(F.min("vector").alias("vector"))


def sample_vectors(vectors: DataFrame, most: int) -> np.ndarray:
    """``most`` vectors at most, those whose id hashes lowest, of the width that is most frequent among them.

    In a table of many times ``most`` rows only those with a hash below a bound, about twice as many as wanted, are
    sorted, so what tasks send to the driver does not grow with their number; too few below it double the bound.
    """
    hashed = vectors.withColumn("__hash", F.xxhash64("id"))
    n, share = vectors.count(), 1.0
    if n > 4 * most:
        share = 2 * most / n
        while share < 1 and hashed.where(F.col("__hash") < _below(share)).count() < most:
            share *= 2
    some = hashed.where(F.col("__hash") < _below(share)) if share < 1 else hashed
    rows = some.orderBy("__hash", "id").limit(most).select("vector").collect()
    widths = [len(r[0]) for r in rows]
    if not widths:
        return np.zeros((0, 1))
    width = max(set(widths), key=lambda w: (widths.count(w), -w))
    return np.array([r[0] for r in rows if len(r[0]) == width], dtype=np.float64)


def _below(share: float) -> int:
    """The bound that this share of signed 64-bit hashes lies below."""
    return min(int(share * 2**64) - 2**63, 2**63 - 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps squares in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=1e-320)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def coded(vectors: DataFrame, model: Itq, normalise: bool) -> DataFrame:
    """(id, code as long, vector as packed doubles) of the rows of the model's width; scaled to length 1 before coding if asked."""
    width = len(model.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            scaled = unit(values) if normalise else values
            codes = model.codes(scaled).view(np.int64) if len(values) else np.zeros(0, np.int64)
            packed = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes), pa.array([p.tobytes() for p in packed], pa.binary())], names=["id", "code", "packed"])

    return vectors.where(F.size("vector") == width).mapInArrow(run, "id long, code long, packed binary")


def unpack(column: pa.Array | list, width: int) -> np.ndarray:
    """Packed doubles as a matrix."""
    raw = b"".join(column.to_pylist() if isinstance(column, pa.Array) else column)
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width)
