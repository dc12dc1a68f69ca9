"""Histogram trees: many trees at once, grown level by level from sums that Spark aggregates.

Features are cut into bins at approximate quantiles once. A level of all trees takes one job: every task sums count,
numerator and denominator per (tree, node, feature, bin) of its rows, partial sums meet by (tree, node), and the best
split of a node is chosen where they meet, so that only a row per node reaches the driver. A tree's value in a node is
numerator / denominator and a split's gain is what it adds to numerator ** 2 / denominator, which covers least squares
(weight * target, weight), residual boosting and treatment effects (residual products, squared treatment residuals).

Trees are complete in their numbering: the children of node i are 2 i + 1 and 2 i + 2. A model is arrays of trees by
nodes, bounded by its parameters however many rows there are. Missing features lie beyond the last bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

#: Rows of a batch that are worked on at once, so that a task's memory does not hang on the batches' size.
SLICE = 2048
#: Numbers that a task holds while it adds up rows of equal bins.
HELD = 2_000_000

#: Cells (slot, node, feature, bin) that a task sums at once: 24 bytes each.
CELLS = 1 << 21


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows`` rows at most, without empty ones."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def quantile_edges(df: DataFrame, x: Sequence[str], bins: int = 32, accuracy: int = 2000) -> list[np.ndarray]:
    """Per feature the distinct inner edges of at most ``bins`` bins; a value lies in the bin of as many edges as are below it."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = df.agg(*[F.percentile_approx(finite(c), [i / bins for i in range(1, bins)], accuracy).alias(f"e{i}") for i, c in enumerate(x)]).first()
    return [np.unique(np.array(e or [], dtype=np.float64)) for e in got]


def to_bins(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (rows x features) of raw features; NaN lies in the last one."""
    return np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit hashes and a salt (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1F123BB5) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class Trees:
    """Per tree and node the feature (-1: a leaf), the last bin that goes left, the gain, and the sums count, numerator, denominator of the split rows."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    sums: np.ndarray

    @staticmethod
    def empty(n: int, depth: int) -> Trees:
        nodes = 2 ** (depth + 1) - 1
        return Trees(depth, np.full((n, nodes), -1, np.int16), np.zeros((n, nodes), np.uint8), np.zeros((n, nodes)), np.zeros((n, nodes, 3)))

    def leaves(self, bins: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The node (rows x trees) in which each row ends, or is after ``depth`` levels."""
        node = np.zeros((len(bins), len(self.feature)), dtype=np.int32)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(bins))[:, None]
        for _ in range(self.depth if depth is None else depth):
            f = self.feature[tree, node]
            right = bins[row, np.maximum(f, 0)] > self.cut[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def take(self, values: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """``values`` (trees x nodes) of the rows' leaves, rows x trees."""
        return values[np.arange(len(self.feature))[None, :], self.leaves(bins)]


def best_split(hist: np.ndarray, least: float, l2: float, features: np.ndarray | None = None) -> tuple | None:
    """Of sums (features x bins x 3): (gain, feature, cut, left sums, right sums) of the best split with ``least`` rows on both sides; the first of equal ones."""
    whole = hist[0].sum(axis=0)
    left = hist.cumsum(axis=1)[:, :-1]
    right = whole - left
    worth = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 2] + l2, 1e-300)
    gain = worth(left) + worth(right) - worth(whole)
    fits = (left[..., 0] >= least) & (right[..., 0] >= least) & (left[..., 2] > 0) & (right[..., 2] > 0)
    if features is not None:
        fits &= features[:, None]
    gain = np.where(fits, gain, -np.inf)
    if gain.size == 0 or not gain.max() > 1e-12 * max(1.0, abs(worth(whole))):
        return None
    f, cut = np.unravel_index(int(np.argmax(gain >= gain.max() * (1 - 1e-12))), gain.shape)
    return float(gain[f, cut]), int(f), int(cut), left[f, cut], right[f, cut]


Inputs = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def grow(rows: DataFrame, inputs: Inputs, slots: int, features: int, bins: int, depth: int, least: float = 20, l2: float = 0.0, mtry: int | None = None, seed: int = 0) -> Trees:
    """Grows ``slots`` trees; ``inputs`` gives of a batch the bins, and per slot how many rows take part with them, the sums of their numerators and of their denominators (rows x slots)."""
    trees = Trees.empty(slots, depth)
    active = np.ones((slots, 1), dtype=bool)  # nodes of the level that may be split
    for level in range(depth):
        width = 2**level
        at_once = max(1, CELLS // (width * features * bins))
        for begin in range(0, slots, at_once):
            own = range(begin, min(slots, begin + at_once))
            if not active[own.start : own.stop].any():
                continue
            found = rows.mapInArrow(_summed(inputs, trees, own, level, features, bins, active), "slot int, node int, cells binary").groupBy("slot", "node").applyInPandas(_chosen(features, bins, least, l2, mtry, seed), "slot int, node int, gain double, feature int, cut int, sums array<double>")
            for r in found.collect():  # a row per node
                sums = np.array(r["sums"]).reshape(3, 3)
                trees.sums[r["slot"], r["node"]] = sums[0]
                if r["feature"] >= 0:
                    trees.feature[r["slot"], r["node"]], trees.cut[r["slot"], r["node"]], trees.gain[r["slot"], r["node"]] = r["feature"], r["cut"], r["gain"]
                    trees.sums[r["slot"], 2 * r["node"] + 1], trees.sums[r["slot"], 2 * r["node"] + 2] = sums[1], sums[2]
        active = np.repeat(trees.feature[:, width - 1 : 2 * width - 1] >= 0, 2, axis=1)
    return trees


def _summed(inputs: Inputs, trees: Trees, own: range, level: int, features: int, bins: int, active: np.ndarray):
    width, first = 2**level, 2**level - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), width * features * bins, 3))
        for batch in sliced(batches):
            b, part, num, den = inputs(batch)
            node = trees.leaves(b, level) - first
            cell = (np.arange(features) * bins)[None, :] + b
            for k, s in enumerate(own):
                at = np.flatnonzero((part[:, s] > 0) & (node[:, s] >= 0))
                at = at[active[s, node[at, s]]]
                if len(at):
                    flat = (node[at, s][:, None] * (features * bins) + cell[at]).ravel()
                    for j, w in enumerate((part[at, s], num[at, s], den[at, s])):
                        total[k, :, j] += np.bincount(flat, np.repeat(w, features), total.shape[1])
        whole = total.reshape(len(own), width, -1)
        k, n = np.nonzero(np.abs(whole).sum(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(k + own.start, pa.int32()), pa.array(n + first, pa.int32()), pa.array([whole[i, j].tobytes() for i, j in zip(k, n, strict=True)], pa.binary())], names=["slot", "node", "cells"])

    return run


def _chosen(features: int, bins: int, least: float, l2: float, mtry: int | None, seed: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        slot, node = int(parts["slot"].iloc[0]), int(parts["node"].iloc[0])
        hist = sum(np.frombuffer(c).reshape(features, bins, 3) for c in parts["cells"])
        tried = None
        if mtry is not None and mtry < features:
            order = np.argsort(mixed(np.arange(features).astype(np.uint64) + np.uint64(slot << 20 | node << 8), seed + 1))
            tried = np.isin(np.arange(features), order[:mtry])
        found = best_split(hist, least, l2, tried)
        whole = hist[0].sum(axis=0)
        gain, f, cut, left, right = found or (0.0, -1, 0, whole * 0, whole * 0)
        return pd.DataFrame({"slot": [slot], "node": [node], "gain": [gain], "feature": [f], "cut": [cut], "sums": [np.concatenate([whole, left, right]).tolist()]})

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` numbers each, nulls within as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of ``width`` bytes each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def added_up(parts: Iterator[tuple[np.ndarray, np.ndarray]], features: int, width: int) -> Iterator[pa.RecordBatch]:
    """(bins, sums) of rows as one row per distinct bins; where a task meets too many of them, some are told more than once."""
    held, n, least = [], 0, 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        bins, sums = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.lexsort(bins.T[::-1]) if features else np.arange(len(bins))
        bins, sums = bins[order], sums[order]
        start = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)])
        return bins[start], np.add.reduceat(sums, start, axis=0)

    def told() -> Iterator[pa.RecordBatch]:
        bins, sums = held[0]
        for lo in range(0, len(bins), SLICE):
            own = np.ascontiguousarray(sums[lo : lo + SLICE])
            lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, width, dtype=np.int32), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins[lo : lo + SLICE]], pa.binary()), lists], names=["bins", "sums"])

    for bins, sums in parts:
        held.append((bins, sums))
        n += len(bins)
        if n >= 2 * least + SLICE and n * width >= HELD // 2:
            held = [reduced()]
            n = least = len(held[0][0])
            if n * width >= HELD:
                yield from told()
                held, n, least = [], 0, 0
    if held:
        held = [reduced()]
        yield from told()


@dataclass
class Boosted:
    """Per slot a first value and rounds of trees whose leaves' values are added up."""

    x: tuple[str, ...]
    edges: list[np.ndarray]
    first: np.ndarray
    rounds: list[tuple[Trees, np.ndarray]] = field(default_factory=list)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Rows x slots."""
        out = np.tile(self.first, (len(bins), 1))
        for trees, values in self.rounds:
            out += trees.take(values, bins)
        return out


def fit_boosted(df: DataFrame, x: Sequence[str], targets: Sequence[Column], weights: Sequence[Column], rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 20, l2: float = 1.0) -> Boosted:
    """A least-squares booster per target, all slots in the same jobs; a row without a positive weight, or without a target, takes no part in a slot."""
    edges, n = quantile_edges(df, x, bins), len(targets)
    width = max((len(e) for e in edges), default=0) + 1
    raw = df.select(F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.array(*[t.cast("double") for t in targets]).alias("t"), F.array(*[w.cast("double") for w in weights]).alias("w"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            t, w = _matrix(batch.column(1), n), _matrix(batch.column(2), n)
            part = (w > 0) & ~np.isnan(t)
            w = np.where(part, w, 0.0)
            return to_bins(_matrix(batch.column(0), len(x)), edges), np.concatenate([part, w * np.where(part, t, 0.0), w], axis=1)

        return added_up(map(one, sliced(batches)), len(x), 3 * n)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(((_bytes(batch.column(0), len(x)), _matrix(batch.column(1), 3 * n)) for batch in sliced(batches)), len(x), 3 * n)

    # rows of equal bins end in equal leaves, so their sums stand for them in every round
    rows = written(raw.mapInArrow(binned, "bins binary, sums array<double>").repartition("bins").mapInArrow(met, "bins binary, sums array<double>"))
    sums = rows.agg(*[F.sum(F.col("sums")[s]).alias(f"s{s}") for s in range(n, 3 * n)]).first()
    model = Boosted(tuple(x), edges, np.array([(sums[f"s{n + s}"] or 0.0) / sums[f"s{2 * n + s}"] if sums[f"s{2 * n + s}"] else 0.0 for s in range(n)]))

    def inputs(batch: pa.RecordBatch):
        b = _bytes(batch.column(0), len(x))
        part, t, w = np.split(_matrix(batch.column(1), 3 * n), 3, axis=1)
        return b, part, t - w * model.predict(b), w

    for _ in range(rounds):
        trees = grow(rows, inputs, n, len(x), width, depth, least, l2)
        if not (trees.feature >= 0).any():
            break
        model.rounds.append((trees, rate * trees.sums[:, :, 1] / (trees.sums[:, :, 2] + l2)))
    return model


def predict_boosted(df: DataFrame, model: Boosted, names: Sequence[str], by: Column | None = None, among: int = 1, swaps: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Adds a column per name: slot i, or with ``by`` (a number below ``among``) slot i * among + by, so that a row gets its own fold's model.

    ``swaps`` gives further columns: of each name the features that are set to other values before slot 0 predicts.
    """
    number = F.coalesce(by, F.lit(0)).cast("int") if by is not None else F.lit(0)
    rows = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in model.x])).withColumn("__by", number)
    kept, at = list(df.columns), len(df.columns)
    swaps = swaps or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raw, own = _matrix(batch.column(at), len(model.x)), batch.column(at + 1).to_numpy(zero_copy_only=False).astype(int)
            p = model.predict(to_bins(raw, model.edges)) if names else None
            out = [p[np.arange(len(raw)), i * among + own] for i in range(len(names))]
            for values in swaps.values():
                other = raw.copy()
                for c, v in values.items():
                    other[:, model.x.index(c)] = v
                out.append(model.predict(to_bins(other, model.edges))[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *[pa.array(c, pa.float64()) for c in out]], names=[*kept, *names, *swaps])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{c}` double" for c in (*names, *swaps)]]))
