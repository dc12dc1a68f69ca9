"""Random survival forest: log-rank splits over binned features, Nelson-Aalen curves in the leaves.

Times are read on a grid of event times. A task counts its rows per (tree, node, feature, bin, last grid time at risk,
event); the counts of a (tree, node, feature) meet in one group, where every cut is scored by its log-rank statistic, so
a level of all trees takes one job and only a row per node reaches the driver. Bootstrap weights are Poisson numbers
from a hash of the row's key, so no sample is stored and rows with equal keys are drawn together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .trees import CELLS, Trees, _matrix, mixed, quantile_edges, to_bins

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass
class SurvivalForest:
    """Trees with, per tree and node, the cumulative hazard at each time of the grid."""

    x: tuple[str, ...]
    edges: list[np.ndarray]
    grid: np.ndarray
    trees: Trees
    hazard: np.ndarray

    def cumulative(self, bins: np.ndarray) -> np.ndarray:
        """Rows x grid: the mean over trees of the leaves' cumulative hazards."""
        leaf, out = self.trees.leaves(bins), np.zeros((len(bins), len(self.grid)))
        for t in range(len(self.hazard)):
            out += self.hazard[t, leaf[:, t]]
        return out / max(1, len(self.hazard))


def time_grid(df: DataFrame, time: str, event: str, points: int) -> np.ndarray:
    """At most ``points`` event times, the last one among them; all of them where there are no more distinct ones."""
    t = F.when((F.col(event) == 1) & ~F.isnan(F.col(time).cast("double")), F.col(time).cast("double"))
    got = df.agg(F.percentile_approx(t, [i / points for i in range(1, points + 1)], 10000).alias("q"), F.approx_count_distinct(t).alias("n"), F.max(t).alias("last")).first()
    if got["n"] <= points:
        return np.array(sorted(r[0] for r in df.select(t.alias("t")).where("t IS NOT NULL").distinct().limit(4 * points).collect()), dtype=np.float64)
    return np.unique(np.array([*got["q"], got["last"]], dtype=np.float64))


def on_grid(grid: np.ndarray, time: np.ndarray, event: np.ndarray) -> np.ndarray:
    """The number of grid times at which each row is at risk; an event belongs to the first grid time not before it."""
    return np.where(event == 1, np.searchsorted(grid, time, side="left") + 1, np.searchsorted(grid, time, side="right"))


def log_rank(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The log-rank statistic of counts (... x last time at risk x event) of one side against the whole."""
    at_risk = lambda c: c.sum(axis=-1)[..., ::-1].cumsum(axis=-1)[..., ::-1][..., 1:]
    n1, n, d1, d = at_risk(left), at_risk(whole), left[..., 1:, 1], whole[..., 1:, 1]
    share = n1 / np.maximum(n, 1)
    u = (d1 - d * share).sum(axis=-1)
    v = (d * share * (1 - share) * np.where(n > 1, (n - d) / np.maximum(n - 1, 1), 0.0)).sum(axis=-1)
    return np.where(v > 1e-12, u * u / np.maximum(v, 1e-12), 0.0)


def best_cut(hist: np.ndarray, least: float) -> tuple[float, int] | None:
    """Of one feature's counts (bins x last time at risk x event): the highest log-rank statistic and its cut, the first of equal ones."""
    left, whole = hist.cumsum(axis=0)[:-1], hist.sum(axis=0)
    rows = left.sum(axis=(1, 2))
    score = np.where((rows >= least) & (whole.sum() - rows >= least), log_rank(left, whole), 0.0)
    if not len(score) or not score.max() > 1e-9:
        return None
    cut = int(np.argmax(score >= score.max() * (1 - 1e-12)))
    return float(score[cut]), cut


def nelson_aalen(counts: np.ndarray) -> np.ndarray:
    """Cumulative hazards from counts (... x last time at risk x event)."""
    n = counts.sum(axis=-1)[..., ::-1].cumsum(axis=-1)[..., ::-1][..., 1:]
    return (counts[..., 1:, 1] / np.maximum(n, 1)).cumsum(axis=-1)


def fit_survival_forest(
    df: DataFrame, time: str, event: str, x: Sequence[str], key: str, trees: int = 50, depth: int = 6, least: int = 20, mtry: int | None = None, bins: int = 32, points: int = 24, seed: int = 0, bootstrap: bool = True,
) -> SurvivalForest:
    """Grows ``trees`` trees; ``mtry`` features (default: the root of their number, rounded up) are tried at a node.

    Rows without time or event take no part; missing features lie beyond the last bin. Without any event all hazards are 0.
    Draws depend on keys alone; the bins' edges are approximate quantiles, which another partitioning may shift a little.
    """
    rows = df.where(F.col(time).isNotNull() & ~F.isnan(F.col(time).cast("double")) & F.col(event).isNotNull())
    edges, grid, p = quantile_edges(rows, x, bins), time_grid(rows, time, event, points), len(x)
    width, mtry = max((len(e) for e in edges), default=0) + 1, mtry or math.ceil(math.sqrt(p))
    raw = rows.select(F.xxhash64(key).alias("h"), F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, e = to_bins(_matrix(batch.column(1), p), edges), batch.column(3).to_numpy()
            place = 2 * on_grid(grid, batch.column(2).to_numpy(), e) + (e == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary()), pa.array(place, pa.int32())], names=["h", "bins", "place"])

    table = written(raw.mapInArrow(binned, "h long, bins binary, place int"))

    def read(batch: pa.RecordBatch, own: range):
        h = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        b = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, p)
        drawn = np.stack([np.searchsorted(_POISSON, mixed(h, seed * 7919 + 1 + 1000003 * s)) if bootstrap else np.ones(len(h), int) for s in own], axis=1)
        return b, batch.column(2).to_numpy(), drawn

    places, model = 2 * (len(grid) + 1), Trees.empty(trees, depth)
    active = np.ones((trees, 1), dtype=bool)
    for level in range(depth if len(grid) and width > 1 else 0):
        nodes, at_once = 2**level, max(1, CELLS // (2**level * p * width * places))
        for begin in range(0, trees, at_once):
            own = range(begin, min(trees, begin + at_once))
            if active[own.start : own.stop].any():
                found = table.mapInArrow(_counted(read, model, own, level, p, width, places, active, mtry, seed), "slot int, node int, feature int, cells binary")
                cuts = found.groupBy("slot", "node", "feature").applyInPandas(_cut(width, places, least), "slot int, node int, feature int, gain double, cut int")
                # the first of features that split equally well
                best = cuts.groupBy("slot", "node").agg(F.max_by(F.struct("feature", "cut", "gain"), F.struct(F.col("gain"), -F.col("feature"))).alias("b")).select("slot", "node", "b.*")
                for r in best.collect():  # a row per node
                    model.feature[r["slot"], r["node"]], model.cut[r["slot"], r["node"]], model.gain[r["slot"], r["node"]] = r["feature"], r["cut"], r["gain"]
        active = np.repeat(model.feature[:, nodes - 1 : 2 * nodes - 1] >= 0, 2, axis=1)
        if not active.any():
            break

    every = model.feature.shape[1]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, every * places))
        for batch in batches:
            if batch.num_rows:
                b, place, drawn = read(batch, range(trees))
                leaf = model.leaves(b)
                for s in range(trees):
                    total[s] += np.bincount(leaf[:, s] * places + place, drawn[:, s], every * places)
        slot, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[slot, cell], pa.float64())], names=["slot", "cell", "n"])

    counts = np.zeros((trees, every * places))
    for r in table.mapInArrow(filled, "slot int, cell int, n double").groupBy("slot", "cell").agg(F.sum("n").alias("n")).collect():  # leaves by grid times
        counts[r["slot"], r["cell"]] = r["n"]
    return SurvivalForest(tuple(x), edges, grid, model, nelson_aalen(counts.reshape(trees, every, len(grid) + 1, 2)))


def _counted(read: Callable, model: Trees, own: range, level: int, p: int, width: int, places: int, active: np.ndarray, mtry: int, seed: int):
    nodes, first, size = 2**level, 2**level - 1, width * places

    def tried(slot: int, node: int) -> np.ndarray:
        order = np.argsort(mixed(np.arange(p).astype(np.uint64) + np.uint64(slot << 20 | node << 8), seed + 1))
        return np.sort(order[:mtry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), nodes * p * size))
        for batch in batches:
            if not batch.num_rows:
                continue
            b, place, drawn = read(batch, own)
            node = model.leaves(b, level)[:, own.start : own.stop] - first
            cell = (np.arange(p) * size)[None, :] + b.astype(np.int64) * places + place[:, None]
            for k, s in enumerate(own):
                at = np.flatnonzero((drawn[:, k] > 0) & (node[:, k] >= 0))
                at = at[active[s, node[at, k]]]
                if len(at):
                    total[k] += np.bincount((node[at, k][:, None] * (p * size) + cell[at]).ravel(), np.repeat(drawn[at, k], p), total.shape[1])
        whole, out = total.reshape(len(own), nodes, p, size), []
        for k, n in zip(*np.nonzero(whole.sum(axis=(2, 3))), strict=True):
            out += [(k + own.start, n + first, f, whole[k, n, f].tobytes()) for f in tried(k + own.start, int(n) + first)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array([int(v) for v in c], pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["slot", "node", "feature", "cells"])

    return run


def _cut(width: int, places: int, least: float):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        found = best_cut(sum(np.frombuffer(c).reshape(width, places // 2, 2) for c in parts["cells"]), least)
        return parts.head(1 if found else 0)[["slot", "node", "feature"]].assign(gain=found[0] if found else 0.0, cut=found[1] if found else 0)

    return run


def predict_survival_forest(df: DataFrame, forest: SurvivalForest, times: Sequence[float], horizon: float) -> DataFrame:
    """Adds ``survival`` (at each of ``times``), ``rmst`` (the curve's area up to ``horizon``) and ``mortality`` (the sum of cumulative hazards over the grid, a risk score)."""
    kept, at = list(df.columns), len(df.columns)
    upto = np.searchsorted(forest.grid, np.array(times, dtype=np.float64), side="right")
    steps = np.diff(np.minimum(np.concatenate([[0.0], forest.grid, [max(horizon, forest.grid[-1] if len(forest.grid) else 0.0)]]), horizon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = forest.cumulative(to_bins(_matrix(batch.column(at), len(forest.x)), forest.edges)) if batch.num_rows else np.zeros((0, len(forest.grid)))
            s = np.concatenate([np.ones((len(h), 1)), np.exp(-h)], axis=1)
            out = [pa.array(s[:, upto].tolist(), pa.list_(pa.float64())), pa.array(s @ steps, pa.float64()), pa.array(h.sum(axis=1), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *out], names=[*kept, "survival", "rmst", "mortality"])

    rows = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in forest.x]))
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "survival array<double>", "rmst double", "mortality double"]))
