"""Honest causal forest: effects as ratios of residual products, splits and leaf values from disjoint rows.

With outcome and treatment residuals from cross-fitted nuisances, a tree splits where sums (W Y)^2 / W^2 gain most,
that is where effects differ; leaves take sum(W Y) / sum(W^2) of rows that did not choose the splits. Trees come in
little bags that share a random part of the rows, which gives intervals. Which rows a tree sees follows from hashes of
their key, so no sample is stored, and all trees of all arms grow together (see trees).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from .meta import centred, nuisances
from .trees import Trees, _bytes, _matrix, grow, mixed, quantile_edges, sliced, to_bins


@dataclass
class CausalForest:
    """Per arm but 0 and tree: the trees, and per node the estimate half's sums (rows, treated, control, num, den) and its trusted effect."""

    x: tuple[str, ...]
    edges: list[np.ndarray]
    arms: int
    bags: int
    per_bag: int
    bag: float
    trees: Trees
    sums: np.ndarray
    value: np.ndarray
    ate: np.ndarray

    @property
    def each(self) -> int:
        return self.bags * self.per_bag

    def importances(self) -> np.ndarray:
        """(arms - 1) x features: each feature's share of the gain, a mean over trees that split; zeros where none does."""
        out = np.zeros((self.arms - 1, len(self.x)))
        for a in range(self.arms - 1):
            shares = []
            for t in range(a * self.each, (a + 1) * self.each):
                split = self.trees.feature[t] >= 0
                own = np.bincount(self.trees.feature[t][split], self.trees.gain[t][split], len(self.x))
                if own.sum() > 0:
                    shares.append(own / own.sum())
            out[a] = np.mean(shares, axis=0) if shares else 0
        return out

    def told(self, bins: np.ndarray, z: float) -> list[np.ndarray]:
        """Per arm but 0: effect, lower and upper bound, kernel effect of rows."""
        leaf = self.trees.leaves(bins)
        slot = np.arange(len(self.value))[None, :]
        value, sums = self.value[slot, leaf], self.sums[slot, leaf]
        out = []
        for a in range(self.arms - 1):
            own = value[:, a * self.each : (a + 1) * self.each].reshape(len(bins), self.bags, self.per_bag)
            effect = own.mean(axis=(1, 2))
            # the bags' spread less what trees within a bag differ by themselves, brought from a bag to all rows
            between = own.mean(axis=2).var(axis=1, ddof=1) if self.bags > 1 else np.zeros(len(bins))
            within = own.var(axis=2, ddof=1).mean(axis=1) if self.per_bag > 1 else np.zeros(len(bins))
            half = z * np.sqrt(self.bag * np.maximum(between - within / self.per_bag, 0))
            s = sums[:, a * self.each : (a + 1) * self.each]
            n = np.maximum(s[..., 0], 1)  # a leaf without rows abstains: its sums are 0
            num, den = (s[..., 3] / n).sum(axis=1), (s[..., 4] / n).sum(axis=1)
            out += [effect, effect - half, effect + half, np.where(den > 0, num / np.where(den > 0, den, 1), self.ate[a])]
        return out


def _bag(h: np.ndarray, slots: int, each: int, per_bag: int, bag: float, share: float, honest: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row (of hash h) chooses splits and whether it fills leaves, rows x slots; the arms' trees see the same draws."""
    split, fill = np.zeros((len(h), each), dtype=bool), np.zeros((len(h), each), dtype=bool)
    for t in range(each):
        if t % per_bag == 0:
            within = mixed(h, seed * 3 + 1 + 1000003 * (t // per_bag)) < bag
        own = within & (mixed(h, seed * 3 + 2 + 1000003 * t) < min(1.0, share / bag))
        half = mixed(h, seed * 3 + 3 + 1000003 * t)
        split[:, t] = own & (half >= honest)
        fill[:, t] = own & (half < honest) if honest > 0 else own
    return np.tile(split, (1, slots // each)), np.tile(fill, (1, slots // each))


def fit_forest(
    df: DataFrame, y: str, arm: str, x: Sequence[str], arms: int, key: str, bags: int = 10, per_bag: int = 5, depth: int = 5, least: int = 15, bag: float = 0.5, share: float = 0.45,
    honest: float = 0.5, trusted: int = 3, mtry: int | None = None, bins: int = 32, seed: int = 0, ready: bool = False, **boost,
) -> CausalForest:
    """The forest of each arm against arm 0, ``bags`` times ``per_bag`` trees for each.

    ``share`` of the rows goes into a tree, all from its bag of ``bag``; ``honest`` of those fill the leaves (0: the rows
    that chose the splits fill them too). A node is trusted with ``trusted`` treated and control rows; a leaf that is not
    takes the value of its nearest trusted ancestor, then the arm's overall effect. ``ready``: the columns of
    ``nuisances`` are there already.
    """
    rows = df if ready else nuisances(df, y, arm, x, arms, key, seed=seed, **boost)
    edges, p = quantile_edges(rows, x, bins), len(x)
    width, each, slots = max(len(e) for e in edges) + 1, bags * per_bag, (arms - 1) * bags * per_bag
    pairs = [centred(y, arm, a) for a in range(1, arms)]
    has = F.col(arm).isNotNull() & F.col(y).isNotNull()
    raw = rows.where(has).select(F.xxhash64(key).alias("h"), F.array(*[F.col(c).cast("double") for c in x]).alias("x"), F.col(arm).cast("int").alias("arm"), F.array(*[c for c, _ in pairs]).alias("ry"), F.array(*[c for _, c in pairs]).alias("rw"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = to_bins(_matrix(batch.column(1), p), edges)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary()), *batch.columns[2:]], names=["h", "bins", "arm", "ry", "rw"])

    # rows of equal bins lie together, so a batch has few distinct ones; the hash parts those that many rows share
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(raw.mapInArrow(binned, "h long, bins binary, arm int, ry array<double>, rw array<double>").repartitionByRange(parts, "bins", "h").sortWithinPartitions("bins"))
    overall = table.agg(*[f(F.when(F.col("arm").isin(0, a + 1), v)).alias(f"{n}{a}") for a in range(arms - 1) for n, f, v in (("n", F.sum, F.col("rw")[a] * F.col("ry")[a]), ("d", F.sum, F.col("rw")[a] * F.col("rw")[a]))]).first()
    ate = np.array([(overall[f"n{a}"] or 0.0) / overall[f"d{a}"] if overall[f"d{a}"] else 0.0 for a in range(arms - 1)])

    def read(batch: pa.RecordBatch, leaves: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct bins of a batch and, of their rows that choose splits or fill leaves, sums (bins x slots): rows, treated, control, num, den."""
        h, own = batch.column(0).to_numpy().astype(np.int64).view(np.uint64), batch.column(2).to_numpy()
        b, ry, rw = _bytes(batch.column(1), p), _matrix(batch.column(3), arms - 1), _matrix(batch.column(4), arms - 1)
        drawn = _bag(h, each, each, per_bag, bag, share, honest, seed)[leaves]
        group = np.cumsum(np.r_[False, (b[1:] != b[:-1]).any(axis=1)])
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out = np.zeros((5, len(first), slots))
        for a in range(arms - 1):
            for j, pick, weight in ((1, own == a + 1, None), (2, own == 0, None), (3, (own == 0) | (own == a + 1), rw[:, a] * ry[:, a]), (4, (own == 0) | (own == a + 1), rw[:, a] * rw[:, a])):
                at = np.flatnonzero(pick)
                if len(at):
                    start = np.flatnonzero(np.r_[True, np.diff(group[at]) != 0])
                    sums = np.add.reduceat(drawn[at].astype(np.float64) if weight is None else np.where(drawn[at], weight[at, None], 0.0), start, axis=0)
                    out[j, group[at[start]], a * each : (a + 1) * each] = sums
        out[0] = out[1] + out[2]
        return b[first], list(out)

    def inputs(batch: pa.RecordBatch):
        b, (n, _, _, num, den) = read(batch, False)
        return b, n, num, den

    trees = grow(table, inputs, slots, p, width, depth, least, 0.0, mtry, seed)
    nodes = trees.feature.shape[1]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slots * nodes, 5))
        for batch in sliced(batches):
            b, sums = read(batch, True)
            cell = (np.arange(slots)[None, :] * nodes + trees.leaves(b)).ravel()
            for j, v in enumerate(sums):
                total[:, j] += np.bincount(cell, v.ravel(), len(total))
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(total[at, j], pa.float64()) for j in range(5)]], names=["cell", *[f"v{j}" for j in range(5)]])

    found = table.mapInArrow(filled, "cell long, " + ", ".join(f"v{j} double" for j in range(5))).groupBy("cell").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(5)])
    sums = np.zeros((slots * nodes, 5))
    for r in found.collect():  # a row per tree and leaf
        sums[r["cell"]] = [r[f"v{j}"] for j in range(5)]
    sums = sums.reshape(slots, nodes, 5)
    return CausalForest(tuple(x), edges, arms, bags, per_bag, bag, trees, sums, honest_values(trees, sums, np.repeat(ate, each), trusted), ate)


def honest_values(trees: Trees, sums: np.ndarray, ate: np.ndarray, trusted: int) -> np.ndarray:
    """Trees x nodes: a node's ratio of sums over all rows below it, or that of its nearest ancestor with enough rows of both kinds, or the overall effect."""
    whole = sums.copy()
    for node in range(whole.shape[1] - 1, 0, -1):
        whole[:, (node - 1) // 2] += whole[:, node]
    good = (whole[..., 1] >= trusted) & (whole[..., 2] >= trusted) & (whole[..., 4] > 0)
    value = np.where(good, whole[..., 3] / np.where(whole[..., 4] > 0, whole[..., 4], 1), np.nan)
    value[:, 0] = np.where(np.isnan(value[:, 0]), ate, value[:, 0])
    for node in range(1, whole.shape[1]):
        value[:, node] = np.where(np.isnan(value[:, node]), value[:, (node - 1) // 2], value[:, node])
    return value


def predict_forest(df: DataFrame, forest: CausalForest, alpha: float = 0.05) -> DataFrame:
    """Adds per arm but 0 cate_a, low_a and high_a (an approximate interval at level 1 - alpha), and kernel_a.

    The kernel effect weighs the training rows by how often they share a leaf with the row, leaf by leaf through the
    leaves' sums, so no pair of rows is ever written.
    """
    kept, at, z = list(df.columns), len(df.columns), NormalDist().inv_cdf(1 - alpha / 2)
    names = [f"{n}_{a}" for a in range(1, forest.arms) for n in ("cate", "low", "high", "kernel")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            out = forest.told(to_bins(_matrix(batch.column(at), len(forest.x)), forest.edges), z)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *[pa.array(c, pa.float64()) for c in out]], names=[*kept, *names])

    rows = df.withColumn("__x", F.array(*[F.col(c).cast("double") for c in forest.x]))
    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"{c} double" for c in names]]))
