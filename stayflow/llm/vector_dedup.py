"""Near-duplicate vectors: iterative quantisation codes, multi-index Hamming tables, rerank with the original vectors.

Rows of one code form a cell. The radius within which cells are compared is measured on the fitted rotation: it holds
99 of 100 pairs that lie exactly at the threshold. Cells meet in tables of substrings, whose own radii add up to that
radius by the pigeonhole principle (at 15 bits and eight tables, one bit in each): a code is at home under its substring
and visits the substrings within the table's radius. The more codes, the wider the substrings, so that buckets stay
small as the tables grow. A pair of cells is taken in the first table where it meets only.
Members of cells are packed in chunks, and pairs of chunks are compared as matrices: what leaves a comparison is a
count per vector and a star per group linked there, never the pairs of a group. A hot cell is many chunks, whose
comparisons are dealt out over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, star_roots, written
from .itq import Itq, coded, fit_itq, sample_vectors, unit, unpack, valid_vectors

BITS = 64
#: Numbers of tables to choose from, and what a visit costs in comparisons of codes.
TABLES, VISIT = (8, 7, 6, 5, 4), 400
#: The radius where none is measured.
RADIUS = 15
CHUNK = 256
#: Codes at home in one group, and codes compared at once.
HOMES, TILE = 1 << 16, 2048


def link_radius(model: Itq, vectors: np.ndarray, threshold: float, recall: float = 0.99, seed: int = 7) -> int:
    """The least radius that holds ``recall`` of pairs at cosine ``threshold``: sample vectors (of length 1) turned by that angle.

    They turn in random directions and towards other sample vectors; the wider of both radii counts.
    """
    if len(vectors) < 2 or vectors.shape[1] < 2:
        return RADIUS
    rng = np.random.default_rng(seed)
    u = vectors[rng.integers(0, len(vectors), 8192)]
    cos = min(1.0, max(-1.0, threshold))
    radius = 0
    for aside in (rng.normal(size=u.shape), vectors[rng.integers(0, len(vectors), len(u))] - u):
        aside = aside - (aside * u).sum(axis=1, keepdims=True) * u
        length = np.linalg.norm(aside, axis=1, keepdims=True)
        some = length[:, 0] > 1e-9
        if some.any():
            turned = cos * u[some] + np.sqrt(1 - cos * cos) * aside[some] / length[some]
            radius = max(radius, int(np.quantile(np.bitwise_count(model.codes(u[some]) ^ model.codes(turned)), recall, method="higher")))
    return radius


def _tables(radius: int, tables: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, own radius) of each table; codes within ``radius`` bits are within the own radius in some table. One of radius -1 is not needed."""
    edges = [BITS * t // tables for t in range(tables + 1)]
    return [(edges[t], edges[t + 1] - edges[t], (radius + 1) // tables + (t < (radius + 1) % tables) - 1) for t in range(tables)]


def _near_values(bits: int, radius: int) -> list[int]:
    """All differences of ``radius`` bits or fewer in a substring."""
    return [sum(1 << b for b in chosen) for k in range(min(radius, bits) + 1) for chosen in combinations(range(bits), k)]


def choose_tables(codes: int, radius: int) -> int:
    """The number of tables at which visits and comparisons cost least for so many codes."""

    def cost(tables: int) -> float:
        own = [(bits, sum(comb(bits, k) for k in range(r + 1))) for _, bits, r in _tables(radius, tables) if r >= 0]
        return sum(near * (VISIT + codes / 2**bits) for bits, near in own)

    return min(TABLES, key=cost)


def _cell_pairs(cells: DataFrame, radius: int = RADIUS, tables: int = 8) -> DataFrame:
    """Pairs (a, b) of different codes, a < b, within ``radius`` bits; each pair once."""
    every = _tables(radius, tables)
    used = [t for t in range(tables) if every[t][2] >= 0]
    sub = lambda t: f"int(shiftrightunsigned(code, {every[t][0]}) & {(1 << every[t][1]) - 1})"
    masks = lambda t: ", ".join(map(str, _near_values(every[t][1], every[t][2])))
    homes = cells.selectExpr("code", "inline(array(" + ", ".join(f"struct({t} AS t, {sub(t)} AS value)" for t in used) + "))")
    visits = cells.selectExpr("code", "inline(array(" + ", ".join(f"struct({t} AS t, transform(array({masks(t)}), m -> {sub(t)} ^ m) AS near)" for t in used) + "))")
    visits = visits.select("code", "t", F.explode("near").alias("value"))
    # one row per table and value; a value where many codes are at home is several groups
    parts = F.broadcast(homes.groupBy("t", "value").agg(F.ceil(F.count("*") / HOMES).cast("int").alias("parts")))
    homes = homes.join(parts, ["t", "value"]).select("t", "value", F.pmod(F.xxhash64("code"), "parts").cast("int").alias("part"), "code", F.lit(True).alias("home"))
    visits = visits.join(parts, ["t", "value"]).select("t", "value", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "code", F.lit(False).alias("home"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        code, home = whole.column("code").to_numpy(), whole.column("home").to_numpy()
        table = whole.column("t")[0].as_py()
        own, other = code[home], code[~home]
        for i in range(0, len(own), TILE):
            for j in range(0, len(other), TILE):
                a, b = own[i : i + TILE], other[j : j + TILE]
                at, to = np.nonzero(np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= radius)
                a, b = a[at], b[to]
                differ, take = a.view(np.uint64) ^ b.view(np.uint64), a < b
                for first, bits, own_radius in every[:table]:
                    if own_radius >= 0:
                        take &= np.bitwise_count((differ >> np.uint64(first)) & np.uint64((1 << bits) - 1)) > own_radius
                if take.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[take]), pa.array(b[take])], names=["a", "b"])

    return homes.union(visits).groupBy("t", "value", "part").applyInArrow(run, "a long, b long")


def _compare(width: int, threshold: float):
    """Pairs of chunks to (id, links, root): links found there and the smallest id linked with it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links, roots = [], [], []
            for same, ids_a, ids_b, pack_a, pack_b in zip(*(batch.column(c).to_pylist() for c in ("same", "ids_a", "ids_b", "packed_a", "packed_b")), strict=True):
                a, b = unit(unpack(pack_a, width)), unit(unpack(pack_b, width))
                linked = a @ b.T >= threshold
                names_a, names_b = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                root_a, root_b = star_roots(linked, names_a, names_b, same)
                for names, n, root in ((names_a, linked.sum(axis=1), root_a), (names_b, linked.sum(axis=0), root_b))[: 1 if same else 2]:
                    some = np.flatnonzero(n)
                    ids.append(names[some])
                    links.append(n[some])
                    roots.append(root[some])
            join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([join(ids), join(links), join(roots)], names=["id", "links", "root"])

    return run


def near_vectors(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", sample: int = 8192, seed: int = 7) -> DataFrame:
    """One row per row of ``df``: key, n_links, component_id, kept.

    Vectors link at cosine ``threshold`` or more, in double precision, as far as their codes lie within the radius
    that holds 0.99 of pairs at the threshold (``link_radius``; the README gives the recall measured); no pair below the
    threshold links. The rotation and the radius are fitted on ``sample`` vectors at most; all rows are indexed. Null, zero and non-finite vectors, those of
    another width than most, and null ids link with nothing; such rows are their own component. Of rows with one id,
    one vector counts and all get its result. An empty table gives an empty result; other columns are not read.
    """
    vectors = valid_vectors(df, key, vector)
    fitted = sample_vectors(vectors, sample)
    fitted = unit(fitted) if len(fitted) else fitted
    model, width = fit_itq(fitted, 64, seed=seed), fitted.shape[1]
    radius = link_radius(model, fitted, threshold, seed=seed)
    rows = written(coded(vectors, model, True))
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))
    cells = written(counts)
    parts = F.ceil(F.col("n") / CHUNK)
    chunks = written(
        rows.join(cells, "code").withColumn("chunk", F.pmod(F.xxhash64("id"), parts))
        .groupBy("code", "chunk").agg(F.collect_list(F.struct("id", "packed")).alias("m"))
        .select("code", "chunk", F.col("m.id").alias("ids"), F.col("m.packed").alias("packed"))
    )
    between = _cell_pairs(cells, radius, choose_tables(cells.count(), radius))
    within = cells.where("n > 1").select(F.col("code").alias("a"), F.col("code").alias("b"))
    one, two = (chunks.select(F.col("code").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("chunk", "ids", "packed"))) for x in "ab")
    pairs = between.union(within).join(one, "a").join(two, "b").where("a < b OR chunk_a <= chunk_b")
    pairs = pairs.select((F.expr("a = b AND chunk_a = chunk_b")).alias("same"), "ids_a", "ids_b", "packed_a", "packed_b")
    found = written(pairs.mapInArrow(_compare(width, threshold), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    components = connected_components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")))
    ids = df.select(df[key].alias(key), df[key].cast("long").alias("id"))
    joined = ids.join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return joined.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
