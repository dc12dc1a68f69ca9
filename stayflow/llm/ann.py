"""Approximate nearest neighbours by multi-index hashing over rotated binary codes.

Norouzi, Punjani & Fleet, "Fast Exact Search in Hamming Space with Multi-Index Hashing" (PAMI 2014). Codes are split
into eight 8-bit substrings, each indexed. Codes within radius r of a query differ in at most r // 8 bits of some
substring, so probing each table at that radius retrieves them all; the codes found within r are reranked by the
original vectors. Candidates are dealt out evenly in blocks, whatever their values, each block with tables of its
own; the stated queries meet every block in blocks, and a block returns ``top`` rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .itq import Itq, coded, fit_itq, sample_vectors, unpack, valid_vectors

SUBSTRINGS = 8
CANDIDATE_BLOCK, QUERY_BLOCK = 32768, 8192
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
#: Hamming distance of any two bytes.
_BYTE_DISTANCE = _BYTE_ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class HammingTables:
    """The substring tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bytes = codes.view(np.uint8).reshape(-1, SUBSTRINGS)
        self.rows = [np.argsort(self.bytes[:, t], kind="stable") for t in range(SUBSTRINGS)]
        self.starts = [np.searchsorted(self.bytes[r, t], np.arange(257)) for t, r in enumerate(self.rows)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """The positions of all codes within ``radius`` bits of ``code``: a union of buckets, then a check of whole codes."""
        seen = np.zeros(len(self.codes), dtype=bool)
        for t, b in enumerate(code.reshape(1).view(np.uint8)):
            for value in np.flatnonzero(_BYTE_DISTANCE[b] <= radius // SUBSTRINGS):
                seen[self.rows[t][self.starts[t][value] : self.starts[t][value + 1]]] = True
            if seen.all():
                break
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]


def calibrate_radius(model: Itq, vectors: np.ndarray, top: int, recall: float, queries: int = 256) -> int:
    """The least radius that holds ``recall`` of the true neighbours of the first ``queries`` sample vectors in the sample.

    Neighbours in a sample lie farther away than those in the whole table, so the radius errs on the wide side.
    """
    n = len(vectors)
    if n < 2:
        return 64
    q = vectors[:queries]
    near = q @ vectors.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(top, n - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    codes = model.codes(vectors)
    return int(np.quantile(np.bitwise_count(codes[: len(q), None] ^ codes[best]), recall, method="higher"))


def _block_search(width: int, radius: int, top: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        is_query = block["query"].to_numpy(dtype=bool)
        q, c = block[is_query], block[~is_query].sort_values("id")
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        tables = HammingTables(c["code"].to_numpy(dtype=np.int64).view(np.uint64))
        vectors, ids = unpack(c["packed"].tolist(), width), c["id"].to_numpy(dtype=np.int64)
        out = []
        for query_id, code, v in zip(q["id"], q["code"].to_numpy(dtype=np.int64).view(np.uint64), unpack(q["packed"].tolist(), width), strict=True):
            at = tables.within(code, radius)
            at = at[ids[at] != query_id]
            if len(at) < top:  # fewer within the radius than asked for: the rest of the block competes too
                at = np.flatnonzero(ids != query_id)
            score = vectors[at] @ v
            if len(at) > top:
                cut = np.partition(score, len(score) - top)[len(score) - top]
                keep = score >= cut
                at, score = at[keep], score[keep]
            order = np.lexsort((ids[at], -score))[:top]
            out.append(pd.DataFrame({"query_id": np.int64(query_id), "vec_id": ids[at][order], "score": score[order]}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest(
    df: DataFrame, query, top: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = 8192, recall: float = 0.97, seed: int = 7,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row where the column ``query`` of the id holds, its ``top`` nearest by inner product.

    ``query`` maps the column ``id`` to a condition. Scores are inner products of the original vectors in double
    precision; ties go to the smaller id. The rotation and the radius are fitted on ``sample`` vectors at most (by
    ``recall`` of the neighbours there); every row is indexed. Where a block holds fewer than ``top`` codes within the
    radius, all of the block is ranked, so a query gets ``top`` rows whenever so many candidates exist. Null, zero and
    non-finite vectors, those of another width than most, and null ids take no part; rows that repeat an id count as
    one. An empty table gives an empty result; other columns are not read.
    """
    vectors = valid_vectors(df, key, vector)
    fitted = sample_vectors(vectors, sample)
    model, width = fit_itq(fitted, 64, seed=seed), fitted.shape[1]
    radius = calibrate_radius(model, fitted, top, recall)
    rows = written(coded(vectors, model, False))
    n = rows.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-rows.where(query(F.col("id"))).count() // QUERY_BLOCK))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("c", block(c_blocks, 1)).select("*", every(q_blocks).alias("q"), F.lit(False).alias("query"))
    queries = rows.where(query(F.col("id"))).withColumn("q", block(q_blocks, 2)).select("*", every(c_blocks).alias("c"), F.lit(True).alias("query"))
    found = candidates.unionByName(queries).groupBy("q", "c").applyInPandas(_block_search(width, radius, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
