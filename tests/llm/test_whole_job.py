"""Cases in which an operator once did less than its whole job."""

import math
import random

import numpy as np
import pytest

from stayflow.llm import pieces, vector_dedup, warc


def test_one_task_writes_several_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 10)
    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", rng.randbytes(6000).hex()) for i in range(600)] + [(1000 + i, "again", None) for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    listing = warc.write_warc(df, f"file://{tmp_path}/a")
    assert listing.count() > 1 and listing.groupBy().sum("records").first()[0] == len(pages)
    back = warc.read_warc(spark, f"file://{tmp_path}/a", listing).collect()
    stored = {r.page_id: r.payload for r in back if r.record_type == "response"}
    assert sorted(r.page_id for r in back) == [p[0] for p in pages]
    assert all((stored[r.page_id if r.refers_to is None else r.refers_to] or "") == (p[2] or "") for r, p in zip(sorted(back), pages, strict=True))


def test_expected_counts_equal_all_paths():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "▁ab", "ba"]
    kinds = [2, *[6] * 256, *[1] * 7]
    scores = np.array([0.0] * 257 + [-1.0, -2.0, -2.5, -3.0, -1.5, -4.0, -2.2])
    v = pieces.Vocabulary(names, scores.tolist(), kinds)
    units, weights = ["▁abab", "▁", "▁bé", "a"], [2, 1, 3, 5]

    def paths(s):
        if not s:
            yield 0.0, []
        for n in range(1, len(s) + 1):
            k = names.index(s[:n]) if s[:n] in names else None
            if k is not None or n == 1 and s[0] == "é":
                for cost, own in paths(s[n:]):
                    yield cost + (scores[k] if k is not None else -14.0), [k, *own]

    want, likelihood = np.zeros(len(names)), 0.0
    for u, w in zip(units, weights, strict=True):
        every = list(paths(u))
        whole = sum(math.exp(c) for c, _ in every)
        likelihood += w * math.log(whole)
        for c, own in every:
            for k in own:
                want[k if k is not None else 0] += w * math.exp(c) / whole
    want[0] = 0
    found, value = pieces.expected_counts([u.encode() for u in units], np.array(weights, float), v, scores, -14.0)
    assert found == pytest.approx(want) and value == pytest.approx(likelihood)


def test_scores_are_fitted_log_probabilities(spark, tmp_path):
    df = spark.createDataFrame([(i, "therefore the house needs information, and information needs a house" if i % 9 else None) for i in range(40)], "doc_id long, text string")
    row = pieces.encode_pieces(df, keep=f"file://{tmp_path}/v").where("doc_id = 1").first()
    v = pieces.read_vocabulary(spark, f"file://{tmp_path}/v")
    assert {"▁therefore", "▁house", "▁information"} <= {v.pieces[i] for i in row.ids} and row.exact
    assert sum(math.exp(s) for s, k in zip(v.scores, v.kinds, strict=True) if k == pieces.NORMAL) == pytest.approx(1, abs=1e-3)
    assert pieces.Encoder(v).encode([df.where("doc_id = 1").first().text])[0].tolist() == row.ids


def test_links_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(4)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.93, (len(u), 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([u, cos * u + np.sqrt(1 - cos * cos) * w]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.9).sum() - len(rows)
    recall = sum(r.n_links for r in got.values()) / linked
    print("recall at 0.90 to 0.93:", recall, "of", linked // 2)
    assert linked >= 2 * len(u) and 0.985 <= recall <= 1


def test_cell_pairs_at_other_radii(spark):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(30)}
    for c in list(codes):
        codes |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 18))) for _ in range(6)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    assert vector_dedup.choose_tables(10**9, 15) < vector_dedup.choose_tables(1000, 15)
    for radius, tables in ((0, 8), (5, 8), (16, 5), (15, 7)):
        got = [(r.a, r.b) for r in vector_dedup._cell_pairs(df, radius, tables).collect()]
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_sample_of_vectors_is_the_lowest_hashes_of_any_table(spark):
    from pyspark.sql import functions as F

    from stayflow.llm import itq

    df = spark.range(3000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert itq.sample_vectors(df, 100)[:, 0].tolist() == want  # below a bound
    assert itq.sample_vectors(df.where("id < 150"), 100).shape == (100, 2) and itq.sample_vectors(df.limit(0), 100).shape == (0, 1)
    assert itq._below(0.0) == -(2**63) and itq._below(1.0) == 2**63 - 1
