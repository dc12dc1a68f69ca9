"""N-gram join, vector dedup, nearest neighbours, WARC and the pipeline against brute force and on odd inputs."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stayflow.llm import ann, common, itq, ngram_join, vector_dedup, warc
from stayflow.llm import queries as q


def sets_of(docs, words):
    out = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)})
    return out


def components(n, links, names):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i in range(n):
        if names[i] is not None:
            least[find(i)] = min(names[i], least.get(find(i), names[i]))
    return [least.get(find(i)) for i in range(n)]


def brute_join(docs, words, num):
    sets = sets_of(docs, words)
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    links = []
    for i, s in enumerate(sets):
        for j, m in Counter(j for x in s for j in index[x] if j > i).items():
            if 100 * m >= num * (len(s) + len(sets[j]) - m):
                links.append((i, j))
    return sets, components(len(docs), links, [d for d, _ in docs])


def check_join(df, words, num):
    docs = [(r.doc_id, r.text) for r in df.collect()]
    sets, want = brute_join(docs, words, num)
    got = ngram_join.ngram_join(df, words, num, 100).collect()
    pairs = lambda x: sorted(x, key=lambda t: tuple((v is None, v) for v in t))
    assert pairs([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == pairs([(d, len(s), c) for (d, _), s, c in zip(docs, sets, want, strict=True)])


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(rng.randint(20, 400))]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield " ".join(copy)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, sf, words, num):
    check_join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), words, num)
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [t for k in range(12) for t in family(rng, vocabulary, rng.choice([2, 3, 9, 30]), rng.choice([1, 4, 9]))]
    # a passage that many share, short texts, repeats and borderline cases
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))) for _ in range(60)]
    texts += ["a b", "a b", "A b", "c", "", None, " \t ", "a b c", *texts[:5], " ".join(vocabulary * 5)]
    texts += [" ".join(vocabulary[:k]) for k in range(1, 60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(None if i == 3 else i, t, "x") for i, t in zip(ids, texts, strict=True)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(5), words, num)


def test_join_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n long")
    assert ngram_join.ngram_join(empty).count() == 0
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "a b c d e f", "y"), (3, "other words are here now", "z"), (3, "other words are here now", "z"), (4, None, ""), (5, "", ""), (None, "q r s t u", "n"), (6, "a b c d e G", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "q r s t u"), (1, "a b c d e f"), (3, "other words are here now"), (4, ""), (5, ""), (6, "a b c d e G")]


def test_signatures_meet():
    rng = np.random.default_rng(5)
    for num, sizes in ((90, (3, 10, 19, 57, 400)), (80, (4, 5, 9, 33, 250))):
        for size in sizes:
            for _ in range(60):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                b = a.copy()
                while True:
                    c = b[rng.random(len(b)) > 1 / len(b)] if rng.random() < 0.5 else np.append(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                    c = np.unique(c)
                    both = len(np.intersect1d(a, c))
                    if 100 * both < num * (len(a) + len(c) - both):
                        break
                    b = c
                assert np.intersect1d(ngram_join.signatures(a, num, 100), ngram_join.signatures(b, num, 100)).size


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 900), rng.randint(300, 900)) for _ in range(400)] + [(5, 5), (None, 3), (1000, 999), (1000, 999)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = components(1001, [e for e in edges if None not in e], list(range(1001)))
    assert got == {n: want[n] for e in edges if None not in e for n in e if True} or all(got[n] == want[n] for n in got)
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(spark, extra=True):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 64))
    near = np.repeat(base[:1], 300, axis=0) + rng.normal(size=(300, 64)) * 0.03
    pairs = base[1:60] + rng.normal(size=(59, 64)) * 0.12
    x = np.concatenate([base, near, pairs, base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if extra:
        rows += [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [float("inf")] + [1.0] * 63), (1004, [1.0, 2.0]), (1005, [None] + [1.0] * 63), (None, [1.0] * 64), (1006, [1e30] * 64), (7, x[7].tolist())]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, component_id string, rank int")


def test_vector_dedup_equals_brute_force(spark):
    rows, df = vectors(spark)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df).collect()}
    good = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.array([good[i] / np.abs(good[i]).max() for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    want = components(len(ids), np.argwhere(linked), ids)
    total = sum(got[i].n_links for i in ids)
    assert total >= 0.97 * linked.sum() and all(got[i].n_links <= linked[k].sum() for k, i in enumerate(ids))
    assert np.mean([got[i].component_id == c for i, c in zip(ids, want, strict=True)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values() if r.vec_id is not None)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1006))
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_cell_pairs_are_all_pairs_in_radius(spark):
    rng = random.Random(8)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes):
        for _ in range(6):
            d = c
            for b in rng.sample(range(64), rng.randint(0, 13)):
                d ^= 1 << b
            codes.add(d)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    got = [(r.a, r.b) for r in vector_dedup._cell_pairs(spark.createDataFrame([(c,) for c in signed], "code long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= vector_dedup.RADIUS}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    found = defaultdict(list)
    for r in q.op3_hamming_search(spark, "/root/testdata/sf0.01").collect():
        found[r.query_id].append(r)
        assert r.score == pytest.approx(float(rows[r.query_id] @ rows[r.vec_id]), abs=1e-12)
    hits = 0
    for i in (i for i in ids if i % 20 == 0):
        own = sorted(found[i], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(own, own[1:], strict=False))
        score = x @ rows[i]
        score[ids.index(i)] = -np.inf
        hits += len({ids[k] for k in np.argsort(-score)[:20]} & {r.vec_id for r in own})
    assert hits / (20 * len(found)) >= 0.9


def test_nearest_odd(spark):
    _, df = vectors(spark)
    rows = ann.nearest(df, lambda i: i % 20 == 0, 5).collect()
    assert {r.query_id for r in rows} == {i for i in range(0, 512, 20)} and not {r.vec_id for r in rows} & set(range(1000, 1006))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, lambda i: i % 20 == 0, 20).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_tables_hold_all_codes_in_radius():
    codes = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    tables = ann.HammingTables(codes)
    for c in codes[:20]:
        for r in (0, 7, 20, 28):
            assert tables.within(c, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ c) <= r).tolist()


def test_rotation_is_orthogonal():
    model = itq.fit_itq(np.random.default_rng(0).normal(size=(500, 16)), 16)
    assert np.allclose(model.rotation.T @ model.rotation, np.eye(16))


def test_archives(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    copies = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000", "url", "html")
    odd = spark.createDataFrame([(5000, None, None), (5001, "a\nb: c", ""), (None, "x", ""), (5002, "é", "x" * 3_000_000), (5003, "d", "same"), (5003, "d", "same")], "page_id long, url string, html string")
    df = pages.union(copies).union(odd).withColumnRenamed("url", "url")
    folder = warc.archive_folder(spark)
    listing = warc.write_warc(df, folder)
    rows = warc.read_warc(spark, folder, listing).collect()
    source = Counter((r.page_id, r.url, r.html or "") for r in df.collect())
    assert len(rows) == df.count() == listing.agg({"records": "sum"}).first()[0]
    first = {}
    for (i, _, h), _n in source.items():
        if i is not None:
            first[h] = min(i, first.get(h, i))
    html = {(i, u): h for i, u, h in source}
    for r in rows:
        h = html[r.page_id, r.url]
        assert r.payload_bytes == len(h.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if r.page_id == first[h]:
            assert r.record_type == "response" and r.refers_to is None and r.payload == h
        else:
            assert r.record_type == "revisit" and r.refers_to == first[h] and r.payload is None
    assert warc.write_warc(df.limit(0), warc.archive_folder(spark)).count() == 0
    got = {r.page_id: r for r in q.op5_warc_archives(spark, sf).collect()}
    assert len(got) == pages.count()


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    rows = warc.read_warc(spark, folder, warc.write_warc(df, folder, least=5)).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in rows} == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_pipeline(spark, sf):
    import corpus_pipeline as cp
    from stayflow.llm import pieces, quality, stages

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages.quality(spark, docs, sf)
    scores = {r.doc_id: r.kept for r in quality.score_documents(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows)
    one = stages.near_duplicates(spark, common.written(kept), sf)
    _, component = brute_join(rows, 5, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for (d, t), c in zip(rows, component, strict=True) if d == c)
    out = cp.run(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    v = pieces.load()
    counts = Counter()
    for r in out.collect():
        counts[r.doc_id] += 1
        assert pieces.decode(np.array(r.ids), v) == texts[r.doc_id]
    from stayflow.llm.mixing import mix_sources

    want = {r.doc_id: r.repeats for r in mix_sources(common.written(one)).collect() if r.repeats}
    assert counts == want
