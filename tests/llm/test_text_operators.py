"""License scan, sharding, mixing, SentencePiece and page text against brute force and on odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest

from stayflow.llm import licenses, mixing, ngram_join, page_text, pieces, quality, sharding
from stayflow.llm import queries as q

ODD = [
    (1, "Released under the MIT License. MIT license", "a"), (2, None, "b"), (3, "", None), (3, "", None),
    (None, "mit LICENSE", "a"), (5, "x " * 50_000 + "GNU General Public License", "a"), (6, "é MIT License mit-license", "c"),
]
SCHEMA = "doc_id long, text string, source string, key string, n long, rank int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 7, 1) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), found


def check_scan(rows, texts):
    for r in rows:
        n, found = brute_places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert 0 <= r.score <= 1


def test_scan_equals_brute_force(spark, sf, odd, empty):
    check_scan(q.op1_license_scan(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == len(ODD)
    check_scan(rows, {r[0]: r[1] for r in ODD})
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("expression", "answer"),
    [("MIT", True), ("GPL-3.0-only", False), ("MIT OR GPL-2.0", True), ("MIT AND GPL-2.0", False), ("(MIT OR GPL-2.0) AND Apache-2.0", True),
     ("GPL-2.0 WITH Classpath-exception-2.0 OR ISC", True), ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("", None), ("MIT GPL", None)],
)
def test_expressions(expression, answer):
    assert licenses.allows(expression) is answer


def test_tags(spark):
    df = spark.createDataFrame([(1, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC */ more"), (2, "spdx-license-identifier: GPL-2.0+ and the rest")], "doc_id long, text string")
    a, b = licenses.scan_licenses(df).orderBy("doc_id").collect()
    assert (a.expression, a.allowed, a.score) == ("(MIT OR GPL-2.0-only) AND ISC", True, 1.0)
    assert "spdx:gpl-2.0-only" in a.labels
    assert b.allowed is False


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, 5, invert=True) == np.arange(n)).all()
    assert (sharding.permute(np.arange(1000), 1000, 5) != sharding.permute(np.arange(1000), 1000, 6)).any()


def check_shards(rows, docs, shards):
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == want


def test_shards(spark, sf, odd, empty):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = q.op2_feistel_shards(spark, sf).collect()
    check_shards(rows, docs, 40)
    again = sharding.assign_shards(spark.read.parquet(f"{sf}/documents.parquet").repartition(7), 40, partitions=3).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    check_shards(sharding.assign_shards(odd, 3).collect(), [(r[0], r[1]) for r in ODD], 3)
    assert sharding.assign_shards(empty, 4).count() == 0


def test_written_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard", "slot").distinct().count() == docs.count()


def water_fill(sizes, weights, cap):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            open_.remove(i)
    return target


def test_mix(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = q.op6_source_mix(spark, sf).collect()
    sizes = {}
    texts = {r.doc_id: r for r in docs.collect()}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    names = sorted(sizes)
    target = dict(zip(names, water_fill([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))], 3), strict=True))
    for s in names:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
    assert sorted(rows) == sorted(q.op6_source_mix(spark, sf).collect())
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.repeat_rows(empty).columns == empty.columns


def test_mix_caps_small_sources(spark):
    df = spark.createDataFrame([(i, "w " * (1000 if i % 10 else 1), "big" if i % 10 else f"s{i % 30}") for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, (1, 2, 3), 3).select("source", "source_size", "target").distinct().orderBy("source").collect()
    want = water_fill([r.source_size for r in rows], [1, 2, 3, 1][: len(rows)], 3)
    assert [r.target for r in rows] == pytest.approx(want)
    repeated = mixing.repeat_rows(df)
    assert repeated.columns == df.columns
    taken = {r.source: r["sum(taken)"] for r in mixing.mix_sources(df).groupBy("source").sum("taken").collect()}
    got = {}
    for r in repeated.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {k: v for k, v in taken.items() if v}


def viterbi(text, v):
    """Best path over all pieces, character by character."""
    index = {p: (s, i) for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds, strict=True)) if k in (1, 4)}
    s = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [(0.0, None)] + [(-1e300, None)] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 64), j):
            own = index.get(s[i:j])
            c = own[0] if own else v.unknown_score if j - i == 1 else None
            if c is not None and best[i][0] + c > best[j][0]:
                best[j] = (best[i][0] + c, i)
    out, j = [], len(s)
    while j:
        i = best[j][1]
        out = ([index[s[i:j]][1]] if s[i:j] in index else [int(v.byte_ids[b]) for b in s[i:j].encode()]) + out
        j = i
    return out


def test_pieces(spark, sf, odd, empty):
    v = pieces.load()
    encoder = pieces.Encoder(v)
    texts = ["", " ", "  a  b ", "hello world", "漢字 é", "\n\n\tx  ", "a" * 300, "🙂🙂 ok", "\x00\x01 nul"]
    texts += [r.text[:200] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert pieces.decode(ids, v) == t
        assert not t or ids.tolist() == viterbi(t, v)
    for t in ("▁", "a▁ ▁b", " ▁▁ "):
        assert pieces.decode(encoder.encode([t])[0], v) == t
    rows = q.op8_piece_encoding(spark, sf).collect()
    assert all(r.exact and r.n_pieces == len(r.ids) for r in rows)
    rows = {r.doc_id: r for r in pieces.encode_pieces(odd).collect()}
    assert rows[2].n_pieces == 0 and rows[3].ids == [] and rows[5].exact
    assert pieces.encode_pieces(empty).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(odd)).collect()
    assert {r.doc_id: r.text for r in back} == {r[0]: r[1] or "" for r in ODD}


def test_double_array():
    rng = random.Random(3)
    keys = list({bytes(rng.choices(range(256), k=rng.randint(1, 5))) for _ in range(3000)})
    base, check, value = pieces.double_array([(k, i) for i, k in enumerate(keys)])
    index = {k: i for i, k in enumerate(keys)}
    for word in [*keys, *(bytes(rng.choices(range(256), k=3)) for _ in range(3000))]:
        s = 0
        for c in word:
            t = base[s] + c + 1
            if check[t] != s:
                s = None
                break
            s = t
        assert (value[s] if s is not None else -1) == index.get(word, -1)


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Top line.</header>
<nav><ul><li><a href=1>One</a></ul></nav><div class="cookie-notice">We use cookies, all of them.</div><div id=content><h1>A &amp; B</h1>
<p>First  text, with&nbsp;words.<br>More of it; yes.<form><p>Name, please.</p></form><p><b>Second</b> text, here.
<!-- <p>no</p> --><p>Third.</div><div class="sidebar"><p>Side text, long enough to count. Yes it is.</p></div>
<div class="comments"><p>Great post, mate. I love it, a lot.</p></div><footer>&copy; us</footer>"""


def test_page_text(spark, sf):
    assert page_text.main_text(PAGE) == "A & B\nFirst text, with words. More of it; yes.\nSecond text, here.\nThird."
    assert page_text.main_text(None) == page_text.main_text("") == page_text.main_text("<p></p>") == ""
    assert page_text.main_text("only text") == "only text"
    assert page_text.main_text("<p>cut<b") == "cut"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q.op7_page_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        import html

        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x " * 30000, 1)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in page_text.extract_text(odd).collect())[0] == 0
    assert page_text.extract_text(odd.limit(0)).count() == 0


def test_quality(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score_documents(docs).join(labels, "doc_id").collect()  # labels take no part in the fit
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    rows = quality.score_documents(odd).collect()
    assert len(rows) == len(ODD) and all(not r.kept and r.score == 0 for r in rows if r.n_words == 0)
    assert quality.score_documents(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.95


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.9])
    cast = np.where(rng.random((20000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random(cast.shape) < 0.2] = -1
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.03
    assert np.abs(model.right_good - right).max() < 0.03 and np.abs(model.right_bad - right).max() < 0.03
