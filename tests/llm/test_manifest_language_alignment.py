"""Operators 11 to 13 against brute force, held-out labels, and their edge cases."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stayflow.llm import alignment, language, manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, place long, tree long, chunk long, key string, hash long"
#: Clashing columns, nulls everywhere, ties of the key, repeated rows, empty and odd texts.
ODD = [
    (1, "A Plain Text.", "en", "s", 13, 1, 1, 1, 1, "k", 1), (1, "A Plain Text.", "en", "s", 13, 1, 1, 1, 1, "k", 1), (1, "Another", None, None, None, None, None, None, None, None, None),
    (None, "Text without id", "de", "s", 3, 0, 0, 0, 0, "", 0), (9007199254740993, None, "de", "s", 0, 0, 0, 0, 0, "", 0), (3, "", "", "s", 0, 0, 0, 0, 0, "", 0), (6, "12 34 !!", None, "ü", -5, 0, 0, 0, 0, "", 0),
    (12, "<s> </s> <|endoftext|> <unk>", "en", "", 1, 0, 0, 0, 0, "", 0), (15, "  two  spaces \n and\tmore ", "fr", "s", 2, 0, 0, 0, 0, "", 0), (18, "a▁b c", "fr", "s", 2, 0, 0, 0, 0, "", 0), (21, "日本語 テキスト é́ 😀😀", "fr", "s", 2, 0, 0, 0, 0, "", 0),
]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text=...):
    text = r["text"] if text is ... else text
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def climb(nodes, at):
    path = []
    while len(nodes) > 1:
        g = at // 8 * 8
        path.append((nodes[g:at], nodes[at + 1 : g + 8]))
        nodes, at = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], path


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    leaves = {x: [leaf(r) for r in trees[x]] for x in langs}
    subroots = [climb(leaves[x], 0)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        root, above = climb(subroots, k)
        for i, r in enumerate(trees[x]):
            path = climb(leaves[x], i)[1] + above
            d = leaves[x][i]
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                d = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                d = digest(*left, d, *right)
            out.append((r["doc_id"], leaves[x][i], subroots[k], root, digest(*[h for p in path for side in p for h in side]), d, d == root))
    return sorted(out, key=repr)


def same_manifest(df, levels=manifest.LEVELS):
    got = sorted(map(tuple, manifest.document_manifest(df, levels=levels).collect()), key=repr)
    assert got == brute_manifest([r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    return got


@given(st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_positions_are_those_of_completion(leaves):
    levels = manifest.depth(leaves)
    log = manifest.append_log([digest(str(k)) for k in range(leaves)], levels)
    nodes = [digest(str(k)) for k in range(leaves)]
    for level in range(levels + 1):
        assert [log[manifest.position(level, i, leaves, levels)] for i in range(len(nodes))] == nodes
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    assert len(log) == len(set(log)) or leaves == 1


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_brute_force(spark, sf, levels):
    # with small builders, trees of this size have several rounds
    got = same_manifest(spark.read.parquet(f"{sf}/documents.parquet"), levels)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_odd_rows(spark):
    got = same_manifest(spark.createDataFrame(ODD, DOCS))
    assert any(r[0] == 9007199254740993 for r in got)
    assert manifest.document_manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = manifest.document_manifest(spark.createDataFrame(ODD[:1], DOCS)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha256(b"").hexdigest()
    assert len(same_manifest(spark.createDataFrame([(k, "Same", str(k), "s", 4, *[None] * 6) for k in range(20)], DOCS))) == 20


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    of_a = Tokenizer.from_file(alignment.A_PATH)
    of_a.encode_special_tokens = True
    of_b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_PATH)
    letters = alignment.byte_letters()
    counts, docs = Counter(), []
    for key, text in rows:
        a = of_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = of_b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in of_a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(of_b.id_to_piece(i)[3:-1], 16)]) if of_b.is_byte(i) else of_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            docs.append((key, [], [], [], []))
            continue
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for e in shared:
            groups.append(tuple(",".join(str(i) for i, (s, t) in zip(ids, own) if low <= s and t <= e) for ids, own in ((a, spans[0]), (b, spans[1]))))
            low = e
        links = [(i, j) for i, (s, t) in zip(a, spans[0]) for j, (u, v) in zip(b, spans[1]) if s < v and u < t]
        counts.update(links)
        docs.append((key, a, b, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for key, a, b, groups, links in docs:
        text = ";".join("|".join(g) for g in groups)
        out.append((key, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def test_alignment_equals_brute_force(spark, sf):
    short = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    df = short.union(spark.createDataFrame(ODD, DOCS).select("doc_id", "text")).union(spark.createDataFrame([(77, "a" * 1400 + " b")], short.schema))
    got = sorted(map(tuple, alignment.align_documents(df).collect()), key=repr)
    assert got == brute_alignment([tuple(r) for r in df.collect()])
    assert alignment.align_documents(df.limit(0)).collect() == []


def test_parts_and_chunks_change_nothing(sf, monkeypatch):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist() if len(t) > 500][:30]
    aligner = alignment.Aligner(alignment.A_PATH, alignment.B_PATH)
    whole = [aligner.groups(t) for t in texts]
    monkeypatch.setattr(alignment, "PART", 200)
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    monkeypatch.setattr(alignment, "LONG", 3)
    aligner.forget()
    assert [aligner.groups(t) for t in texts] == whole


@given(st.text(alphabet=st.sampled_from(list("ab c'sé\n\t 1.▁日😀\x00\x1c  ")), max_size=60))
@settings(max_examples=200, deadline=None)
def test_units_encode_as_texts_do(text):
    aligner = alignment._aligner(alignment.A_PATH, alignment.B_PATH)
    groups = aligner.groups(text)
    a = aligner.a.whole.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode([text])[0]
    if groups:
        assert [i for g, _ in groups for i in g] == a and [i for _, g in groups for i in g] == b
    elif text:
        assert b"".join(aligner.b.tokens[i] for i in b) != (" " + text).encode()


@given(st.lists(st.integers(1, 5), min_size=1, max_size=80), st.lists(st.integers(1, 5), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_cuts_are_the_shared_ends(x, y):
    a, b = np.cumsum(x), np.cumsum(y)
    end = max(a[-1], b[-1])
    a, b = (np.append(v, end) if v[-1] < end else v for v in (a, b))
    got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
    assert a[got].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    codes, target = rng.integers(60, 200, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language.train(codes, target, ("a", "b", "c"), hidden=3, epochs=1, batch=5)
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    _, g = language._gradients(w, codes, target)
    for name in w:
        for at in [np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)]:
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            slope = (language._gradients(up, codes, target)[0] - language._gradients(down, codes, target)[0]) / 2e-3
            assert slope == pytest.approx(g[name][at], rel=0.02, abs=1e-4)


def test_long_texts_are_labelled_at_every_position_as_short_windows_are():
    rng = np.random.default_rng(2)
    net = language.train(rng.integers(60, 200, (20, 30)).astype(np.uint8), rng.integers(0, 2, 30), ("a", "b"), epochs=2)
    data = rng.integers(60, 200, 2000).astype(np.uint8)
    p, labels = net.label(data, np.array([700, 700, 2000]), positions=True)
    assert [len(x) for x in labels] == [700, 0, 1300] and p[1].tolist() == [0, 0]
    again, _ = net.label(data[700:], np.array([1300]))
    assert np.allclose(again[0], p[2], atol=1e-6)
    window = np.concatenate([np.zeros(16, np.uint8), data[:256]])[:, None]
    assert (net.positions(window)[:, 0].argmax(axis=1) == labels[0][:240]).all()


def test_languages_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = language.identify_languages(df).join(df, "doc_id").collect()
    assert len(got) == df.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    got = {(r.doc_id, r.lang_pred == "und", r.held_out) for r in language.identify_languages(df).collect()}
    assert {k for k, und, _ in got if und} == {9007199254740993, 3, 6}
    assert not any(h for k, _, h in got if k is None)
    assert language.identify_languages(df.limit(0)).collect() == []
    nothing = language.identify_languages(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    # a held-out row's text and language change nothing
    base = spark.createDataFrame([(k, t, g) for k in range(60) for t, g in [("the cat sat there", "en")] if k % 2] + [(k, "der Hund bellt laut", "de") for k in range(0, 60, 2)], "doc_id long, text string, lang string")
    turned = base.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    one, two = (language.fit_network(x, sample=64) for x in (base, turned))
    assert one.languages == two.languages and all((one.weights[k] == two.weights[k]).all() for k in one.weights)


def test_spans_of_a_text_in_two_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fit_network(df)
    en, de = (df.where(f"lang = '{x}' AND length(text) > 800 AND text NOT LIKE '%!!%'").orderBy("doc_id").first().text[:700] for x in ("en", "de"))
    row = language.predict_languages(spark.createDataFrame([(1, en + "\n" + de)], "doc_id long, text string"), net, spans=True).first()
    at = lambda k: next(s["lang"] for s in row.spans if s["first"] <= k < s["end"])
    assert sum(at(k) == "en" for k in range(50, 650)) > 500 and sum(at(k) == "de" for k in range(750, 1350)) > 500
