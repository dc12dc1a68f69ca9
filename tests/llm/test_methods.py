"""The methods themselves: path scores decide the text of a page, label models, sketches, licence expressions and WARC fields."""

import html
import itertools
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from stayflow.llm import licenses, ngram_join, page_text, quality, warc


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages():
    return [r for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist() if r]


def test_pages_give_their_articles(pages):
    assert all(page_text.main_text(p) == article(p) for p in pages)
    bare = [re.sub(r' class="[^"]*"', "", p).replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert np.mean([page_text.main_text(b) == article(p) for b, p in zip(bare, pages, strict=True)]) > 0.9


def test_scores_decide(pages, monkeypatch):
    real, rng = page_text.path_scores, np.random.default_rng(1)
    monkeypatch.setattr(page_text, "path_scores", lambda p: tuple(x[rng.permutation(len(x))] for x in real(p)))
    assert np.mean([page_text.main_text(p) != article(p) for p in pages[:200]]) > 0.5


@pytest.mark.parametrize("start", ['<div class="menu-open">', '<div class="header-fixed">', "<form>", '<div class="layout sidebar">', '<div title="the hidden cost of x">', "<div hidden>"])
def test_marks_on_wrappers_change_nothing(pages, start):
    end = f"</{re.match('<([a-z]+)', start)[1]}>"
    for p in pages[:20]:
        assert page_text.main_text(p.replace("<body>", f"<body>{start}").replace("</body>", f"{end}</body>")) == article(p)


def test_own_header_stays_and_marked_leaves_go(pages):
    p = pages[0].replace("<article><h1>", "<article><header><h1>").replace("</h1>", "</h1></header>", 1)
    for leaf in ('<p class="notice">A notice, here.</p>', '<p class="advert">Buy this. Now, please.</p>', '<ul><li class="comment">I, too, think so.</li></ul>'):
        assert page_text.main_text(p.replace("</article>", leaf + "</article>", 1)) == article(pages[0])
    assert page_text.main_text(p.replace("</article>", '<p class="lead">A lead, here.</p></article>', 1)) == article(pages[0]) + "\nA lead, here."


@pytest.mark.parametrize("page", [
    "<body><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav></body>", "<form><label>Name</label><input></form>", "<footer>All rights, reserved. 2020.</footer>",
    '<div id="comments"><article class="comment"><p>A comment, at length. It says much, and more.</p></article></div>', '<div class="cookie-notice">We use cookies, as all do. Accept.</div>', "<script>x</script>", "",
])
def test_pages_without_text_of_their_own(page):
    assert page_text.main_text(page) == ""


@pytest.mark.parametrize("part", ["<b><h4>x", "<b><pre>x", "<i><dt></dt>", "<b></i><h2>y", "<td><b><td>", "<li><div><b><li>z"])
def test_broken_pages_take_linear_time(part):
    began = time.process_time()
    page_text.read_page("<dt><div>" + part * 100_000)
    assert time.process_time() - began < 10


def test_deep_nesting():
    assert page_text.main_text("<div>x, y. " * 100_000) == "\n".join(["x, y."] * 100_000)
    assert page_text.main_text("<b>" * 50_000 + "text" + "</i>" * 50_000) == "text"


def test_label_model_finds_the_largest_posterior():
    """On tables of two kinds and three labellers no random model and no small step beats the one found."""
    rng = np.random.default_rng(3)
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=2)))
    counts = rng.integers(1, 60, len(patterns)).astype(float)
    counts[(patterns == 0).any(axis=1)] /= 6

    def value(model):
        _, logs = model.shares_of(patterns)
        return counts @ logs + np.log(model.shares).sum() + np.log(model.rates).sum()

    model = quality._fit_kinds(patterns, counts, 2, 20_000)
    found = value(model)
    for _ in range(3000):
        steps = [np.exp(rng.normal(0, 0.02, x.shape)) for x in (model.shares, model.rates)]
        shares, rates = model.shares * steps[0], model.rates * steps[1]
        near = quality.LabelModel(shares / shares.sum(), rates / rates.sum(axis=2, keepdims=True))
        assert value(near) <= found + 1e-6


def test_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n in (1, 5, 64, 65, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for share in (0.0, 0.1, 0.5):
            b = np.unique(np.concatenate([a[rng.random(len(a)) >= share], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert ngram_join.differing(ngram_join.parities(a), ngram_join.parities(b)) <= apart
            wide = [np.frombuffer(ngram_join.parities(x), np.uint8) for x in (a, b)]
            assert ngram_join.differing(*(ngram_join.folded(x, 8).tobytes() for x in wide)) <= apart
    assert ngram_join.differing(ngram_join.parities(a), ngram_join.parities(a)) == 0
    assert ngram_join.signature_bound(0, 80, 100) == 0
    for n in (1, 10, 31, 32, 500):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert len(ngram_join.signatures(a, 80, 100)) <= ngram_join.signature_bound(len(a), 80, 100)


@pytest.mark.parametrize(("expression", "answer"), [("MIT @ OR GPL-2.0", None), ("(MIT OR GPL-3.0) WITH x", None), ("MIT WITH x WITH y", None), ("MIT AND MIT WITH x", True)])
def test_strict_expressions(expression, answer):
    assert licenses.allows(expression) is answer


def test_unreadable_tag_allows_nothing():
    automaton = licenses._automaton({"mit license": ("base", "mit")})
    tags = licenses.ahocorasick.Automaton()
    tags.add_word(licenses.TAG, True)
    tags.make_automaton()
    row = licenses.scan_text("SPDX-License-Identifier: MIT WITH some-exception\nSPDX-License-Identifier: (", automaton, tags)
    assert row[5] == "spdx:mit" and row[-1] is False


def test_warc_fields():
    raw = warc.record(7, "http://x/a b?c=%20#d", b"hello", 3, "D", "http://y/z", "<urn:uuid:1>").decode()
    for field in ("WARC-Target-URI: http://x/a%20b?c=%20#d", "WARC-Refers-To-Target-URI: http://y/z", "WARC-Block-Digest: sha1:", "WARC-Record-ID: <urn:uuid:1>"):
        assert field in raw
    back = warc.parse(raw.encode())
    assert (back["page_id"], back["url"], back["refers_to"], back["record_type"], back["payload_bytes"]) == (7, "http://x/a b?c=%20#d", 3, "revisit", 5)
    assert warc.info("a.warc.zst").startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_statistics_by_blocks_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab c.\n|é#A  "), 700)) for _ in range(20)] + ["word " * 200, "x", " \n", "tail #"]
    whole = [quality.statistics(t, True) for t in texts]
    monkeypatch.setattr(quality, "BLOCK", 37)
    for t, w in zip(texts, whole, strict=True):
        got = quality.statistics(t, True)
        assert (got is None) == (w is None) and (w is None or (np.allclose(got[0], w[0]) and np.allclose(got[1], w[1])))
    words = texts[0].split()
    s = whole[0][0]
    assert s[-1] == len(words) and s[3] == sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1) and s[5] == sum("#" in w or "|" in w for w in words) / len(words)
    runs = [words[k : k + 64] for k in [*range(0, len(words) - 64, 64), len(words) - 64]] if len(words) > 64 else [words]
    assert s[4] == pytest.approx(np.mean([len(set(r)) / len(r) for r in runs]))


def test_a_text_of_200_mb_takes_little_memory():
    """In a process of its own: the peak stays within 2 GB, of which the text itself and its bytes are 0.4."""
    code = "import resource\nfrom stayflow.llm import quality\nt = 'Some words of prose, and more. ' * 6_500_000\nassert quality.statistics(t, True)[0][-1] == 39_000_000\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 2_000_000


@pytest.mark.parametrize("value, allowed", [("MIT", True), ("MIT AND /*x*/ GPL-3.0-only", False), ("MIT @ OR GPL-2.0", False), ("MIT AND", False), ("MIT */", True), ("(MIT OR GPL-2.0) -->", True), ("", False), ("MIT and more prose", False)])
def test_tag_values_are_parsed_whole(value, allowed):
    automaton = licenses._automaton({p: ("base", v) for p, v in licenses.BASE_PHRASES.items()})
    tags = licenses.ahocorasick.Automaton()
    tags.add_word(licenses.TAG, True)
    tags.make_automaton()
    row = licenses.scan_text(f"/* SPDX-License-Identifier: {value}\nGPL-2.0", automaton, tags)
    assert row[8] is allowed and row[6] == (1.0 if licenses.to_postfix(row[7] or "") else 0.5)
    assert len(licenses.scan_text("SPDX-License-Identifier:" * 100_000, automaton, tags)) == 9
    assert licenses.scan_text("spdx alone is no tag", automaton, tags)[6:] == (0.0, None, None)
    assert licenses.scan_text("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0", automaton, tags)[7:] == ("MIT | GPL-2.0", False)
