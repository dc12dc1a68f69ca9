"""Short units are searched as tables of one length; paths and sums equal those over sorted edges."""

import random

import numpy as np

from stayflow.llm import pieces


def test_tables_equal_edges():
    v = pieces.load(pieces.DEFAULT_MODEL)
    draw = random.Random(3)
    units = ["".join(draw.choice("aen é中😀\ud800▁x1.") for _ in range(draw.randint(1, 20))) for _ in range(400)]
    units += ["▁" + w for w in "the straightforwardness of internationalised things".split()] + ["x" * 48, "x" * 49, "中" * 16, "😀" * 12, "", "a" * 700]
    blobs = [u.replace(" ", pieces.MARK).encode("utf-8", "surrogatepass") for u in units]
    ids, sizes = pieces._best_by_edges(blobs, v)
    want = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert [np.frombuffer(x, np.int32).tolist() for x in pieces.viterbi(blobs, v)] == want
    scores = np.log(np.random.default_rng(5).random(len(v.pieces)) / 3e4)
    weights = np.arange(1.0, len(blobs) + 1)
    counts, likelihood = pieces.expected_counts(blobs, weights, v, scores, float(scores.min()) - 10)
    other, value = pieces._summed_by_edges(blobs, weights, v, scores, float(scores.min()) - 10)
    assert np.allclose(counts, other, rtol=1e-9, atol=1e-9) and abs(likelihood - value) < 1e-9 * abs(value)
    assert pieces.viterbi([], v) == [] and not pieces.expected_counts([], np.zeros(0), v, scores, -30.0)[0].any()
    assert len(pieces.viterbi([b"x" * 60], v)) == 1
    # a table of many units takes steps of all of them, not sorted edges
    seen = []
    real, pieces._lattice = pieces._lattice, lambda u, v: seen.extend(u) or real(u, v)
    try:
        pieces.viterbi(blobs, v)
    finally:
        pieces._lattice = real
    assert min(map(len, seen)) > pieces.SHORT


def test_encoder_keeps_what_it_uses(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 6)
    v = pieces.load(pieces.DEFAULT_MODEL)
    texts = ["the cat sat on the mat", "the dog ran to a house", "the cat sat there then", "", None, "the  bird ▁flew over"]
    want, asked = [x.tolist() for x in pieces.Encoder(v).encode(texts)], []
    encoder, real = pieces.Encoder(v), pieces.viterbi
    monkeypatch.setattr(pieces, "viterbi", lambda units, w: asked.extend(units) or real(units, w))
    assert [encoder.encode([t])[0].tolist() for t in texts] == want
    assert asked.count("▁the".encode()) == 1 and len(encoder.known) <= 7 and len(encoder.older) <= 7
