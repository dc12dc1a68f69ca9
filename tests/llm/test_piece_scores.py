"""Every round of the fit of piece scores goes over all units of all texts."""

import numpy as np

from stayflow.llm import pieces


def test_every_round_counts_all_units(spark, monkeypatch):
    monkeypatch.setattr(pieces, "HEAD", 2, raising=False)  # a cut to the most frequent units would show
    texts = ["the cat the cat the cat", "unbelievable misunderstandings", "reconstruction of the internationalised", "the straightforwardness"]
    v = pieces.load(pieces.DEFAULT_MODEL)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    units = {bytes(r.unit): r.n for r in pieces.unit_counts(df, spark.sparkContext.broadcast(v), "text").collect()}
    blobs, n = list(units), np.array(list(units.values()), dtype=float)
    usable = np.array([k in (pieces.NORMAL, pieces.USER) and p != "" for p, k in zip(v.pieces, v.kinds, strict=True)])
    scores, counts, before = np.array(v.scores), np.zeros(len(usable)), None
    for again in range(pieces.ROUNDS + 1):
        share = counts[usable] + pieces.START_COUNT
        scores[usable] = np.round(np.log(share / share.sum()), 6)
        if again == pieces.ROUNDS or before is not None and len(before) > 1 and before[-1] - before[-2] <= pieces.GAIN * abs(before[-2]):
            break
        counts, now = pieces.expected_counts(blobs, n, v, scores, float(scores[usable].min()) - pieces.UNKNOWN_PENALTY)
        before = [*(before or []), now]
    found = np.array(pieces.fit_scores(df, v).scores)
    assert np.abs(found - scores).max() < 1e-5
