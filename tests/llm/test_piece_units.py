"""Texts are cut wherever no piece crosses, so that few distinct units are counted and searched."""

import random

import numpy as np
import pyarrow as pa

from stayflow.llm import pieces


def test_joined_words_are_counted_apart(spark):
    v, draw = pieces.load(pieces.DEFAULT_MODEL), random.Random(2)
    words = [f"{a}{b}" for a in ("ver", "tion", "qua") for b in ("sam", "lor", "mit")]
    texts = [".\n".join(draw.choices(words, k=6)) for _ in range(200)] + ["a▁b", "▁", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = {bytes(r.unit).decode(): r.n for r in pieces.unit_counts(df, spark.sparkContext.broadcast(v)).collect()}
    assert len(counts) < 3 * len(words)  # cut at spaces only, nearly every text is a unit of its own
    assert sum(len(u) * n for u, n in counts.items()) == sum(len(t) + 1 - t.count("▁") for t in texts if t)


def test_cut_paths_are_the_best_of_whole_texts():
    v, draw = pieces.load(pieces.DEFAULT_MODEL), random.Random(4)
    scores = np.round(np.log(np.random.default_rng(6).random(len(v.pieces)) / 3e4), 6)
    v = pieces.Vocabulary(v.pieces, scores.tolist(), v.kinds)
    texts = ["".join(draw.choice("aent é中😀.,1\n $") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    whole = pieces.viterbi([(" " + t).replace(" ", pieces.MARK).encode() for t in texts], v)
    spelt = set(v.byte_ids.tolist())
    cost = lambda ids: sum(0 if i in spelt else round(scores[i] * 1e6) for i in ids)
    for ids, best in zip(pieces.Encoder(v).encode(texts), whole, strict=True):
        best = np.frombuffer(best, np.int32)
        assert cost(ids.tolist()) == cost(best.tolist()) and sum(i in spelt for i in ids.tolist()) == sum(i in spelt for i in best.tolist())


def test_other_bytes_are_found_out():
    v = pieces.load(pieces.DEFAULT_MODEL)
    texts = pa.array(["the cat", None, "sat\non", "", "ab"])
    ids, ends, data = pieces.Encoder(v).encode_all(texts)
    assert pieces.decodes(ids, ends, data, texts, v).tolist() == [True] * 5
    wrong = ids.copy()
    wrong[ends[2]] = wrong[0]
    assert pieces.decodes(wrong, ends, data, texts, v).tolist() == [True, True, False, True, True]
    shifted = ends.copy()
    shifted[1] = shifted[2] = ends[1] - 1
    assert pieces.decodes(ids, shifted, data, texts, v).tolist() == [False, True, False, True, True]
