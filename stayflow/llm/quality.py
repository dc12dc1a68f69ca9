"""Quality classifier without hand labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Every document gets votes of overlapping labellers (good, bad or abstain). A labeller that knows one flaw says bad
where it sees it and abstains elsewhere, as not to see a flaw is no evidence of quality; those that know traits of
prose say good where they see them. Marks are counted by one labeller only, since several would agree by construction.
Documents are counted by vote pattern, and expectation-maximisation under conditional independence (Dawid & Skene
1979, an abstention being a third answer) estimates from these counts how each labeller answers on good and on bad
documents and how many are good. Bad documents are of several kinds, as many as there are flaws, since answers are not
independent over all of them: what repeats a word has words of ordinary length. The posterior of a pattern labels the documents that have it, and a logistic scorer
over hashed character-class n-grams, hashed words and word-repetition features learns those labels.

The counts cover all documents but number at most 3 ** labellers; only they and a bounded sample of feature rows
reach the driver. Texts are read where they lie, once for the votes and once for the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed, written

GOOD, BAD, ABSTAIN = 1, 0, -1

#: Character classes of bytes: 0 blank, 1 line end, 2 a-z and digits, 3 A-Z, 4 marks of prose and addresses, 5 other ASCII, 6 from 0x80 (parts of letters).
_CLASS = np.array(
    [1 if c in (10, 13) else 0 if c == 32 or 9 <= c <= 13 else 2 if 97 <= c <= 122 or 48 <= c <= 57 else 3 if 65 <= c <= 90
     else 4 if chr(c) in ".,;:'\"?()-@+/_" else 6 if c >= 128 else 5 for c in range(256)], dtype=np.uint8)
_CLASSES = 7
NAMES = ("marks", "capitals", "bars", "repeats", "variety", "word_length", "sentences")
#: Hash buckets of the scorer's features: character-class n-grams, words, repetition.
GRAMS, WORDS, STEPS = 256, 128, 32
FEATURES = GRAMS + WORDS + STEPS
_NGRAM = 4
#: Words of a run whose distinct ones are counted, and bytes of a text that are looked at together.
RUN, BLOCK = 64, 1 << 18
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def _blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end before white space, so that no word is cut."""
    at = 0
    while at < len(data):
        m = _BLANK.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        yield at, (at := m.start() if m else len(data))


def statistics(text: str | None, scored: bool = False) -> tuple[np.ndarray, np.ndarray | None] | None:
    """(statistics that the labellers read, with ``scored`` the scorer's features) of a whole text; None without words.

    The text is gone through in blocks, so arrays stay small however long it is.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    count, grams, hashed = np.zeros(_CLASSES, dtype=np.int64), np.zeros(GRAMS, dtype=np.int64), np.zeros(WORDS, dtype=np.int64)
    n = odd = same = runs = distinct = 0
    pending: list[bytes] = []  # words of the run that is not full
    recent: list[bytes] = []  # the last RUN words
    for begin, end in _blocks(data):
        kind = _CLASS[raw[begin:end]]
        count += np.bincount(kind, minlength=_CLASSES)
        words = data[begin:end].split()
        if words:
            same += sum(map(eq, words, words[1:])) + bool(recent and recent[-1] == words[0])
            of_word = np.cumsum(np.diff((kind < 2).astype(np.int8), prepend=1) == -1)
            odd += len(np.unique(of_word[kind == 5]))  # words with a mark that prose does not use
            n += len(words)
            pending += words
            recent = (recent + words)[-RUN:]
            at = 0
            while len(pending) - at > RUN:
                distinct, runs, at = distinct + len(set(pending[at : at + RUN])), runs + 1, at + RUN
            pending = pending[at:]
        if scored:
            code = _CLASS[raw[max(0, begin - _NGRAM + 1) : end]].astype(np.int64)
            whole = np.zeros(max(0, len(code) - _NGRAM + 1), dtype=np.int64)
            for j in range(_NGRAM):
                whole = whole * _CLASSES + code[j : j + len(whole)]
            grams += np.bincount((whole * 2654435761 % (1 << 32)) * GRAMS >> 32, minlength=GRAMS)
            hashed += np.bincount(np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % WORDS, minlength=WORDS)
    if not n:
        return None
    letters = count[2] + count[3] + count[6]
    visible = max(1, len(raw) - count[0] - count[1])
    # distinct words in runs, so that long texts are judged as short ones are; the last run ends with the text
    variety = len(set(recent)) / n if n <= RUN else (distinct + len(set(recent))) / (runs + 1) / RUN
    ends = sum(data.count(m) for m in (b". ", b".\n", b"? ", b"! ")) + data.rstrip().endswith((b".", b"?", b"!"))
    s = np.array([count[5] / visible, count[3] / max(1, letters), data.count(b"|") / n, same / max(1, n - 1), variety, odd / n, visible / n, ends / n, n])
    return s, features(s, grams, hashed) if scored else None


def votes(s: np.ndarray | None) -> list[int]:
    """The labellers' votes on statistics; a text without words is bad by all."""
    if s is None:
        return [BAD] * len(NAMES)
    symbols, capitals, bars, repeats, distinct, odd, length, ends, n = s
    say = lambda bad, good=False: BAD if bad else GOOD if good else ABSTAIN
    return [
        say(symbols > 0.06 or (odd > 0.25 and n >= 8)),
        say(capitals > 0.5),
        say(bars > 0.1),
        say(repeats > 0.25 and n >= 8),
        say(distinct < 0.35 and n >= 32, distinct > 0.7 and n >= 20 and odd < 0.1),
        say(length > 15 or length < 2, 3 <= length <= 10 and symbols < 0.03),
        say(ends == 0 and n >= 40, 0.02 <= ends <= (0.25 if n >= 20 else 0.5) and capitals < 0.15),
    ]


def features(s: np.ndarray, grams: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Shares of hashed character-class n-grams and of hashed words, and marks of word repetition, as a vector of FEATURES."""
    out = np.zeros(FEATURES)
    out[:GRAMS] = np.sqrt(grams / max(1, grams.sum()))
    out[GRAMS : GRAMS + WORDS] = np.sqrt(hashed / hashed.sum())
    for name, value in enumerate((s[3], s[4], s[5])):
        step = int(min(1.0, value) * 8)
        out[GRAMS + WORDS + (name * 64 + step) * 2654435761 % (1 << 32) * STEPS // (1 << 32)] += 1.0
    return out


@dataclass(frozen=True)
class LabelModel:
    shares: np.ndarray  # of good documents and of each kind of bad ones
    rates: np.ndarray  # kinds x labellers x (bad, good, abstain): how often each answers so

    @property
    def good(self) -> float:
        """The share of good documents."""
        return float(self.shares[0])

    @property
    def right_good(self) -> np.ndarray:
        """Per labeller P(says good | good, no abstention)."""
        return self.rates[0, :, GOOD] / (self.rates[0, :, GOOD] + self.rates[0, :, BAD])

    @property
    def right_bad(self) -> np.ndarray:
        """Per labeller P(says bad | bad, no abstention), over all kinds."""
        on_bad = np.tensordot(self.shares[1:], self.rates[1:], axes=1)
        return on_bad[:, BAD] / (on_bad[:, GOOD] + on_bad[:, BAD])

    def shares_of(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(kind | pattern) for each row of votes, log P(pattern))."""
        who = np.arange(patterns.shape[1])
        logs = np.log(self.shares) + np.log(self.rates[:, who, patterns]).sum(axis=2).T
        top = logs.max(axis=1, keepdims=True)
        whole = np.exp(logs - top).sum(axis=1, keepdims=True)
        return np.exp(logs - top) / whole, (top + np.log(whole))[:, 0]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) for each row of votes."""
        return self.shares_of(patterns)[0][:, 0] if len(patterns) else np.zeros(0)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts, with one kind of bad documents or one per labeller.

    Several kinds are taken where they raise the log likelihood by more than their parameters number (Akaike's criterion).
    """
    one, many = (_fit_kinds(patterns, counts, kinds, rounds) for kinds in (1, patterns.shape[1]))
    gain = counts @ (many.shares_of(patterns)[1] - one.shares_of(patterns)[1])
    return many if gain > (len(many.shares) - len(one.shares)) * (1 + 2 * patterns.shape[1]) else one


def _fit_kinds(patterns: np.ndarray, counts: np.ndarray, kinds: int, rounds: int) -> LabelModel:
    """The model with so many kinds of bad documents.

    It starts from good where no vote is bad or where twice as many votes are good, and else from the kind of the
    first bad vote. Shares and rates are smoothed by one observation of each kind and of each answer, so no
    probability is 0 or 1: the estimates are those of the largest posterior under a flat Dirichlet prior.
    """
    cast = np.stack([patterns == BAD, patterns == GOOD, patterns == ABSTAIN], axis=2).astype(float)
    is_bad, says_good = patterns == BAD, cast[:, :, GOOD].sum(axis=1)
    good = ~is_bad.any(axis=1) | (is_bad.sum(axis=1) * 2 <= says_good)
    p = np.eye(1 + kinds)[np.where(good, 0, 1 + is_bad.argmax(axis=1) % kinds)]
    model = None
    for _ in range(rounds):
        weight = p * counts[:, None]
        own = weight.sum(axis=0)
        new = LabelModel((own + 1) / (own.sum() + len(own)), (np.einsum("pk,plv->klv", weight, cast) + 1) / (own[:, None, None] + 3))
        q, _ = new.shares_of(patterns)
        if model is not None and np.abs(q - p).max() < 1e-9:
            return new
        model, p = new, q
    return model


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


def fit_scorer(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> Scorer:
    """Logistic regression on soft targets by Newton steps, both classes weighing the same."""
    n, d = x.shape
    mass = np.array([max(1e-9, target.sum()), max(1e-9, (1 - target).sum())])
    weight = n * (target / mass[0] + (1 - target) / mass[1]) / 2
    label = np.divide(target / mass[0], target / mass[0] + (1 - target) / mass[1])
    z = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(d + 1)
    ridge = np.full(d + 1, penalty * n)
    ridge[-1] = 1e-6 * n
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - label)) + ridge * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return Scorer(w[:-1], float(w[-1]))


def _votes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [votes(s and s[0]) for s in (statistics(t.as_py()) for t in batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(rows, pa.list_(pa.int32()))], names=["hash", "votes"])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(votes(s), x.tolist()) for s, x in filter(None, (statistics(t.as_py(), True) for t in batch.column("text")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["votes", "x"])


def fit(df: DataFrame, text: str = "text", sample: int = 8192) -> tuple[LabelModel, Scorer]:
    """The label model of all documents' votes and the scorer of ``sample`` documents at most, those whose text hashes lowest."""
    hashed = df.select(F.xxhash64(df[text]).alias("hash"), df[text].alias("text"))
    voted = written(hashed.mapInArrow(trimmed(_votes_of), "hash long, votes array<int>"))
    counted = voted.groupBy("votes").count().collect()  # 3 ** labellers rows at most
    patterns = np.array([r["votes"] for r in counted], dtype=np.int64).reshape(-1, len(NAMES))
    labels = fit_labels(patterns, np.array([r["count"] for r in counted], dtype=float)) if len(patterns) else LabelModel(np.array([0.5, 0.5]), np.full((2, len(NAMES), 3), 1 / 3))
    # equal texts count once in the sample, whatever their number
    last = voted.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    chosen = hashed.where(F.col("hash") <= F.lit(last if last is not None else 0)).dropDuplicates(["hash"])
    rows = chosen.mapInArrow(trimmed(_features_of), "votes array<int>, x array<float>").collect()
    if not rows:
        return labels, Scorer(np.zeros(FEATURES), 0.0)
    x = np.array([r["x"] for r in rows], dtype=np.float64)
    return labels, fit_scorer(x, labels.posterior(np.array([r["votes"] for r in rows], dtype=np.int64)))


SCORED = "n_words long, votes array<int>, posterior double, score double, kept boolean"


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 8192, threshold: float = 0.5, models: tuple | None = None) -> DataFrame:
    """One row per row of ``df``: key, n_words, votes, posterior, score, kept (score >= threshold).

    Both models are fitted on ``df`` itself unless given. A null text or one without words gets bad votes from all,
    score 0 and is not kept; repeated rows get equal results, so order does not matter; an empty table gives an empty
    result; other columns are not read.
    """
    labels, scorer = models or fit(df, text, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own_votes, scores = [], [], []
            for t in batch.column("text"):
                s = statistics(t.as_py(), True)
                n.append(int(s[0][-1]) if s else 0)
                own_votes.append(votes(s and s[0]))
                scores.append(float(scorer.score(s[1])) if s else 0.0)
            cast, score = np.array(own_votes, dtype=np.int64).reshape(-1, len(NAMES)), np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(cast.tolist(), pa.list_(pa.int32())), pa.array(labels.posterior(cast)), pa.array(score), pa.array(score >= threshold)],
                names=["key", "n_words", "votes", "posterior", "score", "kept"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(trimmed(run), f"key {kind}, {SCORED}").withColumnRenamed("key", key)


def keep_good(df: DataFrame, text: str = "text", sample: int = 8192, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all its columns, whose text scores ``threshold`` or more; texts are filtered where they lie."""
    _, scorer = fit(df, text, sample)
    at = df.columns.index(text)

    def passes(value: str | None) -> bool:
        s = statistics(value, True)
        return s is not None and bool(scorer.score(s[1]) >= threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)
