"""Language of texts by a bidirectional gated recurrent network over bytes, which labels every position.

The network reads bytes, so it needs neither a tokenizer nor an alphabet. Each direction is a gated recurrent unit of one
gate: h = z * h + (1 - z) * tanh(x + U h) with z = sigmoid(x' + U' h), where x and x' are the byte's rows of two tables.
Both directions' states at a position give the probabilities of the languages there; a document's are the means over its
letter bytes. It is trained by backpropagation through time with Adam, in numpy, on windows of a bounded sample of
documents whose language is given.

A text is read whole, in windows that each start ``MARGIN`` bytes ahead of the positions they label (and, backwards, as
many behind), so that the state knows its surroundings; at the text's borders zero bytes stand there. Windows of many
texts are read side by side, a byte of each at a time, so time grows with the bytes and memory with ``AT_ONCE``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions that a window labels, bytes read on either side of them, windows read side by side.
WINDOW, MARGIN, AT_ONCE = 240, 16, 4096
#: Size of a direction's state, bytes of a training window, passes over the sample, windows of a step, step size.
HIDDEN, SPAN, EPOCHS, BATCH, RATE = 8, 96, 8, 256, 0.02
UNKNOWN = "und"
#: 1 for the bytes of ASCII letters and of all other letters (from 0x80).
_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)], dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass(frozen=True)
class Network:
    """Per direction the tables of the gate and of the candidate (256 x H), their recurrent weights (H x H) and the output weights (H x languages); and the output's bias."""

    languages: tuple[str, ...]
    weights: dict[str, np.ndarray]

    def read(self, codes: np.ndarray, side: str, steps: Sequence[int], first: int, out: np.ndarray) -> None:
        """Runs a direction over the bytes ``codes`` (positions x windows) in the order ``steps`` and adds what it says to ``out`` for position ``first`` on."""
        w = self.weights
        zx, nx, zh, nh, o = (w[f"{side}_{k}"] for k in ("zx", "nx", "zh", "nh", "o"))
        h = np.zeros((codes.shape[1], zh.shape[0]), dtype=np.float32)
        for t in steps:
            z, n = zx[codes[t]], nx[codes[t]]
            z += h @ zh
            n += h @ nh
            z = _sigmoid(z)
            np.tanh(n, out=n)
            h -= n
            h *= z
            h += n
            if 0 <= t - first < len(out):
                out[t - first] += h @ o

    def positions(self, codes: np.ndarray, margin: int = MARGIN) -> np.ndarray:
        """The probabilities of the languages (positions x windows x languages) of the positions but for ``margin`` on either side."""
        n = codes.shape[0]
        out = np.empty((n - 2 * margin, codes.shape[1], len(self.languages)), dtype=np.float32)
        out[:] = self.weights["bias"]
        self.read(codes, "f", range(n - margin), margin, out)
        self.read(codes, "b", range(n - 1, margin - 1, -1), margin, out)
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def label(self, data: np.ndarray, ends: np.ndarray, positions: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of texts that lie one after another in ``data``, up to ``ends``: the mean probabilities over letter bytes (0 without), and each byte's label if asked for."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        per_text = -(-(ends - begins) // WINDOW)
        text = np.repeat(np.arange(len(ends)), per_text)
        start = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * WINDOW
        total, letters = np.zeros((len(ends), len(self.languages))), np.zeros(len(ends))
        labels = np.zeros(len(data) if positions else 0, dtype=np.int16)
        for k in range(0, len(text), AT_ONCE):
            own, at = text[k : k + AT_ONCE], start[k : k + AT_ONCE]
            place = at + np.arange(-MARGIN, WINDOW + MARGIN)[:, None]
            inside = (place >= begins[own]) & (place < ends[own])
            codes = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
            p = self.positions(codes)
            here = inside[MARGIN:-MARGIN]
            letter = _LETTER[codes[MARGIN:-MARGIN]] * here
            np.add.at(total, own, np.einsum("tbk,tb->bk", p, letter))
            np.add.at(letters, own, letter.sum(axis=0))
            if positions:
                labels[place[MARGIN:-MARGIN][here]] = p.argmax(axis=2)[here]
        return total / np.maximum(letters, 1)[:, None], np.split(labels, ends[:-1]) if positions else []


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (mean cross-entropy over the letter positions of ``codes``, positions x windows) and gradients by backpropagation through time."""
    steps, b = codes.shape
    states: dict[str, list] = {}
    logits = np.zeros((steps, b, len(w["bias"])), dtype=np.float32) + w["bias"]
    for side in "fb":
        zx, nx, zh, nh, o = (w[f"{side}_{k}"] for k in ("zx", "nx", "zh", "nh", "o"))
        h, kept = np.zeros((b, zh.shape[0]), dtype=np.float32), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = _sigmoid(zx[codes[t]] + h @ zh)
            n = np.tanh(nx[codes[t]] + h @ nh)
            new = z * h + (1 - z) * n
            kept[t] = (h, z, n, new)
            h = new
            logits[t] += h @ o
        states[side] = kept
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    counted = _LETTER[codes]
    share = counted / max(1.0, counted.sum())
    loss = float(-(share * np.log(np.maximum(p[:, np.arange(b), target], 1e-9))).sum())
    p[:, np.arange(b), target] -= 1
    d = p * share[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] = d.sum(axis=(0, 1))
    for side in "fb":
        zh, nh, o = (w[f"{side}_{k}"] for k in ("zh", "nh", "o"))
        back = np.zeros((b, zh.shape[0]), dtype=np.float32)
        zs, ns = np.empty((steps, b, zh.shape[0]), np.float32), np.empty((steps, b, zh.shape[0]), np.float32)
        for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
            h, z, n, new = states[side][t]
            g[f"{side}_o"] += new.T @ d[t]
            back += d[t] @ o.T
            dz, dn = back * (h - n) * z * (1 - z), back * (1 - z) * (1 - n * n)
            g[f"{side}_zh"] += h.T @ dz
            g[f"{side}_nh"] += h.T @ dn
            back = back * z + dz @ zh.T + dn @ nh.T
            zs[t], ns[t] = dz, dn
        flat = codes.ravel()
        for name, v in (("zx", zs), ("nx", ns)):
            v = v.reshape(len(flat), -1)
            g[f"{side}_{name}"] = np.stack([np.bincount(flat, v[:, j], 256) for j in range(v.shape[1])], axis=1).astype(np.float32)
    return loss, g


def train(windows: np.ndarray, target: np.ndarray, languages: Sequence[str], hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> Network:
    """The network fitted to windows of bytes (positions x windows) of languages ``target``; the same windows give the same network."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    w = {"bias": np.zeros(k, dtype=np.float32)}
    for side in "fb":
        w |= {f"{side}_{n}": (rng.standard_normal((256, hidden)) * 0.3).astype(np.float32) for n in ("zx", "nx")}
        w |= {f"{side}_{n}": (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32) for n in ("zh", "nh")}
        w[f"{side}_zx"] += 1.0  # memory is kept at first
        w[f"{side}_o"] = (rng.standard_normal((hidden, k)) * 0.3).astype(np.float32)
    first, second = ({n: np.zeros_like(v) for n, v in w.items()} for _ in range(2))
    n, step = windows.shape[1], 0
    whole = max(1, epochs * -(-n // batch))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            _, g = _gradients(w, windows[:, own], target[own])
            norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
            step += 1
            now = rate * (1 - step / (whole + 1))
            for name, v in g.items():  # Adam on gradients of length 1 at most
                v = v / max(1.0, norm)
                first[name] += 0.1 * (v - first[name])
                second[name] += 0.01 * (v * v - second[name])
                w[name] -= now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return Network(tuple(languages), w)


def held_out(key: str):
    """Whether a row is kept from learning: the CRC-32 of its key as text leaves 1 by 3; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_network(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 8192, seed: int = 7) -> Network | None:
    """A network for the languages of ``df``, from rows with key, text and language that are not held out; None without any.

    From each language about ``sample`` / (number of languages) rows at most, those whose text hashes lowest, give a window of
    SPAN bytes at a place their hash chooses; equal texts count once. Only those windows reach the driver.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(key)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    top = F.lit(1.0)
    for name, n in counts.items():
        top = F.when(F.col("lang") == name, F.lit(each / n)).otherwise(top)
    # the hash as a number in [0, 1): a bound in proportion to the rows, so no sort is needed
    unit = (F.col("hash").cast("double") / 2.0**64) + 0.5
    length = F.length("text")
    place = (F.pmod(F.xxhash64(F.lit(seed), "text"), F.greatest(length - SPAN, F.lit(0)) + 1) + 1).cast("int")
    taken = rows.where(unit < top).select("lang", "hash", F.substr("text", place, F.lit(SPAN)).alias("text")).distinct().collect()
    windows = [(r["lang"], r["hash"], r["text"].encode("utf-8", "surrogatepass")[:SPAN]) for r in taken]
    windows = sorted(w for w in windows if any(c.isalpha() for c in w[2].decode("utf-8", "ignore")))
    if not windows:
        return None
    languages = sorted({w[0] for w in windows})
    codes = np.zeros((SPAN, len(windows)), dtype=np.uint8)
    for k, (_, _, b) in enumerate(windows):
        at = (SPAN - len(b)) // 2
        codes[at : at + len(b), k] = np.frombuffer(b, dtype=np.uint8)
    target = np.array([languages.index(w[0]) for w in windows])
    # few windows are gone over more often
    return train(codes, target, languages, epochs=min(100, max(EPOCHS, EPOCHS * sample // len(windows))), batch=min(BATCH, max(16, len(windows) // 16)), seed=seed)


def _spans(labels: np.ndarray, names: Sequence[str]) -> list[dict]:
    """Runs of equal labels as (first, end, lang) in bytes."""
    edges = np.flatnonzero(np.diff(labels)) + 1
    return [{"first": int(a), "end": int(b), "lang": names[labels[a]]} for a, b in zip([0, *edges], [*edges, len(labels)], strict=True)] if len(labels) else []


def predict_languages(df: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of ``df``: key, lang_pred, score (the mean probability of that language over letter bytes), and with ``spans`` the runs of bytes with one label.

    A null text, one without letters, or no network gives ``und`` and 0 (and no spans). Ties go to the language that is first in the alphabet.
    Repeated rows get equal results; an empty table gives an empty result; only key and text are read.
    """
    span = "array<struct<first:bigint,end:bigint,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                texts = own.column(1).cast(pa.large_binary())
                lengths = np.array([len(t) for t in map(lambda x: x.as_buffer() if x.is_valid else b"", texts)], dtype=np.int64)
                lettered = np.array([t.is_valid and (any(c.isalpha() for c in s[:64]) or any(map(str.isalpha, s))) for t, s in zip(own.column(1), own.column(1).fill_null("").to_pylist(), strict=True)], dtype=bool)
                data = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(t.as_buffer(), np.uint8) for t in texts if t.is_valid]])
                if network is None or not lettered.any():
                    names, score, runs = [UNKNOWN] * own.num_rows, np.zeros(own.num_rows), [[]] * own.num_rows
                else:
                    p, labels = network.label(data, np.cumsum(lengths), spans)
                    names = [network.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), lettered, strict=True)]
                    score = np.where(lettered, np.clip(p.max(axis=1), 0, 1), 0.0)
                    runs = [_spans(x, network.languages) if ok else [] for x, ok in zip(labels, lettered, strict=True)] if spans else []
                columns = [own.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", *["spans"] * spans])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double" + f", spans {span}" * spans)
    return found.withColumnRenamed("key", key)


def identify_languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 8192) -> DataFrame:
    """Fits on the rows of ``df`` that are not held out and predicts all: key, held_out, lang_pred, score. A null key is neither learned from nor held out."""
    found = predict_languages(df, fit_network(df, key, text, lang, sample), key, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
