"""Alignment of two tokenizers over the same texts: groups of tokens between shared cuts, and how often tokens overlap corpus-wide.

A byte-level BPE (A, a JSON file) and a SentencePiece model (B) tokenize a text; both give tokens that tile its bytes.
Where a token of A and one of B end at the same byte, the text can be cut. Cuts are found by divide and conquer: of an
interval, the shared end nearest its middle is sought by bisecting ends of A in those of B, and both halves are
searched again; an interval without one is a group. The intervals of many texts are searched side by side, a level of
the recursion at a time.

Neither vocabulary joins what comes before a space to the space, so a text is encoded by units, a unit being a space
and what follows up to the next space that stands after something else than white space. Units repeat, so each is encoded once and kept
for later (``REMEMBERED`` units at most). A text of any length takes memory for its links only.

Counting links of id pairs over the corpus and handing each document the counts of its own pairs takes one shuffle of
rows (chunk, pair): a chunk is a run of documents with about ``LINKS`` links, whose distinct pairs are listed once and
whose documents refer to them by number. Neither texts nor a row per document and pair are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, written

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Units kept per worker, code points of text aligned at once, links of a chunk of documents.
REMEMBERED, PART, LINKS = 1 << 18, 1 << 19, 1 << 22
#: Units of more code points than this go to the library whose merges take no quadratic time.
LONG = 512
#: Steps from the middle of an interval before its other ends are tried all at once.
NEAR = 3
#: Fixed value: the pattern by which the byte-level tokenizer splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What parts units; a space that ends the text stays with its unit, as an empty unit would get no token of B.
_UNIT = re.compile(r"(?<=\S) (?!\Z)")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 letters are themselves, the rest follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The byte-level tokenizer of a JSON file; special tokens in texts are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.path, self.size = path, max(vocabulary.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        places = [vocabulary[m] for m in merges]
        self._quick = None
        if spec["pre_tokenizer"].get("use_regex") and not spec.get("normalizer") and places == sorted(places):  # ids in the order of merges are ranks
            ranks = {self.tokens[i]: i for t, i in spec["model"]["vocab"].items() if t not in special}
            self._quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def whole(self):
        """The reference library's tokenizer: slower, but in linear time and for any such file."""
        if not hasattr(self, "_whole"):
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return self._whole

    def encode(self, text: str) -> list[int]:
        if self._quick is None or len(text) > LONG:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self._quick.encode_ordinary(text)


class Pieces:
    """The tokenizer of a SentencePiece model, which puts a space ahead of texts itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.model.id_to_piece(list(range(self.size))))]
        if any(b" " in t.lstrip(b" ") for t in self.tokens):
            raise ValueError("pieces with an inner space: texts can't be encoded by units")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Ragged:
    """Lists of numbers in one growing array."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = self.ends[self.n - 1] if self.n else 0
        ends = begin + np.cumsum(lengths)
        while len(self.ends) < self.n + len(lists):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(lists) and len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if len(lists):
            self.flat[begin : ends[-1]] = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1] - begin))
        self.ends[self.n : self.n + len(lists)] = ends
        self.n += len(lists)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists' numbers one after another, the lists' lengths)."""
        ends = self.ends[which]
        lengths = ends - np.where(which > 0, self.ends[which - 1], 0)
        upto = np.cumsum(lengths)
        place = np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends - upto, lengths)
        return self.flat[place], lengths


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of intervals of tokens of A (numbers from ``first`` to ``last``, whose ends are shared): the numbers of all tokens whose end is shared, by divide and conquer.

    ``a`` and ``b`` hold the tokens' end bytes in ascending order.
    """
    shared = lambda k: b[np.minimum(np.searchsorted(b, a[k]), len(b) - 1)] == a[k]
    found = [last]
    lo, hi = first, last - 1  # ends that may be shared
    open_ = lo <= hi
    lo, hi = lo[open_], hi[open_]
    while len(lo):
        middle = (lo + hi) // 2
        cut = np.full(len(lo), -1, dtype=np.int64)
        for step in range(NEAR):
            for side in (1, -1) if step else (1,):
                k = middle + side * step
                still = np.flatnonzero((cut < 0) & (k >= lo) & (k <= hi))
                still = still[shared(k[still])]
                cut[still] = k[still]
        rest = np.flatnonzero((cut < 0) & (hi - lo >= 2 * NEAR - 2))
        if len(rest):  # all ends of the interval, the one nearest the middle wins
            width = hi[rest] - lo[rest] + 1
            owner = np.repeat(rest, width)
            k = np.arange(len(owner)) + np.repeat(lo[rest] - np.cumsum(width) + width, width)
            good = shared(k)
            owner, k = owner[good], k[good]
            near = np.lexsort((np.abs(k - middle[owner]), owner))
            heads = near[np.unique(owner[near], return_index=True)[1]] if len(near) else near
            cut[owner[heads]] = k[heads]
        cutting = cut >= 0
        lo, hi, cut = lo[cutting], hi[cutting], cut[cutting]
        found.append(cut)
        lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut - 1, hi])
        open_ = lo <= hi
        lo, hi = lo[open_], hi[open_]
    return np.sort(np.concatenate(found))


class Aligner:
    """Both tokenizers, and the units met so far."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.a_length, self.b_length = (np.array([len(t) for t in v.tokens], dtype=np.int64) for v in (self.a, self.b))
        #: tokens as text with what follows them: A inside a group, A last, B inside, B last
        self.names = [f"{i}{mark}" for size, marks in ((self.a.size, ",|"), (self.b.size, ",;")) for mark in marks for i in range(size)]
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.of_a, self.of_b, self.valid = _Ragged(), _Ragged(), np.zeros(0, dtype=bool)

    def numbers(self, units: list[str]) -> np.ndarray:
        new = [u for u in dict.fromkeys(units) if u not in self.units]
        if len(self.units) + len(new) > REMEMBERED:
            self.forget()
            new = list(dict.fromkeys(units))
        if new:
            self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
            of_a, of_b = [self.a.encode(" " + u) for u in new], self.b.encode(new)
            tokens_a, tokens_b = self.a.tokens, self.b.tokens
            whole = [(" " + u).encode("utf-8", "surrogatepass") for u in new]
            fits = [w == b"".join([tokens_a[i] for i in x]) and w == b"".join([tokens_b[i] for i in y]) for w, x, y in zip(whole, of_a, of_b, strict=True)]
            self.of_a.add(of_a)
            self.of_b.add(of_b)
            self.valid = np.concatenate([self.valid, fits])
        return np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))

    def align(self, parts: list[str]) -> list[dict | None]:
        """Of each part of a text (a whole text or one that ends before a unit): ids, cuts, links and the groups as text; None where the tokens' bytes are not the text's."""
        split = [_UNIT.split(p) for p in parts]
        sizes = np.array([len(s) for s in split], dtype=np.int64)
        u = self.numbers([x for s in split for x in s])
        bad = np.add.reduceat(~self.valid[u], np.cumsum(sizes) - sizes) > 0
        if bad.any():
            u = u[np.repeat(~bad, sizes)]
            sizes = sizes[~bad]
        if not len(u):
            return [None] * len(parts)
        ids_a, per_a = self.of_a.take(u)
        ids_b, per_b = self.of_b.take(u)
        a, b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        of_part = np.cumsum(sizes) - 1
        last_a, last_b = np.cumsum(per_a)[of_part] - 1, np.cumsum(per_b)[of_part] - 1
        cut_a = shared_cuts(a, b, np.concatenate([[0], last_a[:-1] + 1]), last_a)
        cut_b = np.searchsorted(b, a[cut_a])
        ends = np.sort(np.concatenate([a, b]), kind="stable")
        ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]  # each piece between ends is one overlap of an A and a B token
        key = ids_a[np.searchsorted(a, ends)].astype(np.int64) * self.b.size + ids_b[np.searchsorted(b, ends)]
        code = np.empty(len(a) + len(b), dtype=np.int64)
        # tokens of A move behind all groups before theirs, those of B behind their own group's tokens of A too
        code[np.arange(len(a)) + np.repeat(np.concatenate([[0], cut_b[:-1] + 1]), np.diff(cut_a, prepend=-1))] = ids_a
        code[np.arange(len(b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))] = ids_b + 2 * self.a.size
        at = cut_a + np.concatenate([[0], cut_b[:-1] + 1])
        code[at] += self.a.size
        code[cut_a + cut_b + 1] += self.b.size
        names = list(map(self.names.__getitem__, code.tolist()))
        groups, links = np.searchsorted(cut_a, last_a, "right"), np.searchsorted(ends, a[last_a], "right")
        found, done = [], (0, 0, 0, 0)
        for i, j, g, k in zip((last_a + 1).tolist(), (last_b + 1).tolist(), groups.tolist(), links.tolist(), strict=True):
            i0, j0, g0, k0 = done
            found.append({"n_a": i - i0, "n_b": j - j0, "n_groups": g - g0, "key": key[k0:k], "text": "".join(names[i0 + j0 : i + j]), "ids_a": ids_a[i0:i], "ids_b": ids_b[j0:j], "cut_a": cut_a[g0:g] - i0, "cut_b": cut_b[g0:g] - j0})
            done = (i, j, g, k)
        good = iter(found)
        return [None if x else next(good) for x in bad]

    def groups(self, text: str) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """The groups of a text as (ids of A, ids of B); empty where the tokens' bytes are not the text's."""
        out, parts = [], self.align(_parts(text)) if text else []
        if any(p is None for p in parts):
            return []
        for p in parts:
            i = j = 0
            for x, y in zip((p["cut_a"] + 1).tolist(), (p["cut_b"] + 1).tolist(), strict=True):
                out.append((tuple(p["ids_a"][i:x].tolist()), tuple(p["ids_b"][j:y].tolist())))
                i, j = x, y
        return out


def _parts(text: str) -> list[str]:
    """The text in parts of about PART code points that end before a unit."""
    if len(text) <= PART:
        return [text]
    out, at = [], 0
    while len(text) - at > PART:
        m = _UNIT.search(text, at + PART)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def to_planes(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps of four bytes, all first bytes ahead of all second ones and so on: runs of zeros that compress."""
    return np.ascontiguousarray(np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


ENCODED = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, keys binary, counts binary"
_ENCODED = pa.schema([("key", pa.string()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), *[(c, pa.large_binary()) for c in ("pairs", "keys", "counts")]])


class _Chunk:
    """Documents with their links, and what they come to as rows."""

    def __init__(self, number: int):
        self.number, self.rows, self.keys, self.links = number, [], [], 0

    def add(self, key: str | None, parts: list[dict | None]) -> None:
        if not parts or any(p is None for p in parts):
            self.rows.append((key, 0, 0, 0, 0, ""))
            self.keys.append(np.zeros(0, dtype=np.int64))
            return
        h = sha256()
        for k, p in enumerate(parts):
            h.update((p["text"] if k < len(parts) - 1 else p["text"][:-1]).encode())  # no mark after the last group
        n = sum(len(p["key"]) for p in parts)
        self.rows.append((key, *[sum(p[c] for p in parts) for c in ("n_a", "n_b", "n_groups")], n, h.hexdigest()))
        self.keys.append(np.concatenate([p["key"] for p in parts]))
        self.links += n

    def batch(self) -> pa.RecordBatch:
        sizes = [len(k) for k in self.keys]
        keys, place, counts = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mine = np.sort(owner * max(1, len(keys)) + place) - owner * max(1, len(keys))
        pairs = [to_planes(x) for x in np.split(mine, np.cumsum(sizes)[:-1])]
        columns = [[*c, None] for c in zip(*self.rows, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip([columns[0], [self.number] * (len(sizes) + 1), *columns[1:], [*pairs, None], [*[None] * len(sizes), keys.tobytes()], [*[None] * len(sizes), counts.astype(np.int64).tobytes()]], _ENCODED, strict=True)], schema=_ENCODED
        )


def encode_documents(df: DataFrame, key: str, text: str, a_path: str, b_path: str) -> DataFrame:
    """Written rows of documents (key, chunk, counts, groups_sha256, pairs: numbers of their links' pairs in the chunk) and one of each chunk (keys and counts of its pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            held: list[tuple[str | None, int]] = []  # rows and how many parts each has
            parts: list[str] = []
            size = 0
            for row in range(batch.num_rows):
                value = batch.column(1)[row].as_py()
                own = _parts(value) if value else []
                held.append((batch.column(0)[row].as_py(), len(own)))
                parts += own
                size += len(value or "")
                if size >= PART or row == batch.num_rows - 1:
                    aligned = iter([x for k in _slices(parts) for x in aligner.align(k)])
                    for k, n in held:
                        chunk.add(k, [next(aligned) for _ in range(n)])
                        if chunk.links >= LINKS:
                            yield chunk.batch()
                            number += 1
                            chunk = _Chunk(number)
                    held, parts, size = [], [], 0
        if chunk.rows:
            yield chunk.batch()

    return written(df.select(df[key].cast("string").alias("key"), df[text].alias("text")).mapInArrow(trimmed(run), f"key string, {ENCODED}"), "zstd")


def _slices(parts: list[str]) -> Iterator[list[str]]:
    """Parts in runs of about PART code points."""
    own, size = [], 0
    for p in parts:
        own.append(p)
        size += len(p)
        if size >= PART:
            yield own
            own, size = [], 0
    if own:
        yield own


def link_counts(encoded: DataFrame, pieces: int) -> DataFrame:
    """(chunk, a, b, links, count, best): each chunk's id pairs with their links in it and corpus-wide, and whether no other pair of that b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, counts in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                k, n = np.frombuffer(keys, dtype=np.int64), np.frombuffer(counts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array((k // pieces).astype(np.int32)), pa.array((k % pieces).astype(np.int32)), pa.array(n)], names=["chunk", "a", "b", "links"])

    rows = encoded.where("keys IS NOT NULL").select("chunk", "keys", "counts").mapInArrow(run, "chunk long, a int, b int, links long")
    # a pair has a row per chunk at most
    counted = rows.withColumn("count", F.sum("links").over(Window.partitionBy("a", "b")))
    most = counted.groupBy("b").agg(F.max("count").alias("__most"))  # a row per piece of B's vocabulary at most
    return counted.join(F.broadcast(most), "b").select("chunk", "a", "b", "links", "count", (F.col("count") == F.col("__most")).alias("best"))


RESULT = "key string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weigh(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values(["a", "b"])
    count, best = pairs["count"].to_numpy(dtype=np.int64), pairs["best"].to_numpy(dtype=bool)
    places = [from_planes(p) for p in own["pairs"]]
    out = own.drop(columns=["chunk", "pairs"])
    return out.assign(n_best=[int(best[p].sum()) for p in places], count_sum=[int(count[p].sum()) for p in places])


def align_documents(df: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_a, n_b (tokens), n_groups, n_links (overlapping occurrences), n_best (links whose pair is the commonest of its b, ties included), count_sum (the pairs' corpus-wide counts, over links), groups_sha256.

    A text that is null or empty, or whose tokens do not join to a space and the text, has zeros and ''. Repeated rows
    count and are returned as often as they stand; an empty table gives an empty result; other columns are not read.
    Both files must lie at the same path on every machine.
    """
    encoded = encode_documents(df, key, text, a_path, b_path)
    own = encoded.where("keys IS NULL").select("key", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs")
    pairs = link_counts(encoded, Pieces(b_path).size).select("chunk", "a", "b", "count", "best")
    found = own.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInPandas(_weigh, RESULT)
    return found.select(F.col("key").cast(df.schema[key].dataType).alias(key), *[c.split()[0] for c in RESULT.split(", ")[1:]])
