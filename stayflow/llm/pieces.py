"""SentencePiece encoding by unigram Viterbi search over a double-array trie of pieces, and decoding.

The pieces are those of a model file (a parameter, read on the driver); they become a trie over UTF-8 bytes in two
integer arrays, which tasks receive with the code. Their scores are unigram log probabilities fitted on the documents
by expectation maximisation: the file's own are merge ranks, whose sums mean nothing. A space is the marker U+2581, and no piece has a marker after
another character. No path crosses a place between two bytes that no piece holds in a row (a space and the letter before
it, a full stop and a line's end), so the best path of a text is the best paths of its units, the parts between such
places, in a row. Units are searched together, one array step for all units of a batch, and remembered in a bounded table.
Characters no piece covers become byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, trimmed, written

MARK = "▁"
#: The kinds of pieces in a model file, and the cost of an uncovered character below the worst piece.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Units counted at once by a task, and remembered in each of an encoder's two generations.
COUNTED, REMEMBERED = 400_000, 300_000
#: Bytes of texts that are cut into units at once, and pieces whose bytes are compared with a text at once.
CUT_BYTES, COMPARED = 4_000_000, 1 << 20
#: Rounds over all units end once one raises the log likelihood by less than this share, or after so many; every piece starts from a count.
GAIN, ROUNDS, START_COUNT = 1e-3, 20, 0.1
#: Bytes of units whose paths are summed at once.
FIT_BYTES = 400_000
#: Units of up to so many bytes are searched as tables, at most so many of one length at once; longer ones as sorted edges.
SHORT, TABLE_UNITS = 48, 2048
#: Path sums of tables that come out below are done again with logarithms.
LEAST_SUM = 1e-250
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds of a SentencePiece model file."""
    pieces, scores, kinds = [], [], []
    with open(path, "rb") as f:
        for tag, value in _fields(f.read()):
            if tag == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
    return pieces, scores, kinds


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: from state s, byte c leads to t = base[s] + c + 1 if check[t] == s; value[t] is a key's value or -1."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for key, value in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = value
    size = len(children) * 2 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    state = {0: 0}
    # single children fill the gaps; for several the search goes on where it last ended, which keeps it linear
    free = wide = 257  # below that not every byte has a place
    for node, own in enumerate(children):
        s = state[node]
        if node in ends:
            value[s] = ends[node]
        if not own:
            continue
        codes = sorted(c + 1 for c in own)
        while taken[free]:
            free += 1
        b = (free if len(codes) == 1 else max(free, wide)) - codes[0]
        while b + codes[-1] + 1 >= len(taken) or any(taken[b + c] for c in codes):
            if b + codes[-1] + 1 >= len(taken):
                taken.extend(bytes(size))
                base, check, value = np.concatenate([base, np.zeros(size, np.int32)]), np.concatenate([check, np.full(size, -1, np.int32)]), np.concatenate([value, np.full(size, -1, np.int32)])
                continue
            b += 1
        base[s] = b
        if len(codes) > 1:
            wide = max(wide, b + codes[0] - 64)
        for c in codes:
            taken[b + c] = 1
            check[b + c] = s
            state[own[c - 1]] = b + c
    used = max((i for i, t in enumerate(taken) if t), default=0) + 258
    grown = lambda x, fill: np.concatenate([x, np.full(max(0, used - len(x)), fill, np.int32)])[:used]
    return grown(base, 0), grown(check, -1), grown(value, -1)


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return double_array([(p.encode(), i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER) and p])

    @cached_property
    def byte_ids(self) -> np.ndarray:
        """The piece of each byte value."""
        ids = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                ids[int(p[3:-1], 16)] = i
        if (ids < 0).any():
            raise ValueError("the model has no byte pieces")
        return ids

    @cached_property
    def unknown_score(self) -> float:
        # pieces that the model bans by an absurd score don't set the scale
        return min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL and s > -1e8) - UNKNOWN_PENALTY

    @cached_property
    def costs(self) -> np.ndarray:
        """The scores of all pieces and, at the end, of an uncovered character."""
        return np.append(self.scores, self.unknown_score)

    @cached_property
    def apart(self) -> np.ndarray:
        """For each two bytes (256 * first + second; a space for a marker) whether a text is cut between them: the second begins a character and no piece holds both in a row."""
        out = np.ones((256, 256), dtype=bool)
        out[:, 0x80:0xC0] = False
        for p, k in zip(self.pieces, self.kinds, strict=True):
            if k in (NORMAL, USER):
                b = np.frombuffer(p.replace(MARK, " ").encode(), dtype=np.uint8)
                out[b[:-1], b[1:]] = False
        return out.ravel()

    @cached_property
    def surfaces(self) -> pa.Array:
        """``surface`` as an array of bytes."""
        blob, start, _ = self.surface
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(blob)).astype(np.int32)), pa.py_buffer(blob.tobytes())])

    @cached_property
    def surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all pieces in a row, start, length): what each piece decodes to; control pieces decode to nothing."""
        out = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN, UNUSED) else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        length = np.array([len(x) for x in out], dtype=np.int64)
        return np.frombuffer(b"".join(out), dtype=np.uint8), np.cumsum(length) - length, length


def _lattice(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, ...]:
    """All pieces in the units as edges: (codes, starts, stops) of the units and (from, to, piece or -1, distance of its end from the unit's start)."""
    base, check, value = v.trie
    lengths = np.array([len(u) for u in units])
    # a place per byte and one for the unit's end, whose code leads nowhere
    codes = np.frombuffer(b"\xff".join(units) + b"\xff", dtype=np.uint8).astype(np.int64) + 1
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    is_char = (codes - 1) & 0xC0 != 0x80
    is_char[stops] = False
    codes[stops] = 0
    chars = np.flatnonzero(is_char)
    lead = codes[chars] - 1
    width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    at, state, depth = chars, np.zeros(len(chars), np.int64), 0
    froms, tos, ids = [], [], []
    while len(at):
        code = codes[at + depth]
        nxt = base[state] + code
        ok = (code > 0) & (check[nxt] == state)
        at, state = at[ok], nxt[ok]
        depth += 1
        piece = value[state]
        hit = piece >= 0
        froms.append(at[hit])
        tos.append(at[hit] + depth)
        ids.append(piece[hit])
    covered = np.zeros(len(codes), dtype=bool)
    for f, t in zip(froms, tos, strict=True):
        covered[f[t - f == np.where(codes[f] <= 0x80, 1, np.where(codes[f] <= 0xE0, 2, np.where(codes[f] <= 0xF0, 3, 4)))]] = True
    bare = ~covered[chars]
    froms.append(chars[bare])
    tos.append(chars[bare] + width[bare])
    ids.append(np.full(int(bare.sum()), -1))
    f, t, i = (np.concatenate(x).astype(np.int64) for x in (froms, tos, ids))
    unit_of = np.searchsorted(stops, f)
    step = t - starts[unit_of]
    order = np.lexsort((f, t, step))  # all units' places at one distance from their start are settled together
    f, t, i, step = f[order], t[order], i[order], step[order]
    return codes, starts, stops, f, t, i, step


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """The ranges of equal values."""
    edges = np.flatnonzero(np.diff(keys, prepend=-1))
    return zip(edges, np.append(edges[1:], len(keys)), strict=True)


def _tables(units: list[bytes], v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """Units of one length at a time: (their places in ``units``, their bytes as columns, per width of edges their (from, piece or -1)).

    An edge's start counts bytes row by row, so that it ends as many rows below as it is wide.
    """
    if not units:
        return
    base, check, value = v.trie
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(lengths, kind="stable")
    for lo, hi in _runs(lengths[order]):
        for begin in range(lo, hi, TABLE_UNITS):
            own = order[begin : min(hi, begin + TABLE_UNITS)]
            n, length = len(own), int(lengths[own[0]])
            raw = np.ascontiguousarray(np.frombuffer(b"".join([units[k] for k in own]), np.uint8).reshape(n, length).T)
            codes = np.zeros((length + 1) * n, np.int64)  # the last row's code leads nowhere
            codes[: length * n] = raw.ravel()
            codes[: length * n] += 1
            chars = np.flatnonzero((raw.ravel() & 0xC0) != 0x80)
            lead = codes[chars] - 1
            width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            covered = np.zeros(length * n, dtype=bool)
            widths = np.zeros(length * n, np.int8)
            widths[chars] = width
            edges, at, state, depth = {}, chars, np.zeros(len(chars), np.int64), 0
            while len(at):
                code = codes[at + depth * n]
                nxt = base[state] + code
                ok = np.flatnonzero((check[nxt] == state) & (code > 0))
                at, state = at[ok], nxt[ok]
                depth += 1
                piece = value[state]
                hit = np.flatnonzero(piece >= 0)
                edges[depth] = own_at, _ = at[hit], piece[hit]
                if depth <= 4:
                    covered[own_at[widths[own_at] == depth]] = True
            bare = ~covered[chars]
            for d in np.unique(width[bare]).tolist():
                more = chars[bare & (width == d)]
                known = edges.get(d, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
                edges[d] = np.append(known[0], more), np.append(known[1], np.full(len(more), -1, np.int32))
            yield own, raw, {d: e for d, e in edges.items() if len(e[0])}


def expected_counts(units: list[bytes], weights: np.ndarray, v: Vocabulary, scores: np.ndarray, unknown: float) -> tuple[np.ndarray, float]:
    """How often each piece is expected over all paths of the units, each unit ``weights`` times, and the units' log likelihood.

    Units of one length are summed together, their paths' probabilities themselves; units that are long, or whose sum
    comes near the least number there is, with logarithms.
    """
    weights, chance = np.asarray(weights, dtype=np.float64), np.append(np.exp(scores), np.exp(unknown))
    rest, pieces, shares, likelihood = [k for k, u in enumerate(units) if len(u) > SHORT], [], [], 0.0
    short = [k for k, u in enumerate(units) if len(u) <= SHORT] if rest else range(len(units))
    for own, raw, edges in _tables([units[k] for k in short] if rest else units, v):
        length, n = raw.shape
        own = np.asarray(short)[own] if rest else own
        tables = []
        for d, (at, piece) in edges.items():
            w = np.zeros(length * n)
            w[at] = chance[piece]
            w = w.reshape(length, n)
            tables.append((d, w, np.bincount(at // n, minlength=length) > 0))
        ahead, behind = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        ahead[0] = behind[length] = 1.0
        for t in range(1, length + 1):
            for d, w, some in tables:
                if d <= t and some[t - d]:
                    ahead[t] += ahead[t - d] * w[t - d]
        for f in range(length - 1, -1, -1):
            for d, w, some in tables:
                if some[f]:
                    behind[f] += behind[f + d] * w[f]
        total = ahead[length].copy()
        good = total > LEAST_SUM
        rest += own[~good].tolist()
        ahead *= np.where(good, weights[own] / np.where(good, total, 1.0), 0.0)
        likelihood += float(weights[own][good] @ np.log(total[good]))
        for (d, w, _), (at, piece) in zip(tables, edges.values(), strict=True):
            share = ahead[: length - d + 1] * w[: length - d + 1]
            share *= behind[d:]
            pieces.append(piece)
            shares.append(share.ravel()[at])
    piece, share = (np.concatenate(x) if x else np.zeros(0) for x in (pieces, shares))
    counts = np.bincount(piece.astype(np.int64) + 1, share, len(scores) + 1)[1:]  # uncovered characters come first
    if rest:
        found, value = _summed_by_edges([units[k] for k in rest], weights[rest], v, scores, unknown)
        counts, likelihood = counts + found, likelihood + value
    return counts, likelihood


def _summed_by_edges(units: list[bytes], weights: np.ndarray, v: Vocabulary, scores: np.ndarray, unknown: float) -> tuple[np.ndarray, float]:
    """``expected_counts`` of units of any length, with logarithms."""
    codes, starts, stops, f, t, i, step = _lattice(units, v)
    cost = np.where(i >= 0, scores[i], unknown)

    def sums(source: np.ndarray, place: np.ndarray, edges: np.ndarray, distance: np.ndarray, total: np.ndarray) -> None:
        for lo, hi in _runs(distance):
            e = edges[lo:hi]
            reach = total[source[e]] + cost[e]
            group = np.flatnonzero(np.diff(place[e], prepend=-1))
            top = np.maximum.reduceat(reach, group)
            size = np.diff(np.append(group, hi - lo))
            total[place[e][group]] = top + np.log(np.add.reduceat(np.exp(reach - np.repeat(top, size)), group))

    ahead, behind = np.full(len(codes), -np.inf), np.full(len(codes), -np.inf)
    ahead[starts] = behind[stops] = 0.0
    sums(f, t, np.arange(len(f)), step, ahead)
    unit = np.searchsorted(stops, f)
    left = stops[unit] - f
    back = np.lexsort((t, f, left))
    sums(t, f, back, left[back], behind)
    known = i >= 0
    share = np.exp(ahead[f] + cost + behind[t] - ahead[stops[unit]]) * weights[unit]
    return np.bincount(i[known], share[known], len(scores)), float(weights @ ahead[stops])


def viterbi(units: list[bytes], v: Vocabulary) -> list[bytes]:
    """The piece ids (as 32-bit integers) on the best path of each unit; of equal paths the one whose last piece is longest, from the end on."""
    out = [b""] * len(units)

    def put(places: Sequence[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        blob, ends = ids.tobytes(), np.cumsum(4 * sizes).tolist()
        for k, lo, hi in zip(places, [0, *ends], ends, strict=False):
            out[k] = blob[lo:hi]

    rest = [k for k, u in enumerate(units) if len(u) > SHORT]
    short = [k for k, u in enumerate(units) if len(u) <= SHORT] if rest else range(len(units))
    for own, *table in _tables([units[k] for k in short] if rest else units, v):
        put([short[k] for k in own.tolist()] if rest else own.tolist(), *_best_in_table(*table, v))
    if rest:
        put(rest, *_best_by_edges([units[k] for k in rest], v))
    return out


def _best_in_table(raw: np.ndarray, edges: dict[int, tuple[np.ndarray, np.ndarray]], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``viterbi`` for units of one length (see ``_tables``): the ids of all in a row and how many each has."""
    length, n = raw.shape
    if not length:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    scores, ids = v.costs, np.full((len(edges), length * n), -1, np.int32)
    widths, tables = sorted(edges, reverse=True), []  # the longest first, which stays of equal ones
    for k, d in enumerate(widths):
        at, piece = edges[d]
        cost = np.full(length * n, -np.inf)
        cost[at], ids[k, at] = scores[piece], piece
        cost = cost.reshape(length, n)
        tables.append((k, d, cost, np.bincount(at // n, minlength=length) > 0))
    best, back = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int8)
    best[0] = 0.0
    for t in range(1, length + 1):
        for k, d, cost, some in tables:
            if d <= t and some[t - d]:
                reach = best[t - d] + cost[t - d]
                better = reach > best[t]
                np.copyto(best[t], reach, where=better)
                np.copyto(back[t], np.int8(k), where=better)
    # walk back from all ends at once
    wide, unit, place, trail = np.array(widths), np.arange(n), np.full(n, length), []
    while len(unit):
        k = back[place, unit]
        place = place - wide[k]
        trail.append((unit, place, wide[k], ids[k, place * n + unit]))
        live = place > 0
        unit, place = unit[live], place[live]
    unit, place, width, piece = (np.concatenate(x[::-1]) for x in zip(*trail, strict=True))
    order = np.argsort(unit, kind="stable")
    unit, piece = unit[order], piece[order]
    known = piece >= 0
    if known.all():
        return piece, np.bincount(unit, minlength=n)
    reps = np.where(known, 1, width[order])
    inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    out, bare, owner = np.repeat(piece, reps), ~np.repeat(known, reps), np.repeat(unit, reps)
    out[bare] = v.byte_ids[raw[(np.repeat(place[order], reps) + inner)[bare], owner[bare]]]
    return out, np.bincount(owner, minlength=n)


def _best_by_edges(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``viterbi`` for units of any length: the ids of all in a row and how many each has."""
    scores = np.array(v.scores)
    codes, starts, stops, f, t, i, step = _lattice(units, v)
    cost = np.where(i >= 0, scores[i], v.unknown_score)
    best, back = np.full(len(codes), -np.inf), np.full(len(codes), -1)
    best[starts] = 0.0
    for lo, hi in _runs(step):
        reach = best[f[lo:hi]] + cost[lo:hi]
        group = np.flatnonzero(np.diff(t[lo:hi], prepend=-1))
        top = np.maximum.reduceat(reach, group)
        size = np.diff(np.append(group, hi - lo))
        first = np.minimum.reduceat(np.where(reach == np.repeat(top, size), np.arange(hi - lo), hi - lo), group)
        place = t[lo:hi][group]
        best[place], back[place] = top, lo + first
    # walk back from all ends at once
    unit, place, trail = np.arange(len(units)), stops.copy(), []
    live = place > starts
    unit, place = unit[live], place[live]
    while len(unit):
        edge = back[place]
        trail.append((unit, edge))
        place = f[edge]
        live = place > starts[unit]
        unit, place = unit[live], place[live]
    if not trail:
        return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
    unit = np.concatenate([x[0] for x in trail])[::-1]
    edge = np.concatenate([x[1] for x in trail])[::-1]
    order = np.argsort(unit, kind="stable")
    unit, edge = unit[order], edge[order]
    raw = (codes - 1).astype(np.uint8)
    known = i[edge] >= 0
    reps = np.where(known, 1, t[edge] - f[edge])
    out = np.repeat(i[edge], reps).astype(np.int32)
    if not known.all():
        inner = np.arange(len(out)) - np.repeat(np.cumsum(reps) - reps, reps)
        bare = ~np.repeat(known, reps)
        out[bare] = v.byte_ids[raw[(np.repeat(f[edge], reps) + inner)[bare]]]
    return out, np.bincount(unit, weights=reps, minlength=len(units)).astype(np.int64)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CUT_BYTES each, at least one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return _runs(np.cumsum(sizes) // CUT_BYTES)


def cut(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(bytes of all texts in a row, each with a space ahead; where each begins among the units; the units): a null or empty text has none."""
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    raw = pc.if_else(pc.greater(pc.binary_length(raw), 0), pc.binary_join_element_wise(pa.scalar(b""), raw, pa.scalar(b" ")), raw)
    at = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    key = data[:-1].astype(np.uint16)
    key <<= 8
    key |= data[1:]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:-1] = v.apart[key] if len(data) else False
    begins[at] = True
    begins = np.flatnonzero(begins).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)])
    return data, np.searchsorted(begins, at), units.dictionary_encode()


def _distinct(units: pa.DictionaryArray) -> list[bytes]:
    """The distinct units."""
    words = units.dictionary
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    blob = (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [blob[lo:hi] for lo, hi in pairwise(at)]


def _searched(unit: bytes) -> list[bytes]:
    """The parts of a unit as they are searched, with markers for spaces; a marker in the text itself is a part of its own, empty."""
    mark = MARK.encode()
    if mark not in unit:
        return [unit.replace(b" ", mark)]
    return [x for part in unit.split(mark) for x in (b"", part.replace(b" ", mark))][1:]


class Encoder:
    """Encodes texts of one task; remembers the ids of up to REMEMBERED units, and of as many from before these, so that common units stay."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text; a null or empty text has none."""
        blobs = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary())
        ids, ends, _ = self.encode_all(blobs)
        return np.split(ids, ends[1:-1]) if texts else []

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(Piece ids of all texts in a row, where each text's begin and end, the texts' bytes as in ``cut``)."""
        data, begins, units = cut(texts, self.v)
        own = _distinct(units)
        new = [u for u in own if u not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = own
        held = [u for u in new if u in self.older]
        if held:
            self.known.update((u, self.older[u]) for u in held)
            new = [u for u in new if u not in self.older]
        spelt = self.v.byte_ids[list(MARK.encode())].tobytes()  # so that a marker in the text doesn't decode to a space
        for k in range(0, len(new), 40_000):
            part = new[k : k + 40_000]
            searched = [_searched(u) for u in part]
            found = iter(viterbi([x for own_parts in searched for x in own_parts if x], self.v))
            for u, own_parts in zip(part, searched, strict=True):
                if len(own_parts) == 1:
                    self.known[u] = next(found)
                else:  # parts and markers take turns
                    self.known[u] = b"".join(next(found) if x else spelt if i % 2 else b"" for i, x in enumerate(own_parts))
        whole = pa.array(list(map(self.known.__getitem__, own)), pa.binary()).take(units.indices)
        at = np.frombuffer(whole.buffers()[1], dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1] // 4
        ids = np.frombuffer(whole.buffers()[2] or b"", dtype=np.int32)[: at[-1]]
        return ids, at[begins].astype(np.int64), data


#: The encoder of the worker process, kept between tasks of one model.
_kept: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """The process's encoder of the model, with what it remembers from earlier tasks."""
    key = hash((tuple(v.pieces), tuple(v.scores)))
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(v)
    return _kept[key]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of piece ids: markers are spaces, byte pieces are bytes, and the leading space goes; stray bytes become U+FFFD."""
    blob, start, length = v.surface
    n = length[ids]
    if not n.sum():
        return ""
    place = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return blob[place].tobytes().decode("utf-8", "replace").removeprefix(" ")


def decodes(ids: np.ndarray, ends: np.ndarray, data: np.ndarray, texts: pa.Array, v: Vocabulary) -> np.ndarray:
    """Whether the ids of each text (see ``Encoder.encode_all``) decode to it: all are decoded in a row and compared by bytes, and one by one where these differ."""
    at, same = 0, True
    for lo in range(0, len(ids), COMPARED):
        part = v.surfaces.take(pa.array(ids[lo : lo + COMPARED]))
        own = np.frombuffer(part.buffers()[2] or b"", dtype=np.uint8)
        same = same and np.array_equal(own, data[at : at + len(own)])
        at += len(own)
    if same and at == len(data):
        # equal as a whole; a text is equal too if its pieces are as many bytes as it has
        _, _, length = v.surface
        sums = np.append(0, np.cumsum(length[ids]))[ends]
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if np.array_equal(np.diff(sums), sizes + (sizes > 0)):
            return np.ones(len(texts), dtype=bool)
    return np.array([decode(x, v) == (t or "") for x, t in zip(np.split(ids, ends[1:-1]), texts.to_pylist(), strict=True)], dtype=bool)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    v = Vocabulary(*read_model(path))
    v.trie, v.surface, v.byte_ids, v.unknown_score, v.apart  # noqa: B018  built once, on the driver
    return v


def unit_counts(df: DataFrame, v, text: str = "text") -> DataFrame:
    """(unit in UTF-8, n): how often each unit occurs in all texts; ``v`` is a broadcast vocabulary. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            held.clear()
            for k in range(0, len(rows), 20_000):
                units, n = zip(*rows[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(n, pa.int64())], names=["unit", "n"])

        for whole in batches:
            for lo, hi in _parts(whole.column("text")):
                units = cut(whole.column("text").slice(lo, hi - lo), v.value)[2]
                times = np.bincount(units.indices.to_numpy(zero_copy_only=False), minlength=len(units.dictionary)).tolist()
                for unit, k in zip(_distinct(units), times, strict=True):
                    for part in _searched(unit):
                        if part:
                            held[part] = held.get(part, 0) + k
                if len(held) > COUNTED:
                    yield from flush()
        yield from flush()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(df[text].alias("text")).mapInArrow(trimmed(run), "unit binary, n long")
    return written(rows.repartition(n, "unit").groupBy("unit").agg(F.sum("n").alias("n")))


def fit_scores(df: DataFrame, v: Vocabulary, text: str = "text") -> Vocabulary:
    """``v`` with the log probability of each piece in a unigram model of all texts of ``df``, by expectation maximisation.

    Units and their counts are one written table; a round is one Spark aggregate over all of it, of which the driver
    gets a row per piece. The scores are what the last round counts. Scores start equal and are rounded, so that they
    don't hang on the order of sums. Pieces that no text holds keep the share of START_COUNT occurrences. Without any
    text all scores stay equal.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(v)  # bounded by the vocabulary
    units = unit_counts(df, shared, text)
    pieces = np.array([k in (NORMAL, USER) and p != "" for p, k in zip(v.pieces, v.kinds, strict=True)])

    def scored(counts: np.ndarray) -> np.ndarray:
        share = counts[pieces] + START_COUNT
        scores = np.array(v.scores)
        scores[pieces] = np.round(np.log(share / share.sum()), 6)
        return scores

    def expected(counts: np.ndarray) -> tuple[np.ndarray, float]:
        """One round: the expected counts of all pieces in all units and their log likelihood."""
        scores = scored(counts)
        unknown = float(scores[pieces].min()) - UNKNOWN_PENALTY

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, likelihood = np.zeros(len(scores)), 0.0
            blobs, n, held = [], [], 0

            def add() -> None:
                nonlocal total, likelihood, held
                found, value = expected_counts(blobs, np.array(n, dtype=float), shared.value, scores, unknown)
                total, likelihood, held = total + found, likelihood + value, 0
                blobs.clear()
                n.clear()

            for batch in batches:
                if not batch.num_rows:
                    continue
                own, times = batch.column("unit").to_pylist(), batch.column("n").to_pylist()
                for lo, hi in _runs(np.cumsum([len(u) for u in own]) // FIT_BYTES):
                    blobs += own[lo:hi]
                    n += times[lo:hi]
                    held += sum(map(len, own[lo:hi]))
                    if held >= FIT_BYTES:
                        add()
            if blobs:
                add()
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], likelihood))], names=["piece", "n"])

        sums = {r.piece: r.n for r in units.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        likelihood = sums.pop(-1, 0.0)
        out = np.zeros(len(pieces))
        out[list(sums)] = list(sums.values())
        return out, likelihood

    counts, before = np.zeros(len(pieces)), None
    for _ in range(ROUNDS):
        counts, now = expected(counts)
        if not counts.any() or before is not None and now - before <= GAIN * abs(before):
            break
        before = now
    scores = scored(counts)
    out = Vocabulary(v.pieces, scores.tolist(), v.kinds)
    for name in ("trie", "surface", "byte_ids", "apart"):  # these don't depend on scores
        out.__dict__[name] = getattr(v, name)
    out.unknown_score  # noqa: B018
    shared.unpersist()
    return out


def write_vocabulary(spark: SparkSession, v: Vocabulary, path: str) -> None:
    """The vocabulary as a Parquet table (id, piece, score, kind)."""
    rows = list(zip(range(len(v.pieces)), v.pieces, v.scores, v.kinds, strict=True))
    spark.createDataFrame(rows, "id int, piece string, score double, kind int").coalesce(1).write.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    rows = spark.read.parquet(path).orderBy("id").collect()
    return Vocabulary([r.piece for r in rows], [r.score for r in rows], [r.kind for r in rows])


def encode_pieces(df: DataFrame, model: str = DEFAULT_MODEL, key: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """One row per row of ``df``: key, n_pieces, ids (array of int), exact (whether the ids decode to the text).

    Pieces get the scores that ``fit_scores`` finds on all of ``df``; the vocabulary with them is written to the
    folder ``keep`` (by default a new one under ``pieces`` in the shared folder). The best path is the one with the largest sum of scores; an uncovered character costs the worst score less 10 and
    is spelt in byte pieces. A null or empty text has no ids. Whole texts are encoded, whatever their length. Repeated
    rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    fitted = fit_scores(df, load(model), text)
    write_vocabulary(spark, fitted, keep or f"{shared_dir(spark)}/pieces/{uuid.uuid4().hex}")
    v = spark.sparkContext.broadcast(fitted)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(v.value)
        for whole in batches:
            for lo, hi in _parts(whole.column("text")):
                batch = whole.slice(lo, hi - lo)
                texts = batch.column("text")
                ids, ends, data = encoder.encode_all(texts)
                exact = decodes(ids, ends, data, texts, v.value)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(ends)), lists, pa.array(exact)], names=["key", "n_pieces", "ids", "exact"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    return rows.mapInArrow(trimmed(run), f"key {kind}, n_pieces long, ids array<int>, exact boolean").withColumnRenamed("key", key)


def decode_pieces(df: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of the ids as the column ``name``; null ids give null, ids outside the vocabulary an error."""
    v = df.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda x: None if x is None else decode(np.asarray(x, dtype=np.int64), v.value))

    return df.withColumn(name, run(df[ids]))
