"""N-gram Jaccard join by PartEnum signatures.

Arasu, Ganti & Kaushik, "Efficient Exact Set-Similarity Joins" (VLDB 2006). Documents are sets of hashed word
shingles. Sizes fall in bands; sets whose smaller one lies in a band and that are similar enough differ in at most k
elements there. The domain is cut into n1 parts of n2 subparts each; some part then holds at most k2 = k div n1 of the
differences, so the two sets agree on some n2 - k2 of its subparts. One signature per part and such choice of
subparts therefore meets every similar pair, and candidates are checked with their whole sets afterwards.

What moves: per distinct set one 64-bit id and its signatures, packed as arrays by hash range, about 6 bytes each. Equal
sets are one node. Each task sends one node per signature on and keeps a star for the others, so a signature that a third of
all documents share arrives once per task. Of a signature's few nodes all pairs are candidates; of many, a star.
Sketches of the sets, about a bit per shingle, rule out most candidates that are not similar before any text moves.
For the check a candidate's text moves once to each set it is compared with, first to one partner each, and further
only where that left both in different components. Where a star leaves members in different components, the cluster of
such signatures is cut in chunks; pairs of chunks are compared by sketches, and the texts of what is left as incidence
matrices, which give a star per linked group and never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, star_roots, written

#: Bands grow by this factor; wider bands mean fewer sets in two bands, narrower ones fewer signatures each.
BAND = 1.25
#: The fewest elements a signature should cover on average, where parameters allow.
LEAST_ELEMENTS = 4.0
#: Parts beyond what pigeonhole asks for, in bands of sets of SPARE_FROM elements or more.
SPARE, SPARE_FROM = 3, 32
#: Up to so many nodes of one signature become candidates pairwise.
FEW = 4
#: Sets and shingles in a chunk of a cluster that is compared in blocks, and shingles in a block of the comparison.
CHUNK, CHUNK_SHINGLES, COLUMNS = 1024, 4_000_000, 8192
#: Partners of a set that one slice compares; a set with more is sent to several slices.
SLICE = 1024
#: Signatures a hash range should hold at most.
BUCKET = 2_000_000
#: Bytes of a sketch in comparisons of whole chunks.
CHUNK_SKETCH = 512
#: Signatures a task packs at once, and sets whose signatures these are; places of sets take 16 bits.
FLUSH, MOST_NODES = 1_500_000, 30_000
#: Bits of the filter that picks the candidates' texts; 2 MB as a table, whatever the input.
FILTER_BITS = 1 << 23

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NULL_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            factors = (np.r_[np.ones(1, np.uint64), np.full(size - 1, p, dtype=np.uint64)] for p in (_P, _P_INV))
            self.up, self.down = (np.cumprod(f, dtype=np.uint64) for f in factors)
        return self.up, self.down


_powers = _Powers()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles of ``words`` words; all words as one if there are fewer; none without words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(starts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    word = _mix((total[ends] - total[starts]) * down[starts])
    width = min(n, words)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = _mix(out + word[j : n - width + 1 + j]) * np.uint64(_P)
    return np.unique(_mix(out))


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    """The index of the band that holds ``size``, from 0."""
    i = 0
    while bounds(i)[1] < size:
        i += 1
    return i


@lru_cache(maxsize=None)
def bounds(i: int) -> tuple[int, int]:
    """The least and greatest size in band ``i``."""
    low = 1 if i == 0 else bounds(i - 1)[1] + 1
    return low, max(low, int(low * BAND))


@lru_cache(maxsize=None)
def parameters(i: int, num: int, den: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for pairs whose smaller set lies in band ``i`` and whose similarity is num / den at least.

    One more part than pigeonhole asks for wherever SPARE allows, so that SPARE + 1 parts hold k2 differences or fewer.
    """
    low, high = bounds(i)
    k = high * den // num - high
    spare = SPARE if low >= SPARE_FROM else 0
    choices = []
    for k2 in range(min(k, 3) + 1):
        for n2 in range(k2 + 1, k2 + 4) if k2 else (1,):
            n1 = k // (k2 + 1) + 1 + spare
            choices.append((n1 * comb(n2, k2), low / n1 * (n2 - k2) / n2, (n1, n2, k2)))
    enough = [c for c in choices if c[1] >= LEAST_ELEMENTS]
    # without such a choice the one that covers most wins
    return min(enough)[2] if enough else max(choices, key=lambda c: (c[1], -c[0]))[2]


def signatures(elements: np.ndarray, num: int, den: int) -> np.ndarray:
    """The PartEnum signatures of a sorted set of hashes.

    A signature that covers no element says little and is shared by many sets. Of two similar sets SPARE + 1 parts
    agree on a signature; if one of the sets has such empty signatures in SPARE parts at most, a part without any
    remains, so only a set with more of those parts emits its empty signatures, and no pair is missed.
    """
    size = len(elements)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_mix(elements ^ np.uint64(_P)), out=sums[1:])
    out, i = [], band_of(size)
    while i >= 0 and (bounds(i)[1] >= size or size * num <= bounds(i)[1] * den):
        n1, n2, k2 = parameters(i, num, den)
        parts = n1 * n2
        # equal ranges of the hash domain are the subparts; sums of a range's hashes stand for its content
        cuts = np.array([(j << 64) // parts for j in range(1, parts)], dtype=np.uint64)
        at = np.concatenate([[0], np.searchsorted(elements, cuts), [size]])
        n = np.diff(at)
        content = _mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).reshape(n1, n2)
        # a choice of n2 - k2 subparts is empty if all are: possible where so many subparts of the part are
        sparse = (n.reshape(n1, n2) == 0).sum(axis=1) >= n2 - k2
        skip = bounds(i)[0] >= SPARE_FROM and int(sparse.sum()) <= SPARE
        tag = np.uint64((i + 1) * _P % (1 << 64)) + np.arange(n1, dtype=np.uint64) * _M1
        for c, chosen in enumerate(combinations(range(n2), n2 - k2)):
            h = tag + np.uint64(c)
            for j in chosen:
                h = _mix(h + content[:, j])
            h = _mix(h)
            out.append(h[n.reshape(n1, n2)[:, chosen].any(axis=1)] if skip else h)
        i -= 1
    return np.concatenate(out)


def signature_bound(size: int, num: int, den: int) -> int:
    """How many signatures a set of this size has at most."""
    n, i = 0, band_of(size) if size else -1
    while i >= 0 and (bounds(i)[1] >= size or size * num <= bounds(i)[1] * den):
        n1, n2, k2 = parameters(i, num, den)
        n, i = n + n1 * comb(n2, k2), i - 1
    return n


def parities(elements: np.ndarray) -> bytes:
    """For each of 2 ** k equal ranges of the hash domain, at least one per element, whether it holds an odd number of elements, as bits.

    Two sets differ in at least as many elements as these bits differ in places, which rules most false candidates out.
    """
    k = max(6, (len(elements) - 1).bit_length())
    odd = np.bincount((elements >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch in ``size`` bytes at most: the parities of ranges twice as wide are sums of two."""
    while len(sketch) > size:
        pairs = sketch ^ (sketch << np.uint8(1))  # the upper bit of each pair holds the pair's sum
        sketch = np.packbits(np.unpackbits(pairs)[::2])
    return sketch


def differing(one: bytes, two: bytes) -> int:
    """In how many places two sketches differ, in the ranges of the coarser one."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    if len(x) != len(y):
        size = min(len(x), len(y))
        x, y = folded(x, size), folded(y, size)
    return int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum())


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _node_of(elements: np.ndarray) -> int:
    """A set's id: one hash of all its elements."""
    h = _mix(np.array([len(elements)], dtype=np.uint64) + np.sum(_mix(elements), dtype=np.uint64))
    return int(h.view(np.int64)[0])


def _rows(words: int, num: int, den: int):
    """Documents to (id, text_key, size of the set, node, sketch, bound of its signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = lru_cache(maxsize=65536)(lambda n: signature_bound(n, num, den))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                sets = (shingles(text.as_py(), words) for text in batch.column("text"))
                n, node, sketch = zip(*((len(x), _node_of(x), parities(x)) for x in sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.array(list(map(bound, n)), pa.int64())],
                    names=["id", "text_key", "n", "node", "sketch", "signs"],
                )

    return run


def _local(node: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as a table of the distinct ones and 16-bit places in it."""
    distinct, place = np.unique(node, return_inverse=True)
    return distinct.tobytes(), place.astype(np.uint16).tobytes()


PACKED = ["bucket", "counts", "low", "nodes", "places", "starred", "star_signatures", "star_nodes", "star_places"]
PACKED_SCHEMA = "bucket int, " + ", ".join(f"{c} binary" for c in PACKED[1:])


def _pack(sig: np.ndarray, node: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures and their nodes as a row per bucket; a signature is kept as its bucket and 40 more bits, 8 of them as counts.

    Of a signature's many nodes only the first goes on to its bucket; a star keeps the others, in any bucket.
    """
    sig = (((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(40)) | (sig & np.uint64((1 << 40) - 1))
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(sig)))
    many = np.repeat(length > FEW, length)
    leader = np.repeat(node[start], length)
    star = many & ~first
    lead_sig, lead_node, starred = sig[~star], node[~star], many[~star]
    at = np.searchsorted(lead_sig, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(40))
    pieces = np.linspace(0, int(star.sum()), buckets + 1).astype(int)
    star_sig, star_pair = sig[star], np.stack([leader[star], node[star]], axis=1)
    rows = []
    for b in range(buckets):
        x, y = slice(at[b], at[b + 1]), slice(pieces[b], pieces[b + 1])
        if at[b] < at[b + 1] or pieces[b] < pieces[b + 1]:
            own = lead_sig[x]
            counts = np.bincount((own >> np.uint64(32)).astype(np.int64) & 255, minlength=256).astype(np.uint32)
            rows.append((b, counts.tobytes(), own.astype(np.uint32).tobytes(), *_local(lead_node[x]), np.packbits(starred[x]).tobytes(), star_sig[y].tobytes(), *_local(star_pair[y].ravel())))
    for k in range(0, len(rows), 16):
        b, *packed = zip(*rows[k : k + 16], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=PACKED)


def _signed(words: int, num: int, den: int, buckets: int):
    """Documents to packed signatures by hash range; a task holds FLUSH signatures of at most MOST_NODES sets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, nodes, held = [], [], 0
        for batch in batches:
            for text in batch.column("text"):
                elements = shingles(text.as_py(), words)
                node = _node_of(elements)
                if not len(elements) or node in seen:
                    continue
                seen.add(node)
                sigs.append(np.unique(signatures(elements, num, den)))
                nodes.append(node)
                held += len(sigs[-1])
                if held >= FLUSH or len(nodes) == MOST_NODES:
                    yield from _pack(np.concatenate(sigs), np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in sigs]), buckets)
                    sigs, nodes, held = [], [], 0
        if sigs:
            yield from _pack(np.concatenate(sigs), np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in sigs]), buckets)

    return run


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(signature, node, starred, star signature, star leader, star node) of a bucket's rows."""
    out: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.bool_, np.uint64, np.int64, np.int64)]
    for row in range(table.num_rows):
        raw = {c: table.column(c)[row].as_py() for c in PACKED}
        low = np.frombuffer(raw["low"], np.uint32).astype(np.uint64)
        sub = np.repeat(np.arange(256, dtype=np.uint64), np.frombuffer(raw["counts"], np.uint32))
        out[0].append(np.uint64(raw["bucket"] << 40) | (sub << np.uint64(32)) | low)
        out[1].append(np.frombuffer(raw["nodes"], np.int64)[np.frombuffer(raw["places"], np.uint16)])
        out[2].append(np.unpackbits(np.frombuffer(raw["starred"], np.uint8), count=len(low)).astype(np.bool_))
        out[3].append(np.frombuffer(raw["star_signatures"], np.uint64))
        ends = np.frombuffer(raw["star_nodes"], np.int64)[np.frombuffer(raw["star_places"], np.uint16)]
        out[4].append(ends[::2])
        out[5].append(ends[1::2])
    return tuple(np.concatenate(x) for x in out)


def _meet(table: pa.Table) -> pa.Table:
    """A hash range's packed signatures to candidates: (a, b, shared) of few nodes, (signature, a, b) of many with leader a."""
    sig, node, starred, star_sig, star_leader, star_node = _unpack(table)
    order = np.lexsort((node, sig))
    sig, node, starred = sig[order], node[order], starred[order]
    out_sig, out_a, out_b = [star_sig], [star_leader], [star_node]
    pair_a, pair_b = [], []
    if len(sig):
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        length = np.diff(np.append(start, len(sig)))
        large = (length > FEW) | np.logical_or.reduceat(starred, start)
        for size in range(2, FEW + 1):
            at = start[(length == size) & ~large]
            for i, j in combinations(range(size), 2):
                pair_a.append(node[at + i])
                pair_b.append(node[at + j])
        many = np.repeat(large, length)
        lead = np.repeat(node[start], length)
        inner = many & (lead != node)
        out_sig.append(sig[inner])
        out_a.append(lead[inner])
        out_b.append(node[inner])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pair_a, pair_b))
    (a, b), shared = np.unique(np.stack([a, b]), axis=1, return_counts=True) if len(a) else ((a, b), np.zeros(0, np.int64))
    s, x, y = np.concatenate(out_sig), np.concatenate(out_a), np.concatenate(out_b)
    return pa.table({
        "signature": pa.concat_arrays([pa.nulls(len(a), pa.int64()), _as_long(s)]),
        "a": pa.array(np.concatenate([a, x])), "b": pa.array(np.concatenate([b, y])),
        "shared": pa.array(np.concatenate([shared, np.ones(len(x), np.int64)]).astype(np.int64)),
    })


def _possible(num: int, den: int):
    """Pairs with sizes and sketches to those that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.add(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            apart = [differing(x.as_py(), y.as_py()) for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True)]
            keep = (num + den) * (both - np.array(apart, dtype=np.int64)) >= 2 * num * both
            yield batch.select(["a", "b", "shared"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(words: int, num: int, den: int):
    """Rows (center, node, text), each center's own row before its partners', to the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, None
        for batch in batches:
            a, b = [], []
            for x, y, text in zip(batch.column("center").to_pylist(), batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if x == y:
                    if x != center:
                        center, own = x, shingles(text.as_py(), words)
                    continue
                other = shingles(text.as_py(), words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and den * both >= num * (len(own) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that repeat an id and a text one per task."""
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), strict=True):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` (id, text_key and more) with the column marked: false for documents that are surely not in ``wanted`` (id, text_key), by a bit filter of fixed size."""
    bit = F.pmod(F.xxhash64("id", "text_key"), F.lit(FILTER_BITS))
    bits = wanted.select(bit.alias("bit")).distinct().groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("bits"))
    placed = docs.withColumn("bit", bit).withColumn("word", (F.col("bit") / 64).cast("int")).join(F.broadcast(bits), "word", "left")
    return placed.withColumn("marked", F.expr("coalesce(shiftrightunsigned(bits, int(bit % 64)) & 1 = 1, false)")).drop("bit", "word", "bits")


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node, id, text_key and more) with its texts: a fixed-size bit filter drops other documents before the shuffle.

    A row that the input repeats comes once per task that reads it.
    """
    kept = _marked(docs, wanted.select("id", "text_key")).where("marked")
    kept = kept.select("id", "text", "text_key").mapInArrow(_once, "id long, text string, text_key long")
    return kept.join(wanted, ["id", "text_key"]).drop("id", "text_key")


def _checked(docs: DataFrame, first: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough: each text of ``b`` moves to its ``a``, of which every slice of partners gets a copy."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    pairs = pairs.join(slices, "a").withColumn("slice", F.pmod(F.xxhash64("b"), F.col("slices")).cast("int"))
    asked = pairs.select(F.col("a").alias("center"), "slice", F.col("b").alias("node")).union(pairs.select("a", "slice", "a").distinct())
    asked = written(asked.join(first.select("node", "r.id", "r.text_key"), "node"))
    rows = _with_texts(docs, asked).withColumn("partner", F.expr("center <> node"))
    rows = rows.repartition("center", "slice").sortWithinPartitions("center", "slice", "partner").select("center", "node", "text")
    return written(rows.mapInArrow(_linked(words, num, den), "a long, b long"))


def _members(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    """(nodes, components, sizes, sketches) of a chunk."""
    nodes, components, sizes = (rows.field(c).to_numpy() for c in ("node", "component", "n"))
    return nodes, components, sizes, np.array([np.frombuffer(x, np.uint8) for x in rows.field("sketch").to_pylist()] + [None], dtype=object)[:-1]


def _near(left: tuple, right: tuple, num: int, den: int) -> np.ndarray:
    """For the members of two chunks which pairs of different components sizes and sketches do not rule out."""
    out = np.zeros((len(left[0]), len(right[0])), dtype=bool)
    widths = lambda side: {w: np.flatnonzero([len(x) == w for x in side[3]]) for w in {len(x) for x in side[3]}}
    for w, x in widths(left).items():
        for v, y in widths(right).items():
            size = min(v, w)
            a, b = (np.array([folded(side[3][i], size) for i in at]).view(np.uint64) for side, at in ((left, x), (right, y)))
            for k, word in zip(x, a, strict=True):
                both = left[2][k] + right[2][y]
                apart = np.maximum(np.bitwise_count(word ^ b).sum(axis=1), np.abs(left[2][k] - right[2][y]))
                out[k, y] = ((num + den) * (both - apart) >= 2 * num * both) & (left[1][k] != right[1][y])
    return out


def _survivors(num: int, den: int):
    """Pairs of chunks with sketches to their members (cluster, chunk_a, chunk_b, node, side) that are possibly similar to one of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = (_members(batch.column(c)[row].values) for c in ("left", "right"))
                possible = _near(left, right, num, den)
                a, b = left[0][possible.any(axis=1)], right[0][possible.any(axis=0)]
                n = len(a) + len(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[row].as_py()] * n, pa.int64()) for c in ("cluster", "chunk_a", "chunk_b")] + [pa.array(np.concatenate([a, b])), pa.array(np.arange(n) >= len(a))],
                    names=["cluster", "chunk_a", "chunk_b", "node", "side"],
                )

    return run


def _blocks(docs: DataFrame, first: DataFrame, parted: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within clusters, of (node, cluster, component): stars over what is linked in each pair of chunks.

    A chunk holds sets of one range of sizes, so that a set meets those of its own range and of the next ones only. A
    large component has chunks of its own, small ones share chunks; chunks of one component are not compared.
    """
    # a little more than the ratio of sizes of similar sets, so that rounding puts them one range apart at most
    level = F.floor(F.ln("n") / (1.001 * log(den / num) + 1e-9))
    rows = written(parted.join(first.select("node", "n", "sketch"), "node").mapInArrow(_narrow, "node long, cluster long, component long, n long, sketch binary").withColumn("level", level))
    sizes = rows.groupBy("cluster", "level", "component").agg(F.count("*").alias("count"), F.sum("n").alias("weight"))
    large = (F.col("count") >= CHUNK) | (F.col("weight") >= CHUNK_SHINGLES)
    parts = lambda count, weight: F.greatest(F.ceil(count / CHUNK), F.ceil(weight / CHUNK_SHINGLES))
    small = sizes.where(~large).groupBy("cluster", "level").agg(parts(F.sum("count"), F.sum("weight")).alias("shared"))
    place = F.when(large, F.xxhash64("component", F.pmod(F.xxhash64("node"), parts(F.col("count"), F.col("weight"))))).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    chunked = rows.join(sizes, ["cluster", "level", "component"]).join(small, ["cluster", "level"], "left").select(
        "cluster", "level", F.xxhash64("level", place).alias("chunk"), F.when(large, F.col("component")).alias("whole"), F.struct("node", "component", "n", "sketch").alias("row")
    )
    whole = written(chunked.groupBy("cluster", "level", "chunk", "whole").agg(F.collect_list("row").alias("rows")))
    side = lambda x, name: whole.select("cluster", "level", F.col("chunk").alias(f"chunk_{x}"), F.col("whole").alias(f"whole_{x}"), F.col("rows").alias(name))
    ahead = side("a", "left").withColumn("own", F.col("level")).withColumn("level", F.explode(F.array("level", F.col("level") + 1)))
    pairs = ahead.join(side("b", "right"), ["cluster", "level"]).where("(own < level OR chunk_a <= chunk_b) AND (whole_a IS NULL OR whole_b IS NULL OR whole_a <> whole_b)")
    found = written(pairs.select("cluster", "chunk_a", "chunk_b", "left", "right").mapInArrow(_survivors(num, den), "cluster long, chunk_a long, chunk_b long, node long, side boolean"))
    asked = written(found.join(first.select("node", "r.id", "r.text_key"), "node"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes = table.column("node").to_numpy()
        texts = table.column("text")
        (left, a), (right, b) = (([shingles(texts[i].as_py(), words) for i in np.flatnonzero(side == s)], nodes[side == s]) for s in (False, True))
        both = shared_counts(left, right)
        total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
        linked = (both > 0) & (den * both >= num * (total - both)) & (a[:, None] != b[None, :])
        roots = star_roots(linked, a, b, False)
        ends = [(root[root != own], own[root != own]) for own, root in zip((a, b), roots, strict=True)]
        return pa.table({"a": np.concatenate([x[0] for x in ends]), "b": np.concatenate([x[1] for x in ends])})

    return written(_with_texts(docs, asked).groupBy("cluster", "chunk_a", "chunk_b").applyInArrow(run, "a long, b long"))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with sketches of CHUNK_SKETCH bytes at most."""
    for batch in batches:
        sketches = [folded(np.frombuffer(s.as_py(), np.uint8), CHUNK_SKETCH).tobytes() for s in batch.column("sketch")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "cluster", "component", "n")), pa.array(sketches, pa.binary())], names=["node", "cluster", "component", "n", "sketch"])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The intersection sizes of all sets on the left with all on the right, by products of blocks of the incidence matrix."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    flat = lambda sets: (np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (x, row_x), (y, row_y) = flat(left), flat(right)
    values = np.intersect1d(x, y)
    for k in range(0, len(values), COLUMNS):
        block = values[k : k + COLUMNS]
        sides = []
        for v, row, n in ((x, row_x, len(left)), (y, row_y, len(right))):
            at = np.minimum(np.searchsorted(block, v), len(block) - 1)
            hit = block[at] == v
            side = np.zeros((n, len(block)), dtype=np.float32)
            side[row[hit], at[hit]] = 1.0
            sides.append(side)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def ngram_join(df: DataFrame, words: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id, node, text_key.

    A document's set holds its distinct shingles of ``words`` words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z); with
    fewer words the whole sequence is its one shingle; without words or with a null text it is empty and links with
    nothing. Documents link at den * intersection >= num * union, and every such pair is found. ``component_id`` is the
    smallest key reachable by links, itself included (null if all those keys are null); ``node`` identifies the set,
    so rows that repeat a text share it, and ``text_key`` is the text's hash. Shingles and sets are told apart by 64-bit hashes. ``buckets`` is the number
    of hash ranges (if not given, as many as shuffle partitions, or more where they would hold more than BUCKET signatures). An empty table gives an empty result; columns other
    than key and text are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(df[key].cast("long"), F.lit(NULL_ID)).alias("id"), df[text].alias("text"), F.xxhash64(df[text]).alias("text_key"))
    # texts are read twice, so that signatures, which outweigh them, are never written but as the shuffle's files
    rows = written(docs.mapInArrow(_rows(words, num, den), "id long, text_key long, n long, node long, sketch binary, signs long"))
    first = written(rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("signs").alias("signs")))
    signs = first.agg(F.sum("signs")).first()[0] or 0
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signs // BUCKET))
    met = written(
        docs.mapInArrow(_signed(words, num, den, n_buckets), PACKED_SCHEMA)
        .groupBy("bucket").applyInArrow(_meet, "signature long, a long, b long, shared long")
    )
    pairs = met.where("a <> b").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for x in "ab":
        pairs = pairs.join(first.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")), x)
    alike = F.expr(f"{num} * greatest(n_a, n_b) <= {den} * least(n_a, n_b)")
    candidates = written(pairs.where(alike).select("a", "b", "shared", "n_a", "n_b", "s_a", "s_b").mapInArrow(_possible(num, den), "a long, b long, shared long"))

    def linked(pairs: DataFrame) -> DataFrame:
        return _checked(docs, first, pairs.select("a", "b"), words, num, den)

    def parts(links: DataFrame) -> DataFrame:
        return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are not known to be connected."""
        a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")

    # first the partner that shares most signatures, then what is left
    ends = candidates.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max(F.struct("shared", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    best = written(best)
    links = linked(best)
    labels = parts(links)
    rest = written(apart(candidates.join(best, ["a", "b"], "left_anti"), labels).select("a", "b"))
    if not rest.isEmpty():
        links = links.union(linked(rest))
        labels = parts(links)
    # signatures of many nodes: members that a star left in different components are compared with each other, in blocks
    stars = met.where("signature IS NOT NULL")
    members = stars.select("signature", F.explode(F.array("a", "b")).alias("node")).distinct()
    placed = members.join(labels, "node", "left").select("signature", "node", F.coalesce("component", "node").alias("component"))
    split = written(placed.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("signature"))
    if not split.isEmpty():
        open_ = stars.join(split, "signature").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        clusters = connected_components(open_).withColumnRenamed("component", "cluster")
        parted = clusters.join(labels, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
        parted = written(parted)
        links = links.union(_blocks(docs, first, parted, words, num, den))
        labels = parts(links)
    named = labels.join(first.select("node", F.col("r.id").alias("id")), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    component = written(labels.join(least, "component").select("node", "least"))
    own = first.select("node", F.col("r.id").alias("own"))
    ids = written(own.join(component, "node", "left").select("node", F.coalesce("least", "own").alias("component_id")))
    out = rows.join(ids, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "node", "text_key")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), real("component_id").cast(df.schema[key].dataType).alias("component_id"), "node", "text_key")


def keep_one(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, with all its columns, that stand for their component: those whose key is its smallest.

    Rows that repeat a key and a set count once. Documents without words and rows without a key stay.
    """
    joined = ngram_join(df, words, num, den, key, text).where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    stands = joined.where(F.col(key) == F.col("component_id"))
    # a key may have several texts; of those in one component the one whose text hashes lowest stands for it
    chosen = stands.groupBy(key).agg(F.min("text_key").alias("chosen"))
    other = stands.join(chosen, key).where("text_key <> chosen")
    gone = written(joined.where(F.col(key) != F.col("component_id")).select(key, "text_key").union(other.select(key, "text_key")).distinct().toDF("__key", "__text"))
    again = written(stands.groupBy(key, "text_key").count().where("count > 1").select(key, "text_key").toDF("__key", "__text"))
    # texts of rows that neither names stay where they are; only the others move for the joins
    ids = {"id": F.col("__key").cast("long"), "text_key": F.col("__text")}
    rows = df.withColumns({"id": F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)), "text_key": F.xxhash64(text)})
    rows = _marked(rows, gone.union(again).select(*[c.alias(n) for n, c in ids.items()])).drop("id", "text_key")
    clear, named = (rows.where(c).select(*df.columns) for c in ("NOT marked", "marked"))
    same = lambda x: (named[key] == x["__key"]) & (F.xxhash64(named[text]) == x["__text"])
    stays = named.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return clear.unionByName(stays)
    repeated, single = (stays.join(again, same(again), how) for how in ("left_semi", "left_anti"))
    return clear.unionByName(single).unionByName(repeated.dropDuplicates([key, text]))
