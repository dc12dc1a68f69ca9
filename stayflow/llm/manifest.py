"""Merkle manifest of a data set: a postorder append log of node digests, from which proofs of single rows are cut.

Rows are leaves. The rows of a group (a language, say) make a tree in which every ``FAN`` consecutive nodes become
their hash until one is left; the groups' roots, in the order of the groups, make the tree whose root stands for the
table. A tree is cut into aligned subtrees of ``FAN ** levels`` leaves. A builder per subtree takes its leaves in order and
appends every node when it is complete, so a log segment is the subtree in postorder, and a node's place in it follows
from the sizes of the subtrees before it (``position``); no node stores an address. The segments' last nodes are the
leaves of the next round of builders, so rounds grow with the logarithm of the rows and no task sees more than
those leaves. Proofs go down the same way: a segment gets its own path once and finds all siblings below by ``position``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_row_number, written

#: Nodes that become one, and levels of a builder's subtree.
FAN, LEVELS = 8, 3
#: The number of the tree over the groups' roots.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash_of(*parts: str) -> str:
    """Lower-case hex of the SHA-256 of the parts one after another."""
    return sha256("".join(parts).encode()).hexdigest()


def depth(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def position(level: int, index: int, leaves: int, levels: int) -> int:
    """The place from 0, in postorder, of the node ``index`` of a level, in a subtree of ``leaves`` leaves and ``levels`` levels above them.

    Before a node come all lower nodes up to the end of its own range, those left of it, and those higher ones whose
    range ends where its own begins.
    """
    end = min((index + 1) * FAN**level, leaves)
    below = sum(-(-end // FAN**k) for k in range(level))
    return below + index + sum(index // FAN ** (k - level) for k in range(level + 1, levels + 1))


def append_log(leaves: Sequence[str], levels: int) -> list[str]:
    """The subtree's digests in the order of their completion; the last one is its root."""
    log: list[str] = []
    runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def put(level: int, digest: str) -> None:
        log.append(digest)
        if level < levels:
            runs[level].append(digest)
            if len(runs[level]) == FAN:
                close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        put(level + 1, hash_of(*run))

    for leaf in leaves:
        put(0, leaf)
    for level in range(levels):
        if runs[level]:
            close(level)
    return log


def siblings(log: Sequence[str], index: int, leaves: int, levels: int) -> tuple[list[str], list[str]]:
    """Per level of a segment, from the leaf ``index`` up: the digests left of the leaf's ancestor in its run, and right of it, each joined."""
    before, after = [], []
    for level in range(levels):
        own = index // FAN**level
        first, last = own // FAN * FAN, min(own // FAN * FAN + FAN, -(-leaves // FAN**level))
        before.append("".join(log[position(level, k, leaves, levels)] for k in range(first, own)))
        after.append("".join(log[position(level, k, leaves, levels)] for k in range(own + 1, last)))
    return before, after


def fold(digest: str, before: Sequence[str], after: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in zip(before, after, strict=True):
        digest = hash_of(left, digest, right)
    return digest


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The hash of the values: ``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass(frozen=True)
class Manifest:
    """rows: (tree, place, total, leaf, kept columns); logs: per round the segments (tree, block, leaves, levels, log) of the groups' trees, and those of the tree over them; roots: (tree, subroot)."""

    rows: DataFrame
    logs: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame
    levels: int


SEGMENT = "tree long, block long, total long, leaves int, levels int, log array<string>"


def build_logs(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Per round the log segments of the trees whose leaves are ``nodes`` (tree, place, total, digest)."""
    span = FAN**levels

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        total = int(own["total"].iloc[0])
        high = levels if total > span else depth(total)
        return pd.DataFrame({"tree": own["tree"].iloc[:1].to_list(), "block": own["block"].iloc[:1].to_list(), "total": [total], "leaves": [len(own)], "levels": [high], "log": [append_log(own["digest"].tolist(), high)]})

    logs = []
    while True:
        keyed = nodes.select("tree", F.expr(f"place div {span}").alias("block"), "place", "total", "digest")
        logs.append(written(keyed.groupBy("tree", "block").applyInPandas(build, SEGMENT)))
        left = logs[-1].where(F.col("total") > span)
        if left.isEmpty():
            return logs
        nodes = left.select("tree", F.col("block").alias("place"), F.ceil(F.col("total") / span).alias("total"), F.element_at("log", -1).alias("digest"))


def _roots(logs: Sequence[DataFrame], span: int) -> DataFrame:
    out = None
    for log in logs:
        done = log.where(F.col("total") <= span).select("tree", F.element_at("log", -1).alias("subroot"))
        out = done if out is None else out.unionByName(done)
    return out


def build_manifest(df: DataFrame, columns: Sequence[str], key: str, group: str, keep: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The log of ``df``, whose leaves hash ``columns``: a tree per value of ``group`` with leaves by ascending ``key``, and the tree over them by ascending group (null first).

    Rows of equal key follow their digests, null keys come first; equal rows are interchangeable. ``keep`` names further
    columns (besides key and group) that the rows carry. An empty table has no trees.
    """
    kept = {key: F.col(key), "__group": F.col(group), "leaf": leaf_digest([F.col(c) for c in columns]), **(keep or {})}
    rows = written(df.select(*[c.alias(n) for n, c in kept.items()]))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["__group", key, "leaf"]
    placed = written(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # a row per partition and group in it
    counts = placed.groupBy("__part", "__group").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    trees = global_row_number(counts.select(F.col("__group").alias("__g")).distinct(), ["__g"], "tree")
    upto = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(trees, F.col("__group").eqNullSafe(F.col("__g"))).select(
        F.col("__part").alias("__p"), "__g", "tree", "__first", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("tree")).alias("total"),
    )
    joined = placed.join(counts, (F.col("__part") == F.col("__p")) & F.col("__group").eqNullSafe(F.col("__g")))
    rows = written(joined.select("tree", (F.col("__before") + F.col("__seq") - F.col("__first")).alias("place"), "total", key, "leaf", *(keep or {})))
    logs = build_logs(rows.select("tree", "place", "total", F.col("leaf").alias("digest")), levels)
    roots = written(_roots(logs, FAN**levels))
    groups = roots.count()
    top = build_logs(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(groups).cast("long").alias("total"), F.col("subroot").alias("digest")), levels)
    return Manifest(rows, logs, top, roots, levels)


PATH = "tree long, place long, before array<string>, after array<string>, subroot string, root string"


def _located(logs: Sequence[DataFrame], ends: DataFrame, span: int, leaves: bool = False) -> DataFrame:
    """The segments of the first round with their paths, or the paths of their leaves: ``ends`` (tree, before, after, subroot, root) has those of the trees' roots."""

    def below(pieces):
        for frame in pieces:
            out = []
            for s in frame.itertuples(index=False):
                for i in range(s.leaves):
                    before, after = siblings(s.log, i, s.leaves, s.levels)
                    out.append((s.tree, s.block * span + i, before + list(s.before), after + list(s.after), s.subroot, s.root))
            yield pd.DataFrame(out, columns=["tree", "place", "before", "after", "subroot", "root"])

    paths = None
    for log in reversed(logs):
        last = ends.join(log.where(F.col("total") <= span).select("tree", "block"), "tree").select("tree", F.col("block").alias("place"), "before", "after", "subroot", "root")
        paths = last if paths is None else paths.unionByName(last)
        located = log.join(paths.withColumnRenamed("place", "block"), ["tree", "block"])
        if leaves or log is not logs[0]:
            paths = written(located.mapInPandas(below, PATH))
    return paths if leaves else located


def prove(manifest: Manifest, key: str, shown: str) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256 (of its siblings' digests, from the leaf up), folded_root and verified.

    The fold starts from the digest in the kept column ``shown``, as someone would who holds the row and its proof.
    """
    none = F.array().cast("array<string>")
    span = FAN**manifest.levels
    peak = _roots(manifest.top, span).select("tree", none.alias("before"), none.alias("after"), F.col("subroot"), F.col("subroot").alias("root"))
    over = _located(manifest.top, peak, span, leaves=True).select(F.col("place").alias("tree"), "before", "after", "root")
    ends = written(over.join(manifest.roots, "tree"))
    segments = _located(manifest.logs, ends, span).select("tree", "block", "leaves", "levels", "log", "before", "after", "subroot", "root")
    rows = manifest.rows.select("tree", F.expr(f"place div {span}").alias("block"), "place", F.col(key).cast("string").alias("key"), "leaf", F.col(shown).alias("shown"))

    def prove_block(_, own: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s = segment.iloc[0]
        out = []
        for place, k, leaf, digest in zip(own["place"], own["key"], own["leaf"], own["shown"], strict=True):
            before, after = siblings(s["log"], place % span, s["leaves"], s["levels"])
            before, after = before + list(s["before"]), after + list(s["after"])
            folded = fold(digest, before, after)
            out.append((k, leaf, s["subroot"], s["root"], hash_of(*[x for pair in zip(before, after, strict=True) for x in pair]), folded, folded == s["root"]))
        return pd.DataFrame(out, columns=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    # keys travel as text, since pandas would turn numbers beside a null into floats
    proven = rows.groupBy("tree", "block").cogroup(segments.groupBy("tree", "block")).applyInPandas(prove_block, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proven.select(F.col("key").cast(manifest.rows.schema[key].dataType).alias(key), *proven.columns[1:])


def document_manifest(df: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """The proofs of all rows of ``df``, each folded from the row as it is, but for tampered ones: where 3 divides the CRC-32 of the key as text, A-Z of the text are lower-cased.

    One row per row of ``df``, repeated ones included. A null in any column has a digest of its own; a null key is first
    and untouched; a row without text can't be tampered with, so it is verified. Other columns are not read; an empty
    table gives an empty result.
    """
    tampered = leaf_digest([F.translate(F.col(c), UPPER, LOWER) if c == text else F.col(c) for c in columns])
    shown = F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, tampered).otherwise(leaf_digest([F.col(c) for c in columns]))
    return prove(build_manifest(df, columns, key, group, {"shown": shown}, levels), key, "shown")
