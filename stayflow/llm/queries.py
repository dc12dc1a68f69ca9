"""The numbered queries: each applies its operator to its whole table and shapes the result as the contract states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_documents
from .ann import nearest
from .language import identify_languages
from .licenses import scan_licenses
from .manifest import document_manifest
from .mixing import mix_sources
from .ngram_join import ngram_join
from .page_text import extract_text
from .pieces import encode_pieces
from .quality import score_documents
from .sharding import assign_shards
from .vector_dedup import near_vectors
from .warc import archive_folder, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), 40)


def op3_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, 20)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    listing = write_warc(_table(spark, sf_dir, "pages"), folder, 0)
    return read_warc(spark, folder, listing, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), (1, 2, 3), 3).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "repeats")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op11_byte_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_license_scan, op2_feistel_shards, op3_hamming_search, op4_ngram_join, op5_warc_archives, op6_source_mix, op7_page_text, op8_piece_encoding, op9_quality, op10_vector_dedup,
        op11_byte_language, op12_merkle_manifest, op13_token_alignment,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_join": OP4_SQL, "op6_source_mix": OP6_SQL, "op12_merkle_manifest": _merkle_sql()}


#: All pairs that share a shingle; the fixpoint takes the smallest document of each component.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 90 * (na.n + nb.n - i)
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::INT AS bucket
  FROM documents
), s AS (
  SELECT source, source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), o AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE AS total,
    coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS capped, (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max(CASE WHEN (total - capped) / left_weight <= 3.0::DOUBLE * source_size / weight THEN (total - capped) / left_weight END) AS level FROM o
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target,
    CASE WHEN source_size > 0 THEN least(3.0::DOUBLE * source_size, weight * level) / source_size ELSE 0 END AS epochs
  FROM s, level
), b AS (
  SELECT source, bucket, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto, words
  FROM (SELECT source, bucket, sum(size) AS words FROM d GROUP BY source, bucket)
), c AS (
  SELECT t.source, max(bucket) AS cut FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
  WHERE (epochs - floor(epochs)) * source_size > 0
    AND upto - (epochs - floor(epochs)) * source_size <= (epochs - floor(epochs)) * source_size - (upto - words)
  GROUP BY t.source
)
SELECT doc_id, size, t.source_size, t.target, size * (floor(epochs)::INT + CASE WHEN bucket <= coalesce(cut, -1) THEN 1 ELSE 0 END) AS taken,
  d.source, epochs, floor(epochs)::INT + CASE WHEN bucket <= coalesce(cut, -1) THEN 1 ELSE 0 END AS repeats
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


def _merkle_sql(levels: int = 8) -> str:
    """The tree built level by level, for groups of up to 8 ** levels rows; paths are joined from the levels."""
    step = "SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM "
    table = "(SELECT range AS i, range AS c FROM range(256))"
    for _ in range(8):
        table = f"({step}{table})"
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"

    def tree(name: str, start: str) -> str:
        """CTEs name0, name1, ...: (tree, i, h, n), a level each; nodes of trees that are done stay out of the next."""
        out = [f"{name}0 AS ({start})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} AS (SELECT tree, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 8)")
        return ", ".join(out)

    def siblings(name: str) -> str:
        """Per level and node the digests left and right of it in its run; none of a node that is alone in its tree."""
        w = "PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        return " UNION ALL ".join(
            f"SELECT {k} AS k, tree, i, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1" for k in range(levels)
        )

    joins, proof = [], []
    for name, own, at in (("s", "tree", "place"), ("t", "zero", "tree")):
        for k in range(levels):
            a = f"{name}x{k}"
            joins.append(f"LEFT JOIN {name}s {a} ON {a}.k = {k} AND {a}.tree = d.{own} AND {a}.i = d.{at} // {8**k}")
            proof.append(f"coalesce({a}.l || {a}.r, '')")
    sides = ", ".join(f"{n}x{k}.l AS {n}l{k}, {n}x{k}.r AS {n}r{k}" for n in "st" for k in range(levels))
    last, chain = "f0", []
    for j, (n, k) in enumerate([(n, k) for n in "st" for k in range(levels)]):
        chain.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN {n}l{k} IS NULL THEN g ELSE sha256({n}l{k} || g || {n}r{k}) END AS g) FROM {last})")
        last = f"f{j + 1}"
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM {table}), d0 AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
    xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[xor(c & 255, b) + 1], c // 256)), 4294967295) AS crc
  FROM documents, crc
), d AS (
  SELECT doc_id, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS shown, 0 AS zero, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d0
), {tree('s', 'SELECT tree, place AS i, leaf AS h, n FROM d')}, roots AS ({' UNION ALL '.join(f'SELECT tree, h FROM s{k} WHERE n = 1' for k in range(levels + 1))}),
{tree('t', 'SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM roots')}, top AS ({' UNION ALL '.join(f'SELECT h FROM t{k} WHERE n = 1' for k in range(levels + 1))}),
ss AS ({siblings('s')}), ts AS ({siblings('t')}), f0 AS (
  SELECT d.doc_id, leaf, roots.h AS subroot, top.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, shown AS g, {sides}
  FROM d JOIN roots ON roots.tree = d.tree, top {' '.join(joins)}
), {', '.join(chain)}
SELECT doc_id, leaf, subroot, root, proof_sha256, g AS folded_root, g = root AS verified FROM {last}
"""
