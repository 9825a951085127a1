"""Queries for near-dedup of documents and embeddings and for line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import near_dedup
from tessera.llm.vector_dedup import vector_dedup


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, min_pct=80)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_REACH = """reach AS (
    SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id
), parts AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

OP1_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM words
), nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets), items AS (SELECT doc_id AS id, unnest(s) AS x FROM sets), pairs AS (
    SELECT p.id AS a, q.id AS b, count(*) AS c FROM items p JOIN items q ON p.x = q.x AND p.id <> q.id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), {_REACH}
SELECT nodes.id AS doc_id, n AS n_shingles, component_id, nodes.id = component_id AS kept FROM nodes JOIN parts ON nodes.id = parts.id
"""

OP4_SQL = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (
    SELECT p.id AS a, q.id AS b FROM nodes p JOIN nodes q ON p.id <> q.id AND list_cosine_similarity(p.e, q.e) >= 0.95
), {_REACH}
SELECT nodes.id AS vec_id, (SELECT count(*) FROM links WHERE a = nodes.id) AS n_links, component_id, nodes.id = component_id AS kept FROM nodes JOIN parts ON nodes.id = parts.id
"""

OP5_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
    FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op4_vector_dedup": op4_vector_dedup, "op5_line_dedup": op5_line_dedup}
SQL: dict[str, str] = {"op1_minhash_dedup": OP1_SQL, "op4_vector_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL}
