"""Queries of the operators that are made of built-in expressions, with SQL."""

from pyspark.sql import functions as F

from placelens.llm.chat_format import rotate_perspectives
from placelens.llm.line_dedup import dedup_lines
from placelens.llm.registry import query, table
from placelens.llm.sharding import shard_rows

LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_SQL)
def line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


@query("op9_rendezvous_sharding")
def rendezvous_sharding(spark, sf_dir):
    """Law ``key``: 8 shards of equal weight, and 9 after one more is added."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_rows(rows, "doc_id", [1.0] * 8, [1.0] * 9)


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS seq FROM t
), people AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), sides AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM placed JOIN people ON conv_id IS NOT DISTINCT FROM c
), shown AS (
  SELECT *, '<|im_start|>' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10)
      || text || '<|im_end|>' || chr(10) AS rendered,
    CASE WHEN chat_role = 'assistant' THEN length(text) + 11 ELSE 0 END AS target_chars
  FROM sides
)
SELECT conv_id, perspective, turn, seq, chat_role, speaker, rendered,
  CAST(length(rendered) - target_chars AS BIGINT) AS masked_chars, CAST(target_chars AS BIGINT) AS target_chars,
  CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM shown
"""


@query("op10_perspective_rotation", CHAT_SQL)
def perspective_rotation(spark, sf_dir):
    return rotate_perspectives(table(spark, sf_dir, "conversations"))
