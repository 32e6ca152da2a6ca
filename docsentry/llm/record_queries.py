"""Queries of the sharding and secret-scan operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import secrets_scan, sharding
from .common import query, read

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _sharding_sql() -> str:
    table = ",".join(map(str, sharding.fill_table(SHARDS)))
    return f"""
WITH slots AS (
  SELECT doc_id, coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '~') AS k FROM documents),
placed AS (
  SELECT doc_id, CAST('0x' || substr(md5(k), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM slots),
filled AS (
  SELECT unnest(range(0, {sharding.TABLE_SIZE})) AS filled_slot, unnest(string_split('{table}', ',')) AS shard)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(shard AS INTEGER) AS shard_id FROM placed JOIN filled ON slot = filled_slot
"""


@query("op1_sharding", _sharding_sql())
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its slot and its shard of 64."""
    return sharding.assign(read(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def _secrets_sql() -> str:
    quote = lambda s: s.replace("'", "''")
    hits = []
    patterns = (secrets_scan.ASSIGN, secrets_scan.ACCESS, secrets_scan.HEX, secrets_scan.CANDIDATE)
    for kind, pattern in enumerate(patterns):
        p = quote(pattern)
        hits.append(f"""
  SELECT doc_id, {kind} AS kind, unnest(m) AS hit, unnest(range(1, len(m) + 1)) AS i, m, g FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM docs)""")
    classes = " ".join(
        f"WHEN regexp_full_match(hit, '[{c.alphabet}]+') THEN {c.threshold}" for c in secrets_scan.CLASSES
    )
    allowed = " OR ".join(f"regexp_matches(hit, '{p}')" for p in secrets_scan.ALLOW)
    w = secrets_scan.WINDOW
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(hits)}),
placed AS (
  SELECT doc_id, kind, hit,
         CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM hits),
kept AS (
  SELECT doc_id, kind, s, s + length(hit) AS e FROM placed
  WHERE (kind = 0 AND length(regexp_extract(hit, '[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6)
     OR kind IN (1, 2)
     OR (kind = 3 AND NOT ({allowed})
         AND list_max(list_transform(range(1, length(hit) - {w} + 2), lambda j: list_aggregate(string_split(hit[j:j + {w} - 1], ''), 'entropy')))
             >= CASE {classes} END)),
found AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' END || ':' || s || ':' || e, ',' ORDER BY s, kind)
           FILTER (kind < 3) AS base,
         string_agg(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN found USING (doc_id)
"""


@query("op7_secret_scan", _secrets_sql())
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secret spans."""
    return secrets_scan.scan(read(spark, sf_dir, "documents"))
