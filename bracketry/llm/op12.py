"""Query of conversation repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .dialogue import damage, repair


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair(damage(table(spark, sf_dir, "conversations")))
    written = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return fixed.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(written.cast("binary"), 256).alias("repaired_sha256"))


#: The same rows from DuckDB: one step of the recursion is one turn of every conversation.
SQL = r"""
WITH RECURSIVE cell AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), fate AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS f
  FROM cell
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fate)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS repeated,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair
  FROM placed
), flagged AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS r, pos > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au') AS illegal,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN repeated THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM again
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM flagged GROUP BY conv_id
), priced AS (
  SELECT conv_id, pos, r, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stays FROM flagged
), fold AS (
  SELECT conv_id, 0::BIGINT AS pos, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 1000000000::BIGINT, 'a': ''} AS s, {'c': 3::BIGINT, 'a': 'I'} AS u, {'c': 6::BIGINT, 'a': 'II'} AS v
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, n, s, u, list_min([v, {'c': u.c + 3, 'a': u.a || 'I'}]) FROM (
    SELECT conv_id, pos, n, s, v, list_min([u, {'c': b.c + 3, 'a': b.a || 'I'}]) AS u FROM (
      SELECT *, list_min([n, s, v]) AS b FROM (
        SELECT conv_id, pos, {'c': n.c + 4, 'a': n.a || 'D'} AS n,
               list_min([{'c': s.c + 4, 'a': s.a || 'D'}, {'c': n.c + stays + CASE r WHEN 's' THEN 0 ELSE 1000000000 END, 'a': n.a || 'K'}]) AS s,
               list_min([{'c': u.c + 4, 'a': u.a || 'D'}, {'c': b.c + stays + CASE r WHEN 'u' THEN 0 ELSE 3 END, 'a': b.a || CASE r WHEN 'u' THEN 'K' ELSE 'R' END}]) AS u,
               list_min([{'c': v.c + 4, 'a': v.a || 'D'}, {'c': u.c + stays + CASE r WHEN 'a' THEN 0 ELSE 3 END, 'a': u.a || CASE r WHEN 'a' THEN 'K' ELSE 'R' END}]) AS v
        FROM (SELECT p.conv_id, p.pos, p.r, p.stays, n, s, u, v, list_min([n, s, v]) AS b
              FROM fold JOIN priced p ON p.conv_id IS NOT DISTINCT FROM fold.conv_id AND p.pos = fold.pos + 1))))
), best AS (
  SELECT conv_id, b.c AS cost, b.a AS audit FROM (
    SELECT f.conv_id, list_min([f.n, f.v]) AS b FROM fold f LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.pos = coalesce(sums.n, 0))
), letters AS (
  SELECT conv_id, i, audit[i] AS edit, length(replace(audit[:i], 'I', '')) AS pos FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)
), left_over AS (
  SELECT l.conv_id, l.edit, CASE l.edit WHEN 'I' THEN '' ELSE f.text END AS text, f.role, row_number() OVER w - 1 AS i,
         first_value(CASE WHEN l.edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER w AS ahead
  FROM letters l LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.pos = l.pos AND l.edit <> 'I' WHERE l.edit <> 'D'
  WINDOW w AS (PARTITION BY l.conv_id ORDER BY l.i)
), written AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (i - ahead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t
  FROM left_over GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best b LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""
