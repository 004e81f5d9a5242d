"""Queries of names in running text: people and titles out of `benchmark`, linked in every whole text of `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking
from .base import table
from .registry import query

#: Two words that begin an item are a person (kind 0); its first sentence and its first three words are titles (kind 1).
TWO, SENTENCE, THREE = r"^([A-Za-z]+ [A-Za-z]+)", r"^([^.]*)\.", r"^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)"


def _aliases(spark, sf):
    item = table(spark, sf, "benchmark").select(F.col("item_id").alias("target_id"), F.coalesce("text", F.lit("")).alias("t"))
    at = lambda p: F.regexp_extract("t", p, 1)
    people = item.select(F.lit(0).alias("kind"), "target_id", linking.person_names(at(TWO)).alias("names"))
    titles = item.select(F.lit(1).alias("kind"), "target_id", linking.title_names(at(SENTENCE), at(THREE)).alias("names"))
    return linking.alias_table(people.unionByName(titles))


LINKS = rf"""
WITH item AS (
  SELECT item_id, regexp_extract(t, '{TWO}', 1) AS two, regexp_extract(t, '{SENTENCE}', 1) AS sentence, regexp_extract(t, '{THREE}', 1) AS three
  FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)
), named AS (
  SELECT 0 AS kind, item_id, 0 AS place, two AS alias FROM item
  UNION ALL SELECT 0, item_id, 1, string_split(two, ' ')[2] FROM item WHERE length(string_split(two, ' ')[2]) >= 4
  UNION ALL SELECT 1, item_id, 0, trim(sentence) FROM item WHERE length(trim(sentence)) >= 5
  UNION ALL SELECT 1, item_id, CASE WHEN length(trim(sentence)) >= 5 THEN 1 ELSE 0 END, three FROM item WHERE length(three) >= 5
), alias AS (
  SELECT kind, CAST(item_id AS VARCHAR) AS target_id, place, alias, row_number() OVER (PARTITION BY kind, lower(alias) ORDER BY CAST(item_id AS VARCHAR), place) AS k
  FROM named WHERE regexp_matches(alias, '[A-Za-z0-9_]')
), hit AS (
  SELECT d.doc_id, a.kind, a.target_id, a.place, a.alias, length(regexp_extract(d.text, '(?is)^(.*?)\b' || regexp_escape(a.alias) || '\b', 1)) AS start
  FROM documents d JOIN alias a ON k = 1 AND contains(lower(d.text), lower(a.alias)) AND regexp_matches(d.text, '(?is)\b' || regexp_escape(a.alias) || '\b')
), listed AS (
  SELECT doc_id, list([{{'s': start, 'e': start + length(alias), 'k': kind, 't': target_id, 'a': alias}}] ORDER BY length(alias) DESC, kind, target_id, place) AS hits
  FROM hit GROUP BY doc_id
), chosen AS (
  SELECT doc_id, unnest(list_reduce(hits, lambda c, x: CASE WHEN len(list_filter(c, lambda y: (y.k = x[1].k AND y.t = x[1].t) OR (y.s < x[1].e AND y.e > x[1].s))) > 0
                                    THEN c ELSE list_concat(c, x) END)) AS z FROM listed
), span AS (
  SELECT doc_id, CAST(z.s AS INTEGER) AS start_at, CAST(z.e AS INTEGER) AS end_at, z.k AS kind, z.t AS target_id, z.a AS alias FROM chosen
)"""


@query(f"{LINKS} SELECT * FROM span")
def q_span_links(spark, sf):
    """Every link of every text: longest alias first, first place alone, one link a target, none over another."""
    d = linking.link_spans(table(spark, sf, "documents").select("doc_id", "text"), _aliases(spark, sf))
    return d.select("doc_id", F.inline("spans")).withColumnsRenamed({"start": "start_at", "end": "end_at"})


@query(f"""{LINKS} SELECT d.doc_id, CAST(count(span.doc_id) AS INTEGER) AS n_links, CAST(count(span.doc_id) + count(*) FILTER (start_at > behind) + any_value(CASE WHEN length(text) > coalesce(last, 0) THEN 1 ELSE 0 END) AS INTEGER) AS n_pieces
FROM documents d LEFT JOIN (SELECT *, coalesce(lag(end_at) OVER (PARTITION BY doc_id ORDER BY start_at), 0) AS behind, max(end_at) OVER (PARTITION BY doc_id) AS last FROM span) span ON span.doc_id = d.doc_id GROUP BY d.doc_id""")
def q_linked_pieces(spark, sf):
    """Texts cut into linked and plain pieces, which give the text again."""
    d = linking.link_spans(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), _aliases(spark, sf))
    pieces = linking.segments(F.col("text"), F.col("spans"))
    return d.select("doc_id", F.size("spans").alias("n_links"), F.size(pieces).alias("n_pieces"))


@query(f"{LINKS} SELECT kind, target_id, count(*) AS n_texts, count(DISTINCT lower(alias)) AS n_aliases FROM span GROUP BY kind, target_id")
def q_mention_counts(spark, sf):
    """How many texts link to a target, by how many of its aliases."""
    return linking.mention_counts(linking.link_spans(table(spark, sf, "documents").select("text"), _aliases(spark, sf)))
