"""Text and page queries: similarity of names, folding, parsing, links, mentions and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import table
from .registry import query

FOLD = f"trim(regexp_replace(translate(lower({{0}}), '{T.MARKED}', '{T.PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SHARED = "round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6)"


@query(f"""
WITH g AS (SELECT p_partkey, {GRAMS.format(FOLD.format("p_name || ' ' || p_type"))} AS a, {GRAMS.format("'small rings promo'")} AS b FROM part)
SELECT p_partkey, {SHARED} AS similarity FROM g WHERE {SHARED} > 0.3""")
def q_trigram_similarity(spark, sf):
    s = T.trigram_similarity(F.concat_ws(" ", "p_name", "p_type"), F.lit("small rings promo"))
    return table(spark, sf, "part").select("p_partkey", F.round(s, 6).alias("similarity")).where("similarity > 0.3")


@query("""
WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS a, ['small', 'ring', 'promo', 'red'] AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) AS overlap FROM w""")
def q_token_overlap(spark, sf):
    o = T.token_overlap(F.concat_ws(" ", "p_name", "p_type"), F.lit("small ring promo red"))
    return table(spark, sf, "part").select("p_partkey", F.round(o, 6).alias("overlap"))


@query("SELECT p_partkey, round(1 - levenshtein(p_name, 'small ring') / greatest(length(p_name), 10, 1), 6) AS ratio FROM part")
def q_edit_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(T.edit_ratio(F.col("p_name"), F.lit("small ring")), 6).alias("ratio"))


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"SELECT page_id, {FOLD.format(TITLE)} AS folded, replace({FOLD.format(TITLE)}, ' ', '-') AS slug FROM pages")
def q_name_fold(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select("page_id", T.fold(title).alias("folded"), T.slug(title).alias("slug"))


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) > 15) AS s FROM documents)
SELECT doc_id, len(s) >= 10 AND len(list_distinct(s)) / len(s) < 0.4 AS low FROM s""")
def q_low_quality_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.low_quality(F.col("text")).alias("low"))


@query(r"""
SELECT page_id, pos, url FROM (SELECT page_id, unnest(u) AS url, CAST(generate_subscripts(u, 1) AS INTEGER) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\s+[^>]*?href="([^"]*)"', 1) AS u FROM pages))""")
def q_link_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(T.links(F.col("html"))).alias("pos", "url"))


@query("SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n, max(length(html)) AS longest FROM pages GROUP BY 1")
def q_url_host(spark, sf):
    p = table(spark, sf, "pages")
    return p.groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.max(F.char_length("html")).cast("long").alias("longest"))


@query(r"""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def q_page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@query(r"""
WITH names AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS name FROM benchmark),
words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS name FROM documents)
SELECT doc_id, count(*) AS mentions, min(name) AS first_name FROM words JOIN names USING (name) WHERE length(name) >= 5 GROUP BY doc_id""")
def q_mentions(spark, sf):
    """Names of five letters and more that stand in a text, by words instead of a search of every text for every name."""
    words = lambda t: F.explode(F.array_distinct(F.split(F.lower(t), r"[^\p{L}]+"))).alias("name")
    names = table(spark, sf, "benchmark").select(words(F.col("text"))).where(F.char_length("name") >= 5).distinct()
    found = table(spark, sf, "documents").select("doc_id", words(F.col("text"))).join(names, "name")
    return found.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.min("name").alias("first_name"))


@query("""
SELECT o_orderkey, CAST(o_orderkey % 7 * 60 + o_orderkey * 7 % 60 AS INTEGER) AS seconds, CAST(o_orderkey % 9 AS INTEGER) AS landed, CAST(o_orderkey % 31 AS INTEGER) AS attempted,
       CAST(round(CAST((4 + o_orderkey % 3) * 12 + o_orderkey % 12 AS DOUBLE) * 2.54) AS INTEGER) AS cm FROM orders""")
def q_measures(spark, sf):
    k = F.col("o_orderkey")
    clock = F.concat((k % 7).cast("string"), F.lit(":"), F.lpad((k * 7 % 60).cast("string"), 2, "0"))
    of = F.concat((k % 9).cast("string"), F.lit(" of "), (k % 31).cast("string"))
    height = F.concat((4 + k % 3).cast("string"), F.lit("' "), (k % 12).cast("string"), F.lit('"'))
    read = table(spark, sf, "orders").select("o_orderkey", T.clock_seconds(clock).alias("seconds"), T.landed_of_attempted(of).alias("l"), T.feet_inches_cm(height).alias("cm"))
    return read.select("o_orderkey", "seconds", "l.landed", "l.attempted", "cm")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def q_any_date(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMM d, yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.year(d).cast("string"))).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", T.any_date(written).alias("day"))


@query("""
SELECT c_nationkey, CAST(sum(CAST('0x' || left(md5(c_custkey || '|' || c_name || '|' || c_mktsegment), 8) AS BIGINT)) AS VARCHAR) || '-' || count(*) AS fingerprint, count(*) AS n FROM customer GROUP BY 1""")
def q_content_fingerprint(spark, sf):
    """The sum of the rows' hashes, which no order changes: added up in every task first."""
    row = F.conv(F.left(F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")), F.lit(8)), 16, 10).cast("long")
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.concat_ws("-", F.sum(row).cast("string"), F.count("*").cast("string")).alias("fingerprint"), F.count("*").alias("n"))


SURNAME = "string_split(p_name, ' ')"


@query(f"""
SELECT p_partkey, {SURNAME}[-1] = 'ring' AND (starts_with({SURNAME}[1], 's') OR starts_with('s', {SURNAME}[1])) AS compatible FROM part""")
def q_names_compatible(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.names_compatible(F.col("p_name"), F.lit("S. Ring")).alias("compatible"))
