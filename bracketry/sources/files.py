"""Readers and writers: delimited text, feeds, nested JSON, page tables, and scans that go on where the last one ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; quotes are doubled inside quotes, and a field may have line ends."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True)


def pasted(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of tab-separated text as columns; lines with another number of fields are left out."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.size(parts) == len(names))
    return lines.select(*[F.nullif(F.trim(F.get(parts, i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def feed(xml: Column) -> Column:
    """array<struct<title, link, summary, published>> of an RSS or Atom feed, in its order."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(item|entry)\b[^>]*>(.*?)</\1>"), F.lit(2))

    def tag(item: Column, names: str) -> Column:
        inner = F.regexp_extract(item, rf"(?s)<({names})\b[^>]*>(.*?)</\1>", 2)
        return F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))

    def published(item: Column) -> Column:
        rss = F.try_to_timestamp(F.regexp_extract(tag(item, "pubDate"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
        atom = F.try_to_timestamp(F.regexp_extract(tag(item, "published|updated"), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        return F.coalesce(rss, atom)

    def link(item: Column) -> Column:
        inner = tag(item, "link")
        return F.when(inner != "", inner).otherwise(F.regexp_extract(item, r'<link\b[^>]*?href="([^"]*)"', 1))

    return F.transform(items, lambda i: F.struct(tag(i, "title").alias("title"), link(i).alias("link"), strip_tags(tag(i, "description|summary|content")).alias("summary"), published(i).alias("published")))


QUOTES = "struct<results: map<string, struct<odds: map<string, array<struct<home_od: string, away_od: string, add_time: string>>>>>>"


def quotes(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, book, market, a, b, quoted_at) from a nested JSON feed of odds; rows without two prices above 1 are left out."""
    parsed = df.select(key, F.from_json(payload, QUOTES).alias("j"))
    books = parsed.select(key, F.explode("j.results").alias("book", "v"))
    rows = books.select(key, "book", F.explode("v.odds").alias("market", "ticks")).select(key, "book", "market", F.inline("ticks"))
    number = lambda c: F.col(c).try_cast("double")
    out = rows.select(key, "book", "market", number("home_od").alias("a"), number("away_od").alias("b"), F.timestamp_seconds(F.col("add_time").try_cast("long")).alias("quoted_at"))
    return out.where((F.col("a") > 1) & (F.col("b") > 1))


def table_cells(page: Column) -> Column:
    """array<array<string>> of the cells of every table row of a page."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cells(r), strip_tags))


def page_table(df: DataFrame, key: str, page: str, names: list[str]) -> DataFrame:
    """Rows of a page's tables that have as many cells as there are names; pos counts from 0."""
    rows = df.select(key, F.posexplode(F.filter(table_cells(F.col(page)), lambda r: F.size(r) == len(names))).alias("pos", "r"))
    return rows.select(key, "pos", *[F.get("r", i).alias(n) for i, n in enumerate(names)])


def by_layout(df: DataFrame, page: str, layouts: dict[str, tuple[str, Column]], otherwise: Column) -> DataFrame:
    """Adds layout, the first whose pattern the page has, and rows, by that layout's expression."""
    name, value = F.lit("unknown"), otherwise
    for layout, (pattern, parsed) in reversed(layouts.items()):
        hit = F.col(page).rlike(pattern)
        name, value = F.when(hit, layout).otherwise(name), F.when(hit, parsed).otherwise(value)
    return df.withColumn("layout", name).withColumn("rows", value)


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an earlier scan hasn't done."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, key: str, i: int, n: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
