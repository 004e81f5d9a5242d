"""Readers on small inputs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from bracketry.sources import files


def test_csv_and_paste(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"Smith, ""J""",1\n"two\nlines",\n')
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv"), "name string, n int").collect()] == [('Smith, "J"', 1), ("two\nlines", None)]
    (tmp_path / "b.txt").write_text("x\t1\nbad line\ny\t \n")
    assert sorted(map(tuple, files.pasted(spark, str(tmp_path / "b.txt"), ["k", "v"]).collect())) == [("x", "1"), ("y", None)]


def test_feed(spark):
    xml = "<rss><channel><title>t</title><item><title><![CDATA[A & B]]></title><link>http://x</link><description>&lt;p&gt; <b>hi</b></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>C</title></item></channel></rss>"
    got = spark.createDataFrame([(xml,), (None,)], "x string").select(F.inline(files.feed(F.col("x")))).collect()
    assert [r.title for r in got] == ["A & B", "C"]
    assert got[0].published == dt.datetime(2024, 1, 1, 10) and got[1].published is None


def test_atom_feed(spark):
    xml = '<feed><title>t</title><entry><title>A</title><link rel="alternate" href="http://x/1"/><updated>2024-01-01T10:00:00Z</updated><summary>b &lt; <i>c</i></summary></entry><entry><title>B</title><published>soon</published></entry></feed>'
    got = spark.createDataFrame([(xml,)], "x string").select(F.inline(files.feed(F.col("x")))).collect()
    assert [(r.title, r.link, r.published) for r in got] == [("A", "http://x/1", dt.datetime(2024, 1, 1, 10)), ("B", "", None)]


def test_quotes(spark):
    j = {"results": {"book1": {"odds": {"1_1": [{"home_od": "1.5", "away_od": "2.5", "add_time": "0"}, {"home_od": "-", "away_od": "2.5", "add_time": "1"}]}}}}
    got = files.quotes(spark.createDataFrame([(7, json.dumps(j)), (8, "broken"), (9, None)], "id int, p string"), "id", "p").collect()
    assert [(r.id, r.book, r.market, r.a, r.b) for r in got] == [(7, "book1", "1_1", 1.5, 2.5)]


def test_page_tables_and_layouts(spark):
    page = "<table><tr><th>Name</th><th>N</th></tr><tr><td><a href='x'>Ann</a></td><td>3</td></tr><tr><td>one cell</td></tr></table>"
    d = spark.createDataFrame([(1, page), (2, "no table")], "id int, html string")
    assert [(r.id, r.pos, r.name, r.n) for r in files.page_table(d, "id", "html", ["name", "n"]).collect()] == [(1, 0, "Name", "N"), (1, 1, "Ann", "3")]
    out = files.by_layout(d, "html", {"modern": ("<table>", files.table_cells(F.col("html")))}, F.array().cast("array<array<string>>")).orderBy("id").collect()
    assert [(r.layout, len(r.rows)) for r in out] == [("modern", 3), ("unknown", 0)]


def test_scans_go_on(spark, tmp_path):
    d = spark.range(10).withColumnRenamed("id", "k")
    assert files.unseen(d, d.where("k < 4"), "k").count() == 6
    assert sum(files.shard(d, "k", i, 3).count() for i in range(3)) == 10
    files.replace_table(d, str(tmp_path / "t"))
    files.report(spark.read.parquet(str(tmp_path / "t")).agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 10
