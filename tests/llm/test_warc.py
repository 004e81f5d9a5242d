"""The WARC data source: round trips, predicates, splits, foreign files, and which records are revisits."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from bracketry.llm import op11, warc
from bracketry.llm.warc import SCHEMA, page_id, page_records, read_warc, write_warc

PAGES = "page_id long, url string, html string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by a plain pass over pages in order."""
    first, out = {}, []
    for pid, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        again = len(data) >= 100 and digest in first
        out.append((pid, len(data), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, pid)
    return out


def archived(spark, rows, path, **options):
    warc.register(spark)
    recs = page_records(spark.createDataFrame(rows, PAGES).repartition(5))
    recs.write.format("warc").options(**options).mode("append").save(path)
    back = read_warc(spark, path).where("record_type in ('response', 'revisit')")
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    digest = F.coalesce(F.sha2("payload", 256), F.col("payload_digest"))
    return [tuple(r) for r in back.select(page_id(F.col("record_id")), size, digest, "record_type", page_id(F.col("refers_to"))).collect()]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_revisits_nulls_and_ties(spark, tmp_path):
    rnd = random.Random(3)
    bodies = ["", None, "x" * 99, "y" * 100, "é" * 50, "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 9, "\r\n\r\n", "".join(rnd.choice("abcdef") for _ in range(300_000))]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "http://a/é", "http://b/\r\nX: 1", " pad "]), rnd.choice(bodies)) for _ in range(150)]
    rows += rows[:9] + [(1000 + i, "http://h/", "hot " * 60) for i in range(100)]
    assert sorted(archived(spark, rows, f"file://{tmp_path}/a", splitBytes="50000", fileBytes="70000"), key=key) == sorted(plain(rows), key=key)
    empty = page_records(spark.createDataFrame([], PAGES))
    assert empty.count() == 0
    write_warc(empty, f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0
    clashing = spark.createDataFrame(rows[:20], PAGES).withColumns({c: F.lit(1) for c in ("id", "payload", "first", "copies", "n", "k", "record_type", "payload_digest")})
    assert page_records(clashing).count() == 20


def test_every_split_has_each_record_once(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} " * (i % 700)) for i in range(3000)]
    path = f"file://{tmp_path}/s"
    write_warc(page_records(spark.createDataFrame(rows, PAGES).coalesce(1)), path)
    for split in (10_000, 333_333, 1 << 30):
        warc.register(spark)
        df = spark.read.format("warc").option("splitBytes", split).schema("record_id string").load(path)
        assert df.where("record_id like 'urn:page:%'").count() == df.where("record_id like 'urn:page:%'").distinct().count() == 3000
    assert spark.read.format("warc").option("splitBytes", 100_000).load(path).rdd.getNumPartitions() > 3


def test_predicates_and_columns_keep_payloads_undecoded(spark, tmp_path):
    """Payloads that can't be decoded are no error unless a query needs them."""
    folder = tmp_path / "d"
    folder.mkdir()
    good = warc.record_bytes({"record_type": "response", "record_id": "urn:page:1", "target_uri": "http://good/1", "payload": b"fine " * 90})
    bad = bytearray(warc.record_bytes({"record_type": "response", "record_id": "urn:page:2", "target_uri": "http://bad/2", "payload": b"lost " * 90}))
    at = bad.index(b"\x1f\x8b")
    bad[at : at + 4] = b"junk"
    seen = warc.record_bytes({"record_type": "revisit", "record_id": "urn:page:3", "target_uri": "http://good/3", "refers_to": "urn:page:1", "payload_digest": "0", "payload_bytes": 450})
    (folder / "x.warc").write_bytes(good + bytes(bad) + seen)
    uri = f"file://{folder}"
    df = read_warc(spark, uri)
    with pytest.raises(Exception, match="gzip|BadGzip"):
        df.collect()
    assert [r.record_id for r in df.where("target_uri like 'http://good/%'").orderBy("record_id").collect()] == ["urn:page:1", "urn:page:3"]
    assert [r.record_id for r in df.where("record_type = 'revisit'").collect()] == ["urn:page:3"]
    assert [bytes(r.payload) for r in df.where("record_id in ('urn:page:1', 'none')").collect()] == [b"fine " * 90]
    assert df.where("target_uri <> 'http://bad/2' and refers_to is null").count() == 1
    assert df.where("payload_bytes > 449 and target_uri not like 'http://bad%'").count() == 2
    assert read_warc(spark, uri, "record_id string, payload_bytes long").count() == 3
    plan = df.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan


def test_damaged_payloads_are_an_error(spark, tmp_path):
    data = warc.record_bytes({"record_id": "urn:page:1", "payload": b"short"}).replace(b"short", b"shorn")
    (tmp_path / "x.warc").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        read_warc(spark, f"file://{tmp_path}").collect()
    (tmp_path / "x.warc").write_bytes(b"no archive at all\r\n" * 9)
    with pytest.raises(Exception, match="no record begins"):
        read_warc(spark, f"file://{tmp_path}").collect()


def test_files_from_elsewhere(spark, tmp_path):
    """Members of their own, folded headers, other cases, chunks, deflate, and a type without HTTP."""
    def record(block, *headers):
        return b"\r\n".join([b"WARC/1.0", *headers, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"

    http = b"content-type: application/http; msgtype=response"
    parts = [
        record(b"software: x\r\n", b"WARC-Type: warcinfo", b"Content-Type: application/warc-fields"),
        record(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;q=1\r\nde\r\n0\r\n\r\n", b"warc-type: response", b"WARC-Target-URI: http://a/\r\n b", http),
        record(b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(b"deflated"), b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:1>", http),
        record(b"HTTP/1.1 304 Not Modified", b"WARC-Type: response", http),
        record(b"plain text", b"WARC-Type: conversion", b"Content-Type: text/plain"),
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "b.warc").write_bytes(b"".join(parts))
    (tmp_path / "c.txt").write_bytes(b"not read")
    for path, times in ((tmp_path, 2), (tmp_path / "b.warc", 1)):
        got = [(r.record_type, r.target_uri, bytes(r.payload)) for r in read_warc(spark, f"file://{path}").collect()]
        want = [("warcinfo", None, b"software: x\r\n"), ("response", "http://a/ b", b"abcde"), ("response", None, b"deflated"), ("response", None, b""), ("conversion", None, b"plain text")]
        assert sorted(got, key=str) == sorted(want * times, key=str)


def test_only_committed_files_count(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", "page " * 40 + str(i)) for i in range(20)], PAGES)
    path = f"file://{tmp_path}/c"
    write_warc(page_records(rows), path)
    lost = Path(tmp_path / "c/part-lost.warc")
    lost.write_bytes(warc.record_bytes({"record_id": "urn:page:99", "payload": b"x"}))
    ids = lambda: sorted(r[0] for r in read_warc(spark, path, "record_type string, record_id string").where("record_type = 'response'").select(page_id(F.col("record_id"))).collect())
    assert ids() == list(range(20))
    write_warc(page_records(rows.where("page_id < 3")), path)
    assert ids() == sorted([*range(20), 0, 1, 2])
    write_warc(page_records(rows.where("page_id < 3")), path, "overwrite")
    assert ids() == [0, 1, 2]
    assert len(list(Path(tmp_path / "c").glob("part-*.warc"))) == 1 + len(re.findall("name", next(Path(tmp_path / "c").glob("_committed-*")).read_text()))


def test_a_stream_reads_like_the_file():
    data = warc.record_bytes({"payload": b"abc", "target_uri": "http://x", "content_type": None})
    h = warc.headers_of(io.BytesIO(data))
    assert h["warc-target-uri"] == "http://x" and warc.headers_of(io.BytesIO(b"\r\n\r\n")) is None
    assert set(warc.HEADERS) < {c.split()[0] for c in SCHEMA.split(", ")}


def test_query_and_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{d}/pages.parquet'")
    df = op11.op11_warc(spark, d)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({op11.SQL})").fetchall())
