"""Streams give what one batch gives, however the rows are cut."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bracketry.operators import history, merge
from bracketry.streaming import changelog

SCHEMA = "id long, k string, ts timestamp, v long"
ROWS = [(i, "ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), [1, 1, 2, 2, 2, 1, None, None, 3][i % 9]) for i in range(40)]


def run(spark, tmp_path, make, mode="append", cuts=4, sink=None):
    src = tmp_path / "in"
    for i in range(cuts):
        spark.createDataFrame(ROWS[i * len(ROWS) // cuts : (i + 1) * len(ROWS) // cuts], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    w = make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    (w.foreachBatch(sink) if sink else w.format("parquet").option("path", str(tmp_path / "out"))).start().awaitTermination(120)
    return None if sink else spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("cuts", [1, 5])
def test_changes(spark, tmp_path, cuts):
    got = run(spark, tmp_path, lambda s: changelog.on_change(s, ["k"], "id", "v"), cuts=cuts)
    want = history.changes_only(spark.createDataFrame(ROWS, SCHEMA), ["k"], ["id"], "v")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_once(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: changelog.once(s.where("v is not null"), ["k", "v"], "ts", "10 days"))
    assert sorted((r.k, r.v) for r in got.collect()) == sorted({(r[1], r[3]) for r in ROWS if r[3] is not None})


def test_closed_windows(spark, tmp_path):
    got = {(r.start, r.k): (r.n, r.total) for r in run(spark, tmp_path, lambda s: changelog.tumbling(s, "ts", "6 hours", "1 hour", ["k"], "v")).collect()}
    every = spark.createDataFrame(ROWS, SCHEMA).groupBy(F.window("ts", "6 hours").alias("w"), "k").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()
    want = {(r.w.start, r.k): (r.n, r.total) for r in every}
    assert got and got.items() <= want.items() and len(want) - len(got) <= 4  # the last windows are still open


def test_cutoff(spark, tmp_path):
    cut = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 9))], "k string, cutoff timestamp")
    got = run(spark, tmp_path, lambda s: changelog.before_cutoff(s, cut, "k", "ts", "cutoff"))
    assert sorted(r.id for r in got.collect()) == [0, 2, 4, 6, 8]


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "table")
    sink = changelog.upsert_into(path, ["k"], {"v": merge.larger}, [F.desc("id")])
    run(spark, tmp_path, lambda s: s.where("v is not null"), "append", 4, sink)
    last = spark.read.parquet(f"{path}/3")
    per = [ROWS[i * 10 : (i + 1) * 10] for i in range(4)]
    want = {k: max(max((r for r in p if r[1] == k and r[3] is not None), key=lambda r: r[0])[3] for p in per) for k in "ab"}
    assert {r.k: r.v for r in last.collect()} == want
