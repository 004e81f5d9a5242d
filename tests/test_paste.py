"""Pasted records, whatever the splits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bracketry.sources.paste import Kind, fields, records

KINDS = [Kind("name", r"^(N\d+)$"), Kind("age", r"^(\d+)$"), Kind("height", r"^(\d+)$"), Kind("marks", r"^\*(\w+)$", True)]


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "37b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_records_across_splits(spark, tmp_path, small_splits):
    """Two files; every record is longer than a split or crosses one. Equal lines, blanks, headers and a record without more lines."""
    want = {}
    for f in range(2):
        text = ["stray", "Header"]
        for i in range(1, 41):
            own = [f"N{i}\t{20 + i % 3}", *["*a"] * (i % 4), f"{150 + i}\tother\t*b"][: 1 if i == 40 else None]
            want[f, i] = own
            text += [own[0], "", " \t", *own[1:], *(["Header"] if i % 7 == 0 else [])]
        (tmp_path / f"{f}.txt").write_text("\n".join(text))
    found = records(spark, str(tmp_path), r"^N\d+", r"^Header$")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {(int(r.file[-5]), r.record): r.lines for r in found.collect()}
    assert got == want
    row = found.where("record = 3 and file like '%0.txt'").select(fields(F.col("lines"), KINDS).alias("f")).first().f
    assert tuple(row) == ("N3", "20", "153", ["a", "a", "a", "b"])


def test_fields(spark):
    """Cells that no kind wants, kinds without a cell, a taken kind, nulls."""
    d = spark.createDataFrame([(1, ["N1\tN2", "x\t 5 ", "6\t7"]), (2, []), (3, None), (4, ["\t\t"])], "k int, lines array<string>")
    got = {r.k: r.f and tuple(r.f) for r in d.select("k", fields(F.col("lines"), KINDS).alias("f")).collect()}
    assert got == {1: ("N1", "5", "6", []), 2: (None, None, None, []), 3: None, 4: (None, None, None, [])}


def test_an_empty_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert records(spark, str(tmp_path), "^N").collect() == []
