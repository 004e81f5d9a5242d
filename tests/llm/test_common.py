"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

from bracketry.llm.common import join_by_size, left_join_by_size, materialize, shared_dir


def test_join_by_size(spark):
    left = spark.range(5000).selectExpr("case when id % 3 = 0 then 0 else id end as k", "id")
    right = materialize(left.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v"), "test-right")
    got = join_by_size(left, right, ["k"], "n")
    assert got.count() == 5000 and got.where("v <> 2 * k").count() == 0
    assert join_by_size(left.where("false"), right.where("false"), ["k"], "n").count() == 0


def test_left_join_by_size(spark):
    left = spark.range(6000).selectExpr("case when id % 3 = 0 then 0 when id % 3 = 1 then null else id end as k", "id")
    right = materialize(left.where("k < 3000").groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v"), "test-right")
    for rows in (0, 1_000_000):
        got = left_join_by_size(left, right, ["k"], "n", rows)
        assert got.columns == ["k", "id", "v"] and got.count() == 6000
        assert got.where((F.col("k") < 3000) & ~F.col("v").eqNullSafe(2 * F.col("k"))).count() == 0
        assert got.where("(k is null or k >= 3000) and v is not null").count() == 0
    assert left_join_by_size(left.where("false"), right.where("false"), ["k"], "n").count() == 0


def test_scratch_is_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
