"""Running sums in an order that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored


def sums_before(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with before_v for v of values: the sum over the rows of the same by that come earlier in order, 0 for the first.

    Rows are cut into ranges of (by, order); sums within a range and the sums of whole ranges, a row a range and by, add up. A
    by may hold any share of the rows. order should tell rows apart; those that it doesn't come in any order. Null is a by.
    """
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_range").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_in_{v}") for v in values])
    met = own.join(starts, same)
    return met.select(*rows.columns, *[(F.col(f"_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])
