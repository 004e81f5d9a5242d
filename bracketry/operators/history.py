"""Windows over an entity's history: what was known before a contest, runs, streaks, best stretches and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(key: str | list[str], *order: str):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def last_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n latest rows of each key, numbered from the latest."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def before(key: str, *order: str):
    """All rows of the key strictly before the current one."""
    return timeline(key, *order).rowsBetween(Window.unboundedPreceding, -1)


def upto(key: str, *order: str):
    return timeline(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def islands(df: DataFrame, key: str, order: list[str], value: str, name: str = "island") -> DataFrame:
    """Numbers runs of equal values along the order."""
    w = timeline(key, *order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(upto(key, *order)).cast("int")).drop("_change")


def current_streaks(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, value, n): the run of equal values that ends each key's history."""
    runs = islands(df, key, order, value).groupBy(key, "island").agg(F.first(value).alias(value), F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.max_by(F.struct(value, "n"), "island").alias("s")).select(key, f"s.{value}", "s.n")


def signed_streak(result: Column, island_size: Column) -> Column:
    """Positive for wins, negative for losses, zero for draws."""
    return F.when(result == "W", island_size).when(result == "L", -island_size).otherwise(F.lit(0))


def day_runs(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, longest): the longest run of consecutive days; repeated days count once."""
    w = timeline(key, day)
    once = days.select(key, day).distinct().withColumn("anchor", F.date_sub(F.col(day), F.row_number().over(w)))
    return once.groupBy(key, "anchor").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def best_window(df: DataFrame, key: str, order: list[str], score: Column, size: int) -> DataFrame:
    """(key, best): the largest sum over size rows in a row, capped at 100; only full windows count."""
    w = timeline(key, *order).rowsBetween(1 - size, 0)
    full = df.withColumn("s", F.sum(score).over(w)).withColumn("m", F.count("*").over(w)).where(F.col("m") == size)
    return full.groupBy(key).agg(F.least(F.lit(100.0), F.max("s").cast("double")).alias("best"))


def monthly(df: DataFrame, key: str, day: str) -> DataFrame:
    """Each row with the first days of the months after it and before the next row of its key."""
    nxt = F.lead(day).over(timeline(key, day))
    first = F.trunc(F.add_months(F.col(day), 1), "MM")
    last = F.date_sub(nxt, 1)
    return df.withColumn("_n", last).withColumn("_f", first).where(F.col("_n") >= F.col("_f")).withColumn("month", F.explode(F.sequence("_f", "_n", F.expr("interval 1 month")))).drop("_n", "_f")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Numbers sessions: a row starts one if it comes more than the gap after the one before."""
    w = timeline(key, ts)
    away = F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w))
    starts = F.when(away.isNull() | (away > gap_seconds), 1).otherwise(0)
    return df.withColumn("_s", starts).withColumn("session", F.sum("_s").over(upto(key, ts)).cast("int")).drop("_s")


def changes_only(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that differ from the one before of the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_p", F.lag(F.struct(value)).over(w)).where(F.col("_p").isNull() | ~F.col(f"_p.{value}").eqNullSafe(F.col(value))).drop("_p")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def testable(contests: DataFrame, ranks: DataFrame, sizes: list[int], order: list[str], least: int) -> DataFrame:
    """(size, held, testable) for each number of chosen entities: contests between two of them, and those of them in which both had `least` before.

    contests: contest_id, a_id, b_id and order; ranks: entity and rank from 1, by which entities are chosen. Only contests that are
    held count as history. A size without contests has no row.
    """
    of = lambda s: ranks.select(F.col("entity").alias(f"{s}_id"), F.col("rank").alias(f"_{s}"))
    both = contests.join(of("a"), "a_id").join(of("b"), "b_id")
    in_ = F.filter(F.array(*map(F.lit, sizes)), lambda n: n >= F.greatest("_a", "_b"))
    keys = [c for c in order if c != "contest_id"]
    each = both.select("contest_id", *keys, "a_id", "b_id", F.explode(in_).alias("size"))
    sides = each.select("size", "contest_id", *keys, F.explode(F.array("a_id", "b_id")).alias("entity"))
    seen = F.row_number().over(Window.partitionBy("size", "entity").orderBy(*order)) - 1
    fewest = sides.withColumn("seen", seen).groupBy("size", "contest_id").agg(F.min("seen").alias("seen"))
    return fewest.groupBy("size").agg(F.count("*").alias("held"), F.count_if(F.col("seen") >= least).alias("testable"))
