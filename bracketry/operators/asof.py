"""As-of and interval joins without a range join: one shuffle by key, a sort in time, and the last known value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, values: list[str], strict: bool = True, max_days: int | None = None) -> DataFrame:
    """left with values of the latest right row of the same key before left_time (or at it, unless strict).

    Both go through one window: rows of both sides in time order, those of right first at equal times only if they count there.
    With max_days the row found counts only if it is no older. Right rows with equal times: the largest values win.
    """
    found = F.struct(F.col(right_time).alias("at"), *values)
    names = left.columns
    a = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.lit(1 if not strict else 0).alias("_o"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_f"))
    b = right.select(F.col(on).alias("_k"), F.col(right_time).alias("_t"), F.lit(0 if not strict else 1).alias("_o"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), found.alias("_f"))
    before = Window.partitionBy("_k").orderBy("_t", "_o", F.col("_f").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionAll(b).withColumn("_last", F.last("_f", ignorenulls=True).over(before)).where(F.col("_l").isNotNull())
    fresh = F.lit(True) if max_days is None else F.datediff(F.col("_t"), F.col("_last.at")) <= max_days
    out = [F.when(fresh, F.col(f"_last.{v}")).alias(v) for v in values]
    return both.select("_l.*", *out, F.when(fresh, F.col("_last.at")).alias("as_of"))


def on_calendar(left: DataFrame, calendar: DataFrame, left_time: str, day: str, max_days: int) -> DataFrame:
    """left with the latest published day before left_time, at most max_days back.

    Each published day is listed under the months that it can serve, and a row looks under its own month.
    """
    months = F.sequence(F.trunc(day, "MM"), F.trunc(F.date_add(F.col(day), max_days), "MM"), F.expr("interval 1 month"))
    listed = calendar.select(F.col(day).alias("_d"), F.explode(months).alias("_m")).groupBy("_m").agg(F.array_sort(F.collect_set("_d")).alias("_ds"))
    near = left.withColumn("_m", F.trunc(left_time, "MM")).join(listed, "_m", "left").drop("_m")
    t = F.to_date(F.col(left_time))
    return near.withColumn("published", F.array_max(F.filter("_ds", lambda d: (d < t) & (d >= F.date_sub(t, max_days))))).drop("_ds")


def contained(left: DataFrame, spans: DataFrame, time: str, start: str, end: str, keys: list[str], width_days: int = 366, how: str = "inner") -> DataFrame:
    """left joined with the spans that hold its time, both ends included; an open end never ends.

    Spans are listed under the buckets of width_days that they touch, up to the last bucket of left, so that the join is on
    equality and each time looks under one bucket.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width_days)
    last = left.agg(F.max(bucket(F.col(time)))).first()[0] or 0
    upto = F.least(F.coalesce(bucket(F.col(end)), F.lit(last)), F.lit(last))
    listed = spans.where(bucket(F.col(start)) <= last).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), F.greatest(upto, bucket(F.col(start))))))
    placed = left.withColumn("_b", bucket(F.col(time)))
    within = F.col("l." + time).between(F.col("s." + start), F.coalesce(F.col("s." + end), F.col("l." + time)))
    same = [F.col(f"l.{k}") == F.col(f"s.{k}") for k in [*keys, "_b"]]
    values = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return placed.alias("l").join(listed.alias("s"), [*same, within], how).select(*[F.col(f"l.{c}") for c in left.columns], *values)
