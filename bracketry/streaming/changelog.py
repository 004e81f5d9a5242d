"""Change logs and ticks as streams: what is written once, what is written on change, windows with late rows, and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from ..operators import merge


def on_change(stream: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the last one of their keys, in the order of arrival, and of order within a batch.

    The state of a key is its last value. Rows of one key in one batch go to one task, sorted there; the state alone stays.
    """
    names = stream.columns
    # pandas holds integers with nulls as floats
    exact = int if isinstance(stream.schema[value].dataType, IntegralType) else lambda v: v

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        known, last = (True, state.get[0]) if state.exists else (False, None)
        kept = []
        for i, v in enumerate(None if pd.isna(v) else exact(v) for v in rows[value]):
            if not known or v != last:
                kept.append(i)
            known, last = True, v
        state.update((last,))
        yield rows.iloc[kept][names]

    return stream.groupBy(*keys).applyInPandasWithState(step, stream.schema, stream.select(value).schema, "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """The first row of every combination of keys; a combination is forgotten once it is later than late."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, event_time: str, width: str, late: str, by: list[str], value: str, start: str = "0 days") -> DataFrame:
    """(start, by, n, total) for each closed window; rows that come later than late are left out."""
    w = F.window(event_time, width, startTime=start)
    g = stream.withWatermark(event_time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "total")


def before_cutoff(stream: DataFrame, cutoffs: DataFrame, key: str, event_time: str, cutoff: str) -> DataFrame:
    """Observations before the cutoff of their key, from a table that stands still."""
    return stream.join(cutoffs.select(key, cutoff), key).where(F.col(event_time) < F.col(cutoff)).drop(cutoff)


def upsert_into(path: str, keys: list[str], rules: dict[str, merge.Rule], order: list[Column]):
    """A function for foreachBatch that merges each batch into a table of versions under path.

    Every batch writes a version of its own and reads the one before it, so that a batch that runs again writes the same.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = merge.survivors(batch.withColumn("_seen", F.lit(0)), keys, order, "_seen").drop("_seen")
        if number:
            new = merge.upsert(spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}"), new, keys, rules)
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge_batch
