"""Merging a batch into a table without in-place updates: join, choose, overwrite.

Applying the same batch twice gives what applying it once gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def overwrite(old: Column, new: Column) -> Column:
    return new


def fill_new(old: Column, new: Column) -> Column:
    """A new value wins unless it is null."""
    return F.coalesce(new, old)


def fill_old(old: Column, new: Column) -> Column:
    """An old value stays unless it is null."""
    return F.coalesce(old, new)


def larger(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def smaller(old: Column, new: Column) -> Column:
    return F.least(old, new)


def no_demotion(final: str) -> Rule:
    """A final status stays whatever comes."""
    return lambda old, new: F.when(old == final, old).otherwise(F.coalesce(new, old))


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, Rule]) -> DataFrame:
    """Rows of either side by key; a row of both has each column by its rule, overwrite where none is given."""
    t, b = table.withColumn("_t", F.lit(True)).alias("t"), batch.withColumn("_b", F.lit(True)).alias("b")
    both = t.join(b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    out = []
    for c in table.columns:
        old, new = F.col(f"t.{c}"), F.col(f"b.{c}")
        if c in keys:
            out.append(F.coalesce(old, new).alias(c))
        else:
            out.append(F.when(F.col("_b").isNull(), old).when(F.col("_t").isNull(), new).otherwise(rules.get(c, overwrite)(old, new)).alias(c))
    return both.select(*out)


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of batch whose keys it lacks."""
    return table.unionByName(batch.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def update_from(table: DataFrame, values: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Columns of values put into table by key; keys without a row have the default, so that absent ones are reset."""
    kept = [c for c in table.columns if c not in defaults]
    return table.select(*kept).join(values.select(key, *defaults), key, "left").select(*kept, *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def delete_superseded(table: DataFrame, official: DataFrame, keys: list[str], provisional: Column) -> DataFrame:
    """table less its provisional rows that have an official twin."""
    twins = official.select(*keys).distinct().withColumn("_has", F.lit(True))
    return table.join(twins, keys, "left").where(~(F.coalesce(provisional, F.lit(False)) & F.coalesce("_has", F.lit(False)))).drop("_has")


def survivors(df: DataFrame, keys: list[str], priority: list[Column], first_seen: str) -> DataFrame:
    """One row a key, the first by priority, with the earliest first_seen of all."""
    w = Window.partitionBy(*keys)
    seen = df.withColumn("_seen", F.min(first_seen).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(*priority)))
    return seen.where("_rn = 1").withColumn(first_seen, F.col("_seen")).drop("_rn", "_seen")


def replaced_ids(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """References rewritten to the survivors' ids."""
    m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    return df.join(m, df[column] == m["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def retire_missing(table: DataFrame, listed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows to log and delete): those that an authoritative list lacks; an empty list deletes nothing."""
    any_ = listed.limit(1).select(F.lit(True).alias("_any"))
    gone = table.join(listed.select(*keys), keys, "left_anti").join(F.broadcast(any_), how="cross").drop("_any")
    return table.join(gone.select(*keys), keys, "left_anti"), gone


def changed_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, before, after) for every value that differs."""
    both = old.alias("o").join(new.alias("n"), key)
    diffs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o.{c}").cast("string").alias("before"), F.col(f"n.{c}").cast("string").alias("after")) for c in columns])
    return both.select(key, F.inline(diffs)).where(~F.col("before").eqNullSafe(F.col("after")))
