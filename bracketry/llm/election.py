"""One row of each group. Ids may be null or repeated: a row is known by its id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed c0, c1, ..., so that none clashes with another, and the new names of some."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in columns]


def with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _key, a hash of id and text. Nulls, which the hash would pass over, are marked."""
    return docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull()))


def elect(keyed: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of a table of with_key(), one of each group: that of the smallest id, and the smallest text among equal ids.

    groups has (_key, _group) for every key, repeated or not. A null id counts as smaller than any other. Of rows with equal
    id and text any one stays.
    """
    rows = keyed.select("_key", F.struct(F.col(id_col).alias("id")).alias("_id")).distinct().join(groups.select("_key", "_group").distinct(), "_key")
    rows = materialize(rows, "rows")
    best = rows.groupBy("_group", "_id").agg(F.count("*").alias("n"), F.min("_key").alias("_key")).groupBy("_group").agg(F.min(F.struct("_id", "n", "_key")).alias("b"))
    best = materialize(best.select("_group", "b.*"), "best")
    tied = rows.join(best.where("n > 1").select("_group", "_id"), ["_group", "_id"]).select("_key", "_group")
    texts = keyed.select("_key", F.col(text_col).alias("_text")).join(tied, "_key")
    first = texts.groupBy("_group").agg(F.min(F.struct("_text", "_key")).alias("b")).select("b._key")
    chosen = best.where("n = 1").select("_key").unionAll(first)
    return keyed.dropDuplicates(["_key"]).join(chosen, "_key", "left_semi").drop("_key")
