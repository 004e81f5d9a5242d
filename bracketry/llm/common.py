"""Shared helpers: the scratch folder that every executor sees, and word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator that has a word contract.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the session's checkpoints go to.

    Where neither is set, a folder of our own if driver and executors are one process, else an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bracketry-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/bracketry/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage, fixes values that a recomputation could change, and gives the planner the true size.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f for mapInArrow, with what it freed given back to the machine at its end: Python workers live on beside later stages."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return mapped


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join with a stored right that has one row a key, and in size how many rows of left the key has.

    Keys with over a thousandth of these rows are under a thousand, whatever the input: they are broadcast, so that no task
    gets all rows of one. The others are joined by a shuffle.
    """
    total = right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) * 1000 > total
    often = F.broadcast(right.where(hot))
    rest = left.join(often.select(*keys), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(often, keys).unionByName(rest)


def left_join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, broadcast_rows: int = 0) -> DataFrame:
    """left join with a stored right as join_by_size() takes it. Rows of left with a null key are not shuffled.

    right is broadcast whole where it has no more than broadcast_rows rows.
    """
    values = [c for c in right.columns if c not in (*keys, size)]
    total, n = right.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    if n <= broadcast_rows:
        return left.join(F.broadcast(right.select(*keys, *values)), keys, "left")
    hot = F.col(size) * 1000 > total
    often = right.where(hot).select(*keys, F.struct(*values).alias("_often"))
    found = left.join(F.broadcast(often), keys, "left")
    rest = F.col("_often").isNull()
    for k in keys:
        rest &= F.col(k).isNotNull()
    dealt = found.where(rest).drop("_often").join(right.where(~hot).select(*keys, *values), keys, "left")
    known = found.where(~rest).select(*left.columns, *[F.col(f"_often.{v}").alias(v) for v in values])
    return dealt.select(*left.columns, *values).unionByName(known)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
