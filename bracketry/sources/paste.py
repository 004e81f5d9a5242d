"""Records of pasted text: some lines that belong together, with fields that are told apart by how they look.

A file may be cut anywhere into splits. Lines are known by their split and their place in it; the number of a record is how many
lines before it begin one, a running sum by ranges, so that no task holds a file and a record across splits is whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import sums_before


class Kind(NamedTuple):
    """A field: its name, a pattern with one group for a whole cell, and whether a record may have several."""

    name: str
    pattern: str
    many: bool = False


def records(spark: SparkSession, path: str, begins: str, skip: str | None = None) -> DataFrame:
    """(file, record, lines): a record from each line that begins one (pattern) to the line before the next, in file order from 1.

    Blank lines and lines with skip (headers, footers) are left out, and so are lines before the first record of a file. A record
    is one row and should fit in a task; a file need not.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select(*at, "value").where(F.trim(F.translate("value", "\t\r", "")) != "")
    if skip:
        lines = lines.where(~F.col("value").rlike(skip))
    flagged = lines.withColumn("first", F.col("value").rlike(begins).cast("long"))
    numbered = sums_before(flagged, ["file"], ["start", "at"], ["first"]).withColumn("record", F.col("before_first") + F.col("first"))
    whole = numbered.where("record > 0").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("l"))
    return whole.select("file", "record", F.col("l.value").alias("lines"))


def fields(lines: Column, kinds: list[Kind]) -> Column:
    """A struct with a field for each kind, of the tab-separated cells of a record's lines, by one fold over them.

    A cell goes to the first kind whose pattern it has, of those that are not yet taken; kinds with many are never taken, and give
    an array. Cells that no kind wants are left out; a kind without a cell is null, or an empty array. Null lines give null.
    """
    cells = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, "\t"))), lambda c: F.trim(c)), lambda c: c != "")
    none = F.array().cast("array<string>")

    def put(state: Column, cell: Column) -> Column:
        free, out = F.lit(True), []
        for k in kinds:
            own = state[k.name]
            takes = free & cell.rlike(k.pattern) & (F.lit(True) if k.many else F.size(own) == 0)
            out.append(F.when(takes, F.concat(own, F.array(F.regexp_extract(cell, k.pattern, 1)))).otherwise(own).alias(k.name))
            free = free & ~takes
        return F.struct(*out)

    def done(state: Column) -> Column:
        return F.struct(*[(state[k.name] if k.many else F.get(state[k.name], 0)).alias(k.name) for k in kinds])

    return F.aggregate(cells, F.struct(*[none.alias(k.name) for k in kinds]), put, done)
