"""Labels that spread along links until nothing changes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder.

    Where no folder is set, one of our own if driver and executors are one process, else an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[[\d*,]+\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bracketry-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/bracketry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: lineage is cut, a lost executor costs one round."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) by the smallest label of all neighbours, then a jump to the label's own label, until labels rest.

    Jumps double the distance that a label has come, so that rounds grow with the logarithm of the longest path.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").unionAll(links.select(F.col(b).alias("x"), F.col(a).alias("y")).where(f"`{a}` is not null and `{b}` is not null"))
    both = stored(both.distinct())
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = stored(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        labels = step.select("node", "root")
        if step.where("was <> root").isEmpty():
            return labels


def spread(seeds: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): known labels passed to unlabelled neighbours until no node is reached any more.

    A node takes the label that most of its neighbours have when the first of them has one, of equally many the smallest. Those
    neighbours were all labelled in the round before, so that a round looks at the links of new nodes alone. Links with a null
    end and seeds without a node or label are left out; a seed keeps its labels.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("node")).where("x is not null and node is not null and x <> node")
    both = stored(ends.unionByName(ends.select(F.col("node").alias("x"), F.col("x").alias("node"))).distinct())
    known = new = stored(seeds.select("node", "label").dropna().distinct())
    while not new.isEmpty():
        votes = both.join(new.withColumnRenamed("node", "x"), "x").groupBy("node", "label").agg(F.count("*").alias("n"))
        first = votes.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        new = stored(first)
        known = known.unionByName(new)
    return known
