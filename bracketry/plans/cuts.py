"""Queries of sides: a cut of the contest graph, its parts aligned, and the direction of differences of `embeddings`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cuts
from .base import contests, table
from .registry import query


def rivals(spark, sf):
    """Contests of one division and year, so that there are many parts; a node is an entity there."""
    c = contests(spark, sf).where("round <= 2").select("a_id", "b_id", (F.year("day") * 4 + F.floor(F.month("day") / 4)).alias("term"))
    node = lambda e: F.col("term") * 10_000_000 + F.col(e)
    return c.select(node("a_id").alias("a"), node("b_id").alias("b"))


@query()
def q_max_cut(spark, sf):
    """Rivals on opposite sides, as far as that can be, and how much of it can't."""
    edges = cuts.conflicts(rivals(spark, sf), "a", "b")
    labels = cuts.max_cut(edges)
    return cuts.frustration(edges, labels).select("component", "nodes", "total", "within", F.round("frustration", 6).alias("frustration"))


@query()
def q_aligned_sides(spark, sf):
    """Sides of each term's parts turned to fit its largest one, by each entity's figures."""
    labels = cuts.max_cut(cuts.conflicts(rivals(spark, sf), "a", "b")).withColumn("term", F.floor(F.col("node") / 10_000_000))
    e = F.col("c_custkey")
    own = table(spark, sf, "customer").select(e, F.array(F.col("c_acctbal") / 10_000, (e % 7 - 3).cast("double"), (e % 5 - 2).cast("double")).alias("vector"))
    named = labels.select("node", (F.col("node") % 10_000_000).alias("c_custkey")).join(own, "c_custkey").select("node", "vector")
    return cuts.align(labels, named, ["term"]).select("term", "node", "component", "label")


@query()
def q_pair_direction(spark, sf):
    """The first and last vector of a label in each forty: the direction their differences share, and how well it parts them."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("kind"), "embedding", F.floor(F.col("vec_id") / 40).alias("forty"))
    own = Window.partitionBy("kind", "forty")
    ends = (F.col("vec_id") == F.min("vec_id").over(own)) | (F.col("vec_id") == F.max("vec_id").over(own))
    v = v.withColumn("frame", F.when(ends & (F.count("*").over(own) > 1), F.col("forty")))
    pairs = v.where("frame is not null").groupBy("kind", "frame").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    placed = cuts.two_sides(v, "embedding", ["kind"], cuts.leading_direction(pairs, "a", "b", ["kind"], least=2))
    r = cuts.sides_report(placed, ["kind"], "frame")
    return r.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("separation", "within", "contrast", "disagreement")], "usable")
