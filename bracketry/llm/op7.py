"""Query of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import crc_mod, table


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = toxicity.classify(docs, model)
    return found.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.col("toxic").alias("predicted"),
        F.col("n_toxic").alias("n_matches"),
    )
