"""Query of token counts: every document before and after its addresses are masked."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokencount import apply_edits, plant, scrub

VOCABULARY = "byte_bpe_50k.json"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("tree", plant(F.col("text"), path)).withColumn("n_pieces", F.size("tree.chars"))
    done = apply_edits(planted.withColumn("edits", scrub(F.col("text"))), path)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_after").alias("n_tokens_edited"), "n_edits", "n_pieces", "n_encoded", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
