"""Query of token-id output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .tokenfile import read_tokens, write_tokens

VOCABULARY, END_ID = "byte_bpe_50k.json", 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_tokens(docs, scratch(spark, "tokens"), public_tokenizers.path(VOCABULARY), END_ID)
    return read_tokens(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
