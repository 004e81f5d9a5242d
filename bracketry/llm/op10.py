"""Query of BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", bpe.encode(F.col("text"), path).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("decoded"))
    return both.select(
        "doc_id",
        bpe.n_ids(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
