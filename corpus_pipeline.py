"""A training corpus from raw documents: five stages, each stored as Parquet and read again by the next.

Stages take documents (doc_id, text, lang, source, n_chars) with any further columns, and an empty table as well. Ids may be
null or repeated. Further columns come out as they went in, unless a stage says that it has one of that name itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracketry.llm import bpe, decontaminate, linededup, similar, toxicity
from bracketry.llm.common import SPACE, materialize, table

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labelled ones, does not reject.

    Each row is judged by itself: repeated rows go or stay together. A null text counts as empty and is judged by the share
    of toxic labels alone; without labels nothing goes. Further columns named toxicity, n_toxic and toxic come out with the
    operator's values.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).where("toxic = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less later copies of line runs; documents that lose every word go, those that had none stay.

    A null text stays null. n_chars is counted anew where lines went. Of repeated rows with equal id and text all lose the
    same lines. Further columns named n_lines and removed come out with the operator's values.
    """
    found = linededup.dedup_lines(docs)
    kept = found.where((F.size("removed") == 0) | F.col("text").rlike(f"[^{SPACE}]"))
    return kept.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of a similarity of 0.8 and more.

    The one of the smallest id stays, a null id first, and of equal ids the smallest text. Null and empty texts and those
    without words are one group. Of repeated rows one stays.
    """
    return similar.survivors(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null, empty and short texts hold none and stay; repeated rows go or stay together. Without items nothing goes.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text again.

    A null text counts as empty: it has no ids and decodes. New columns are ids, n_tokens and decodes, which replace further
    columns of these names.
    """
    path = public_tokenizers.path(VOCABULARY)
    ids = docs.withColumn("ids", bpe.encode(F.col("text"), path))
    back = bpe.decode(F.col("ids"), path) == F.coalesce("text", F.lit(""))
    return ids.withColumn("n_tokens", bpe.n_ids(F.col("ids"))).withColumn("decodes", back)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: SQL can't fit the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
