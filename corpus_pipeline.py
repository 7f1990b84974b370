"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

1. Language ID: documents without a letter (``und``) or without a language above chance go.
2. Near-duplicates: five-word shingles, similarity 0.8; the smallest ``doc_id`` of each component stays.
3. Benchmark decontamination: documents that hold 0.8 of a test item's five-word shingles go.
4. Secret scans: secrets in any layer are replaced by a mark; every document stays.
5. Word BPE: ids of every text, and the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm import decontam, langid, neardup, secrets, wordbpe
from chartloom.llm.common import table
from chartloom.session import cut_lineage

MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs), MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; ``n_chars`` follows the new text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(wordbpe.WORD_BPE)
    return wordbpe.decode(wordbpe.encode(docs, path), path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]

#: The language model and exact BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
