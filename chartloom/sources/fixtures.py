"""Adapters from the driver's tables to admissions, notes, labels, dictionary and score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.functions.text import drop_periods, normalize, word_tokens
from chartloom.operators.labels import readmission_labels
from chartloom.operators.vocabulary import vocabulary

NOTE_KEY = ["subject_id", "hadm_id"]
UNKNOWN_EVERY = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderdate").cast("timestamp").alias("admittime"),
    )


def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmission_labels(admissions(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several notes per patient: ``(subject_id, hadm_id, text, role)``."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("subject_id"), F.col("turn").alias("hadm_id"), "text", "role"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note per patient: ``(doc_id, text)``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def dictionary(spark: SparkSession, sf_dir: str, first: int = 11, n_words: int = 2) -> DataFrame:
    """``(term, cui, semtypes)`` from fixed word positions of the passages."""
    words = word_tokens(drop_periods(normalize(F.col("text"))))
    terms = (
        table(spark, sf_dir, "benchmark")
        .select("item_id", F.array_join(F.slice(words, first, n_words), " ").alias("term"))
        .groupBy("term")
        .agg(F.min("item_id").alias("item_id"))
    )
    return terms.select(
        "term",
        F.concat(F.lit("C"), F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("cui"),
        F.array(F.concat(F.lit("T"), (F.col("item_id") % 5).cast("string"))).alias("semtypes"),
    )


def word_vectors(spark: SparkSession, sf_dir: str, term_totals: DataFrame) -> DataFrame:
    """A vector for every word by the remainder of its id; every 32nd word stays unknown on purpose."""
    ids = vocabulary(term_totals, first_id=0).filter(F.col("token_id") % UNKNOWN_EVERY != 0)
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.agg(F.count("*")).scalar()
    return ids.withColumn("vec_id", F.col("token_id") % n).join(vectors, "vec_id").select(
        F.col("term").alias("word"), F.col("embedding").cast("array<double>").alias("vector")
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence scores ``(subject_id, seq_idx, logits, label)``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("seq_idx"),
        F.array(F.lit(0.0), (F.col("value") - 10.0) / 10.0).alias("logits"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, score, prediction)`` of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.ln(F.col("n_chars").cast("double"))
    return lengths.join(labels, "doc_id").select(
        "label", score.alias("score"), (F.col("n_chars") > 600).cast("int").alias("prediction")
    )
