"""Bag-of-words features as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.functions.text import fill_null, space_tokens, term_counts
from chartloom.operators.skew import HOT_ROWS, skewed_join


def term_frequencies(notes: DataFrame, keep: Sequence[str], text: str = "text", tokens: Column | None = None) -> DataFrame:
    """``(*keep, term, tf)``: counts per note, computed inside each row (no shuffle)."""
    words = space_tokens(fill_null(F.col(text))) if tokens is None else tokens
    return notes.select(*keep, F.inline(term_counts(words)))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``(term, df)``; a term frequency table holds each note's terms once, so rows count notes.

    The explicit null filter is what a join on the term would add: with it, every use of the
    table in one query has the same plan below its exchange and the exchange is shared.
    """
    return tf.filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def smoothed_idf(df: DataFrame, n_notes: Column) -> DataFrame:
    """``(term, df, idf)`` with ``idf = ln((1 + n) / (1 + df)) + 1``."""
    return df.select(
        "term", "df", (F.ln((F.lit(1.0) + n_notes) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf")
    )


def tfidf(
    notes: DataFrame,
    note_key: Sequence[str],
    text: str = "text",
    keep: Sequence[str] = (),
    fit_filter: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(*note_key, *keep, term, weight)``: TF-IDF rows of unit length.

    The document frequencies double as the key counts of the join, so frequent terms are cut
    into parts without another pass. ``fit_filter`` limits the notes the IDF is learned on
    (terms it never saw are dropped); by default all notes count.
    """
    columns = [*note_key, *keep]
    tf = term_frequencies(notes, columns, text)
    fit_notes = notes if fit_filter is None else notes.filter(fit_filter)
    df = document_frequencies(term_frequencies(fit_notes, [], text))
    idf = smoothed_idf(df, fit_notes.agg(F.count("*")).scalar()).select("term", "idf")
    freq = df if fit_filter is None else document_frequencies(term_frequencies(notes, [], text))
    weighted = skewed_join(
        tf, idf, ["term"], spread_by=note_key, freq=freq.withColumnRenamed("df", "count"), hot_rows=hot_rows
    ).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*note_key)))
    return weighted.select(*columns, "term", (F.col("raw") / norm).alias("weight"))


def patient_sum(rows: DataFrame, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Sum of note vectors per patient; partial sums shrink a patient before the shuffle."""
    return rows.groupBy(*keys, "term").agg(F.sum("weight").alias("weight"))


def patient_token_counts(notes: DataFrame, text: str = "text") -> DataFrame:
    """``(subject_id, count)`` of tokens: bounds a patient's feature rows without computing them."""
    return notes.groupBy("subject_id").agg(F.sum(F.size(space_tokens(fill_null(F.col(text))))).alias("count"))
