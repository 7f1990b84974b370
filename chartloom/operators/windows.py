"""Fixed-length token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chartloom.functions.scores import pooled
from chartloom.functions.text import fill_null, runs, space_tokens, term_counts, term_positions
from chartloom.operators.skew import HOT_ROWS, skewed_join
from chartloom.operators.vocabulary import CLS_ID, PAD_ID, SEP_ID, UNK_ID, vocabulary


def _words(text: str) -> Column:
    return F.filter(space_tokens(fill_null(F.col(text))), lambda w: w != "")


def term_totals(notes: DataFrame, text: str = "text") -> DataFrame:
    """``(term, count)`` over all notes, summed inside each row first."""
    return (
        notes.select(F.inline(term_counts(_words(text))))
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.sum("tf").alias("count"))
    )


def corpus_vocabulary(notes: DataFrame, text: str = "text", min_count: int = 1) -> DataFrame:
    return vocabulary(term_totals(notes, text), min_count)


def sequence_windows(
    notes: DataFrame,
    note_key: Sequence[str],
    vocab: DataFrame,
    text: str = "text",
    seq_len: int = 256,
    keep: Sequence[str] = (),
    totals: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(*note_key, *keep, seq_idx, input_ids, attn_mask)``.

    Sequence 0 is ``[CLS]`` + the first ``seq_len - 2`` ids + ``[SEP]``; the rest of the note
    follows in blocks of ``seq_len`` without special tokens. All are padded with zeros.
    A note sends each distinct term once, with the list of its positions, through the vocabulary join; the lists are then cut
    at the borders of blocks and grouped by (note, block), so no group exceeds ``seq_len`` positions however long the note is.
    ``totals`` is ``(term, count)`` with at least the count of every term above ``hot_rows``, if the caller has it: the ``term_totals`` of the
    notes or a stored vocabulary made from them.
    """
    if seq_len < 3:
        raise ValueError(f"seq_len must be at least 3, got {seq_len}")
    columns = [*note_key, *keep]

    def block(pos: Column) -> Column:
        return F.when(pos < seq_len - 2, 0).otherwise(F.floor((pos - (seq_len - 2)) / seq_len) + 1).cast("int")

    terms = notes.select(*columns, F.inline_outer(term_positions(_words(text))))
    coded = skewed_join(
        terms,
        vocab.select("term", "token_id"),
        ["term"],
        "left",
        spread_by=note_key,
        freq=term_totals(notes, text) if totals is None else totals.select("term", "count"),
        hot_rows=hot_rows,
    )
    parts = runs(F.col("places"), lambda here, before: block(here) != block(before), lambda run: run)
    cut = coded.select(*columns, F.coalesce("token_id", F.lit(UNK_ID)).alias("id"), F.explode_outer(parts).alias("places"))
    placed = cut.select(
        *columns,
        F.coalesce(block(F.get("places", F.lit(0))), F.lit(0)).alias("seq_idx"),
        F.when(F.col("places").isNotNull(), F.struct("id", "places")).alias("item"),  # null: a note without words
    )

    def scattered(items: Column) -> Column:
        pairs = F.transform(items, lambda x: F.transform(x["places"], lambda p: F.struct(p.alias("pos"), x["id"].alias("id"))))
        return F.sort_array(F.flatten(pairs))["id"]

    blocks = placed.groupBy(*columns, "seq_idx").agg(scattered(F.collect_list("item")).alias("ids"))
    cls, sep = F.array(F.lit(CLS_ID)), F.array(F.lit(SEP_ID))
    real = F.when(F.col("seq_idx") == 0, F.concat(cls, F.col("ids"), sep)).otherwise(F.col("ids"))
    sized = blocks.withColumn("real", real)
    padding = F.lit(seq_len) - F.size("real")
    return sized.select(
        *columns,
        "seq_idx",
        F.concat("real", F.array_repeat(F.lit(PAD_ID), padding)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("real")), F.array_repeat(F.lit(0), padding)).alias("attn_mask"),
    )


def pool_scores(
    scored: DataFrame,
    logits: str = "logits",
    n_classes: int = 2,
    scale: float = 2.0,
    key: str = "subject_id",
    label: str | None = "label",
    order: str = "seq_idx",
) -> DataFrame:
    """``(key, n_sequences, logits[, label])``: sequence scores blended per patient and class.

    ``(max + mean * n / scale) / (1 + n / scale)``; a single sequence keeps its own scores.
    The label is that of the patient's first sequence.
    """
    n = F.count("*").alias("n_sequences")
    per_class = []
    for c in range(n_classes):
        score = F.get(logits, F.lit(c))
        per_class += [F.max(score).alias(f"_max{c}"), F.avg(score).alias(f"_avg{c}")]
    labels = [F.min_by(label, order).alias(label)] if label else []
    grouped = scored.groupBy(key).agg(n, *per_class, *labels)
    blend = F.array(*(pooled(F.col(f"_max{c}"), F.col(f"_avg{c}"), F.col("n_sequences"), scale) for c in range(n_classes)))
    return grouped.select(key, "n_sequences", blend.alias(logits), *([label] if label else []))
