"""Sequence-model data preparation and evaluation; the network itself is out of scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chartloom.operators import metrics, splits, windows
from chartloom.operators.vocabulary import vocabulary
from chartloom.plans.bow import with_patient


def prepare(
    notes: DataFrame,
    labels: DataFrame,
    note_key: Sequence[str],
    text: str = "text",
    seq_len: int = 256,
    val_frac: float = 0.2,
    min_count: int = 1,
    seed: int = 1,
) -> DataFrame:
    """Labelled windows tagged ``train`` or ``validation`` by patient, with class weights.

    Unlabelled notes keep a null label and weight.
    """
    labelled = splits.attach_labels(notes.select(*with_patient(note_key, text)), labels, note_key)
    marked = splits.split_column(labelled, splits.validation_patients(notes, val_frac, seed), note_key)
    named = marked.withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    totals = windows.term_totals(notes, text)
    rows = windows.sequence_windows(
        named, note_key, vocabulary(totals, min_count), text, seq_len, keep=["readm", "split"], totals=totals
    )
    return splits.with_class_weight(rows)


def evaluate(logits: DataFrame, scale: float = 2.0) -> DataFrame:
    """Metrics per sequence and per patient of a ``(subject_id, seq_idx, logits, label)`` table."""
    return metrics.metrics_by_level(logits, scale=scale)
