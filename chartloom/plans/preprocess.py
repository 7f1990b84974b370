"""Raw admissions and notes to the tables every experiment starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chartloom.functions.text import clean
from chartloom.operators import annotate, labels as lab, splits
from chartloom.sources import sinks
from chartloom.sources.release import Release


def clean_notes(notes: DataFrame, text: str = "text") -> DataFrame:
    return notes.withColumn(text, clean(F.col(text)))


def label_tables(admissions: DataFrame, out_dir: str) -> dict[str, str]:
    """Write the labels and the one-row prevalence report."""
    labels = lab.readmission_labels(admissions)
    labels_path = sinks.write_table(labels, f"{out_dir}/labels")
    stored = admissions.sparkSession.read.parquet(labels_path)
    return {"labels": labels_path, "prevalence": sinks.write_report(lab.prevalence(stored), f"{out_dir}/prevalence")}


def holdout_tables(
    notes: DataFrame, labels: DataFrame, note_key: Sequence[str], out_dir: str, frac: float = 0.2, seed: int = 18520
) -> dict[str, str]:
    """Write notes and labels partitioned into train and test by patient.

    Labels of patients without notes are left out; notes of unlabelled patients go to train.
    The chosen patients are written first, so both tables see the same draw. The three tables are published together:
    ``release.current(spark, out_dir)`` names those of the last run that ended.
    """
    spark, kept = notes.sparkSession, splits.labels_with_notes(labels, notes)
    out = Release(spark, out_dir)
    chosen = spark.read.parquet(sinks.write_table(splits.holdout_patients(kept, frac, seed), out.path("holdout")))
    sinks.write_splits(splits.split_column(kept, chosen, ["subject_id"]), out.path("labels"))
    sinks.write_splits(splits.split_column(notes, chosen, note_key), out.path("notes"))
    return out.publish()


def annotated_table(notes: DataFrame, note_key: Sequence[str], dictionary: DataFrame, out: str, fmt: str = "parquet", **options) -> str:
    """Write the notes with their annotation columns.

    The annotations are joined by key, so the text is read and shuffled once, here.
    """
    columns = annotate.annotate(notes, note_key, dictionary, **options)
    if fmt == "csv" and "sim_score" in columns.columns:
        columns = columns.withColumn("sim_score", F.array_join(F.col("sim_score").cast("array<string>"), " "))
    return sinks.write_table(notes.join(columns, list(note_key), "left"), out, fmt)
