"""Readmission labels from admission times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

WINDOW_SECONDS = 15_552_000  # 180 days


def readmission_labels(admissions: DataFrame, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``(subject_id, readm)`` from the gap between a patient's last two admissions.

    One admission gives 0; a gap inside ``(0, window)`` gives 1; a gap of zero drops the
    patient; anything else, unknown times included, gives 0. An unknown time sorts last.
    The ``<= 2`` filter becomes a group limit below the exchange, so a patient with any
    number of admissions ships at most two rows per map task.
    """
    latest = Window.partitionBy("subject_id").orderBy(F.col("admittime").desc_nulls_first(), F.col("hadm_id").desc())
    last_two = (
        admissions.select("subject_id", "hadm_id", "admittime")
        .withColumn("nth", F.row_number().over(latest))
        .filter("nth <= 2")
    )
    micros = F.unix_micros("admittime")
    gap = F.col("last") - F.col("previous")
    return (
        last_two.groupBy("subject_id")
        .agg(
            F.count("*").alias("n"),
            F.max(F.when(F.col("nth") == 1, micros)).alias("last"),
            F.max(F.when(F.col("nth") == 2, micros)).alias("previous"),
        )
        .select(
            "subject_id",
            F.when(F.col("n") == 1, 0)
            .when(gap <= 0, None)
            .when(gap < F.lit(window_seconds * 1_000_000), 1)
            .otherwise(0)
            .alias("readm"),
        )
        .filter("readm IS NOT NULL")
    )


def admission_counts(admissions: DataFrame) -> DataFrame:
    return admissions.groupBy("subject_id").agg(F.count("*").alias("n_admissions"))


def prevalence(labels: DataFrame) -> DataFrame:
    """One row: labelled patients, positives, share of positives and the same in percent."""
    share = F.try_divide(F.sum("readm").cast("double"), F.count("readm"))
    return labels.agg(
        F.count("readm").alias("n_patients"),
        F.coalesce(F.sum("readm"), F.lit(0)).cast("bigint").alias("n_readmitted"),
        share.alias("prevalence"),
        (share * 100).alias("prevalence_pct"),
    )
