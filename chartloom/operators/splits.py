"""Hold-out, validation and fold assignment by patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.operators.ranking import hash_rank, hash_sample
from chartloom.operators.skew import skewed_join
from chartloom.session import cut_lineage


def patients(notes: DataFrame) -> DataFrame:
    return notes.select("subject_id").distinct()


def labels_with_notes(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Label rows of patients that have notes; note keys are reduced before the shuffle."""
    return labels.join(patients(notes), "subject_id", "left_semi")


def check_fraction(frac: float) -> None:
    if not 0.0 < frac <= 0.4:
        raise ValueError(f"hold-out fraction must be in (0, 0.4], got {frac}")


def holdout_sizes(counts: DataFrame, frac: float) -> DataFrame:
    """Per label value, how many patients belong to the hold-out set (two rows), from ``(readm, count)`` rows."""
    check_fraction(frac)
    counted = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("readm") * F.col("count")), F.lit(0)).alias("n_pos")
    )
    size = F.floor(F.lit(frac) * F.col("n"))
    positives = F.floor(F.coalesce(F.try_divide(F.col("n_pos").cast("double"), F.col("n")), F.lit(0.0)) * size)
    return counted.select(
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("readm"), positives.alias("quota")),
                F.struct(F.lit(0).alias("readm"), (size - positives).alias("quota")),
            )
        )
    )


def holdout_patients(labels: DataFrame, frac: float = 0.2, seed: int = 18520) -> DataFrame:
    """``(subject_id, readm)`` of an exact stratified sample without replacement."""
    check_fraction(frac)
    return hash_sample(labels, "subject_id", ["readm"], lambda counts: holdout_sizes(counts, frac), seed)


def outside(rows: DataFrame, chosen: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    return skewed_join(rows, chosen.select("subject_id"), ["subject_id"], "left_anti", spread_by=spread_by)


def inside(rows: DataFrame, chosen: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    return skewed_join(rows, chosen.select("subject_id"), ["subject_id"], "left_semi", spread_by=spread_by)


def split_column(rows: DataFrame, chosen: DataFrame, spread_by: Sequence[str], name: str = "split") -> DataFrame:
    """Tag rows ``test`` when their patient was chosen, else ``train``, in one join."""
    marks = chosen.select("subject_id", F.lit("test").alias(name))
    return skewed_join(rows, marks, ["subject_id"], "left", spread_by=spread_by).fillna({name: "train"})


def holdout_audit(labels: DataFrame, frac: float = 0.2, seed: int = 18520) -> DataFrame:
    """Counts per split and label, with the requested hold-out size beside them.

    Train counts are what the chosen patients leave of the whole, so labels and sample are only counted, not joined.
    """
    labels = cut_lineage(labels.select("subject_id", "readm"))
    counts = labels.groupBy("readm").agg(F.count("*").alias("n"))
    test = holdout_patients(labels, frac, seed).groupBy("readm").agg(F.count("*").alias("n_test"))
    expected = labels.agg(F.floor(F.lit(frac) * F.count("*"))).scalar()
    both = counts.join(F.broadcast(test), "readm", "left")  # one row a label
    n_test = F.coalesce("n_test", F.lit(0))
    sides = F.inline(F.array(F.struct(F.lit("train").alias("split"), (F.col("n") - n_test).alias("n")), F.struct(F.lit("test").alias("split"), n_test.alias("n"))))
    return both.select("readm", sides).filter("n > 0").select("split", "readm", "n").withColumn("holdout_expected", expected)


def validation_patients(notes: DataFrame, val_frac: float = 0.2, seed: int = 1) -> DataFrame:
    """``floor(val_frac * patients)`` patients; all notes of one stay on the same side."""
    size = F.floor(F.lit(val_frac) * F.coalesce(F.sum("count"), F.lit(0)))
    return hash_sample(patients(notes), "subject_id", [], lambda counts: counts.agg(size.alias("quota")), seed)


def stratified_folds(labels: DataFrame, n_folds: int = 5, seed: int = 1, key: str = "subject_id") -> DataFrame:
    """Add ``fold`` in ``0..n_folds-1``; fold sizes differ by at most one per label."""
    ranked = hash_rank(labels, key, ["readm"], seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % n_folds).cast("int")).drop("rank")


def class_weights(labels: DataFrame, label: str = "readm") -> DataFrame:
    """Balanced weight per class, ``n / (k * n_class)``; unlabelled rows do not count."""
    counts = labels.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    all_classes = Window.partitionBy()  # one row per class
    n, k = F.sum("n").over(all_classes), F.count("*").over(all_classes)
    return counts.select(label, "n", (n / (k * F.col("n")).cast("double")).alias("class_weight"))


def with_class_weight(rows: DataFrame, label: str = "readm") -> DataFrame:
    """Rows with the weight of their class; one table row per class is broadcast."""
    weights = class_weights(rows, label).select(label, "class_weight")
    return rows.join(F.broadcast(weights), label, "left")


def attach_labels(
    rows: DataFrame,
    labels: DataFrame,
    spread_by: Sequence[str],
    how: str = "left",
    freq: DataFrame | None = None,
) -> DataFrame:
    """Each row with its patient's label; ``how='inner'`` keeps rows of labelled patients only."""
    return skewed_join(
        rows, labels.select("subject_id", "readm"), ["subject_id"], how, spread_by=spread_by, freq=freq
    )


def patient_labels(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """One label row per distinct patient that has notes."""
    return patients(notes).join(labels.select("subject_id", "readm"), "subject_id")


def corpus_summary(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(source, measure, value)``: rows, admissions and patients of notes, rows and patients of labels."""

    def counts(df: DataFrame, source: str, **measures: Column) -> DataFrame:
        pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]
        row = df.agg(*(c.alias(m) for m, c in measures.items()))
        return row.select(F.lit(source).alias("source"), F.inline(F.array(*pairs)))

    n_rows, n_patients = F.count("*"), F.countDistinct("subject_id")
    of_notes = counts(notes, "notes", rows=n_rows, admissions=F.countDistinct("hadm_id"), patients=n_patients)
    return of_notes.unionByName(counts(labels, "labels", rows=n_rows, patients=n_patients))
