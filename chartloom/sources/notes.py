"""Scans of notes, admissions, labels and line lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom import schemas
from chartloom.functions.text import append_semtypes, fill_null
from chartloom.sources import quoted_csv


def read_table(
    spark: SparkSession, path: str, columns: Mapping[str, str], fmt: str = "parquet", multiline: bool | None = None
) -> DataFrame:
    """Named columns cast to their declared types; nothing is inferred, the rest is pruned.

    CSV follows the quoting most writers use. With ``multiline`` a field may hold line breaks; files are
    split among tasks either way, but read twice then. The default allows line breaks where a column of free text is read.
    """
    if fmt == "csv":
        if multiline is None:
            multiline = bool({*schemas.TEXT_VARIANTS, "semtypes"} & set(columns))
        df = quoted_csv.read(spark, path) if multiline else spark.read.csv(path, header=True, quote='"', escape='"')
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns.items()))


def read_notes(
    spark: SparkSession,
    path: str,
    var: str = "text",
    with_semtypes: bool = False,
    extra: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    multiline: bool | None = None,
) -> DataFrame:
    """Note ids and the chosen text variant, nulls filled; ``extra`` adds typed key columns.

    ``multiline=False`` reads CSV whose texts hold no line breaks in one pass.
    """
    if var.lower() not in schemas.TEXT_VARIANTS:
        raise ValueError(f"var must be one of {schemas.TEXT_VARIANTS}, got {var!r}")
    columns = {**schemas.NOTE_IDS, **(extra or {}), var.lower(): "string"}
    if with_semtypes:
        columns["semtypes"] = "string"
    return read_table(spark, path, columns, fmt, multiline).withColumn(var.lower(), fill_null(F.col(var.lower())))


def read_admissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.ADMISSIONS, fmt)


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.LABELS, fmt)


def read_line_list(spark: SparkSession, path: str, name: str = "semtype") -> DataFrame:
    """One trimmed, non-empty line per row."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "")


def choose_variant(notes: DataFrame, var: str, with_semtypes: bool = False) -> DataFrame:
    """The notes with one text variant as ``text``, semantic types appended on request."""
    if var not in schemas.TEXT_VARIANTS:
        raise ValueError(f"var must be one of {schemas.TEXT_VARIANTS}, got {var!r}")
    text = append_semtypes(F.col(var), F.col("semtypes")) if with_semtypes else fill_null(F.col(var))
    keys = [c for c in notes.columns if c not in (*schemas.TEXT_VARIANTS, "semtypes", "sim_score")]
    return notes.select(*keys, text.alias("text"))


def number_rows(df: DataFrame, name: str = "line") -> DataFrame:
    """File line number of every row of a plain scan, the header being line 0; files count in order of their names.

    Rows keep their order inside a file split, so numbering them within (file, offset) and adding
    the row counts of the splits before, by file name and offset, is exact.
    """
    from pyspark.sql import Window

    split = ["_path", "_start"]
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*split)
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .select(*split, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(offsets, split)
        .withColumn(name, F.col("_id") - F.col("_first") + F.col("_offset") + 1)
        .drop(*split, "_id", "_first", "_offset")
    )


def skip_ranges(df: DataFrame, key: str, limits: Sequence[int]) -> DataFrame:
    """Drop rows whose key lies in any ``[start, end)`` of the flat list ``s1 e1 s2 e2 ...``."""
    if len(limits) % 2:
        raise ValueError("limits must come in (start, end) pairs")
    keep = F.lit(True)
    for start, end in zip(limits[::2], limits[1::2]):
        keep = keep & ~((F.col(key) >= start) & (F.col(key) < end))
    return df.filter(keep)


def preview(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order."""
    return df.orderBy(*order_by).limit(n)


def union_corpus(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test notes together, each row tagged with its ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
