"""Table, report and model sinks."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table and return its path; a CSV path gets its suffix when it lacks one."""
    if fmt == "csv":
        path = path if path.endswith(".csv") else path + ".csv"
        df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_splits(df: DataFrame, path: str, column: str = "split") -> str:
    """One sub-folder per split, so a reader of one split prunes the others."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    return path


def write_report(metrics: DataFrame, path: str) -> str:
    """A metrics table (a handful of rows) as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_model(model: MLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path
