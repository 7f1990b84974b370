"""Long feature tables to ML vectors."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chartloom.operators.skew import HOT_ROWS, skewed_join
from chartloom.operators.vocabulary import vocabulary
from chartloom.session import cut_lineage


def with_vectors(rows: DataFrame, size: int, indices: Column, values: Column, name: str = "features") -> DataFrame:
    """``rows`` with an ML vector of sorted indices and values, as a stored table.

    There is no built-in constructor for sparse vectors. The layout in which a vector is stored is written as plain columns, and
    the table is read back with the vector type, so that no value is converted on the way.
    """
    layout = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values")
    )
    laid = rows.withColumn(name, layout)
    fields = [T.StructField(name, VectorUDT()) if f.name == name else f for f in laid.schema]
    return cut_lineage(laid, T.StructType(fields))


def term_index(rows: DataFrame) -> DataFrame:
    """``(term, count, idx)`` over the distinct terms of a long feature table, ids from 0."""
    ids = vocabulary(rows.groupBy("term").count(), first_id=0)
    return ids.withColumnRenamed("token_id", "idx")


def term_vectors(
    rows: DataFrame,
    key: str = "subject_id",
    index: DataFrame | None = None,
    max_features: int = 1 << 24,
    hot_rows: int = HOT_ROWS,
    keys: DataFrame | None = None,
) -> DataFrame:
    """``(key, features)``: the ``(key, term, weight)`` rows of a key as one sparse vector.

    Spark ML keeps a coefficient per feature on the driver, hence the explicit limit: a larger
    vocabulary raises instead of being cut. ``keys`` names all keys wanted: those without a row
    get the zero vector.
    """
    index = term_index(rows) if index is None else index
    n_features = index.count()
    if n_features > max_features:
        raise ValueError(f"{n_features} terms exceed max_features={max_features}; raise it or use fewer terms")
    coded = skewed_join(
        rows.select(key, "term", "weight"), index.select("term", "idx"), ["term"],
        spread_by=[key], freq=index.select("term", "count"), hot_rows=hot_rows,
    )
    entries = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("e"))
    if keys is not None:
        entries = keys.select(key).distinct().join(entries, key, "left")
    none = F.array().cast(entries.schema["e"].dataType)
    entries = entries.withColumn("e", F.coalesce("e", none))
    return with_vectors(entries, n_features, F.col("e.idx"), F.col("e.weight")).select(key, "features")
