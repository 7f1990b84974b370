"""Features that an L1 penalty keeps at zero, found before a logistic fit.

A feature has a weight only if the mean of its values times the errors of the rows exceeds the penalty. Errors lie in 0..1 for negative rows and
in -1..0 for positive ones, whatever the other weights are, so the sums of a feature's values by sign and label bound that mean. Without
the features whose bound is below the penalty the best weights are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chartloom.operators.hinge import entries, plain_vectors
from chartloom.operators.vectors import with_vectors


def gradient_bounds(rows: DataFrame, n: int, label: str = "readm") -> np.ndarray:
    """Of every feature, what the gradient of any ``n`` or more of the stored ``rows`` cannot exceed."""
    pull = F.when(F.col(label) == 1, F.col("value")).otherwise(-F.col("value"))
    up, down = (F.sum(F.greatest(p, F.lit(0.0))) for p in (pull, -pull))
    sums = entries(plain_vectors(rows), label).groupBy("idx").agg((F.greatest(up, down) / int(n)).alias("bound")).toArrow()
    bounds = np.zeros(rows.select("features").first()["features"].size)
    bounds[sums["idx"].to_numpy()] = sums["bound"].to_numpy()
    return bounds


def possible(bounds: np.ndarray, l1: float) -> np.ndarray:
    """The features that may have a weight, ascending; at least one. The margin covers the rounding of sums."""
    kept = np.flatnonzero(bounds * (1 + 1e-6) >= l1)
    return kept if len(kept) else np.array([int(np.argmax(bounds))])


def narrow(rows: DataFrame, kept: np.ndarray, label: str = "readm") -> DataFrame:
    """``(label, fold, features)`` of the stored ``rows`` with the features ``kept`` alone, numbered from 0."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(kept.astype(np.int32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = batch["indices"], batch["values"]
            starts = indices.offsets.to_numpy()
            own = indices.flatten().to_numpy()
            to = np.minimum(np.searchsorted(sent.value, own), len(sent.value) - 1)
            taken = sent.value[to] == own
            offsets = pa.array(np.concatenate([[0], np.cumsum(taken)])[starts - starts[0]].astype(np.int32))
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (to[taken].astype(np.int32), values.flatten().to_numpy()[taken]))
            yield pa.RecordBatch.from_arrays([batch[label], batch["fold"], *lists], names=[label, "fold", "indices", "values"])

    all_indices = F.coalesce("features.indices", F.sequence(F.lit(0), F.size("features.values") - 1))
    plain = plain_vectors(rows).select(label, "fold", all_indices.alias("indices"), F.col("features.values").alias("values"))
    return with_vectors(plain.mapInArrow(cut, plain.schema), len(kept), F.col("indices"), F.col("values")).select(label, "fold", "features")
