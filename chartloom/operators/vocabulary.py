"""Term ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartloom.operators.ranking import hash_rank

# Ids of the special tokens.
PAD_ID = 0
UNK_ID = 100
CLS_ID = 101
SEP_ID = 102


def vocabulary(term_totals: DataFrame, min_count: int = 1, first_id: int = SEP_ID + 1) -> DataFrame:
    """``(term, count, token_id)`` with consecutive ids for terms seen ``min_count`` times.

    ``term_totals`` is ``(term, count)``. Ids follow a hash order, which needs no global sort.
    """
    kept = term_totals.filter(F.col("count") >= min_count)
    return hash_rank(kept, "term", seed=0).select(
        "term", "count", (F.col("rank") + (first_id - 1)).cast("int").alias("token_id")
    )
