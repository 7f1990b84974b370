"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from chartloom.session import cut_lineage

HOT_ROWS = 1_000_000
NULL_PARTS = 1 << 16


def hot_keys(freq: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key above the row limit and into how many parts it is cut: at most rows / limit keys."""
    return (
        freq.filter(F.col("count") > hot_rows)
        .select(*on, F.ceil(F.col("count") / F.lit(float(hot_rows))).cast("int").alias("_parts"))
    )


def skewed_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    spread_by: Sequence[str],
    freq: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join many ``fact`` rows to ``dim`` on ``on``, cutting every hot key into parts.

    ``spread_by`` names fact columns that tell the rows of one key apart; a hash of them
    picks the part, so a re-run task sends each row to the same place. ``freq`` is an
    ``(on, count)`` table of the fact side, exact or an upper bound, for callers that can get
    it more cheaply than from the fact rows. Rows of ``dim`` are repeated once per part,
    hence only joins that keep fact rows are allowed. Rows with a null key match nothing; they
    are spread over many parts, so that they do not meet in one task. Whether the list of hot
    keys is broadcast is left to Spark, which knows its size.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    if freq is None:
        freq = fact.groupBy(*on).count()
    hot = hot_keys(freq, on, hot_rows)
    missing = reduce(or_, (F.col(c).isNull() for c in on))
    parts = F.coalesce("_parts", F.lit(1))
    left = (
        fact.join(hot, on, "left")
        .withColumn(
            "_part",
            F.when(missing, F.pmod(F.xxhash64(*spread_by), F.lit(NULL_PARTS)))
            .when(parts > 1, F.pmod(F.xxhash64(*spread_by), parts))
            .otherwise(0)
            .cast("int"),
        )
        .drop("_parts")
    )
    right = (
        dim.join(hot, on, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(right, [*on, "_part"], how).drop("_part")


CELLS_PER_PARTITION = 32


def join_grid(left: DataFrame, right: DataFrame, on: Sequence[str], cells: int | None = None) -> DataFrame:
    """``(*on, _rows, _columns)`` for every key whose pairs are cut: the rows of ``left`` into ``_rows`` parts, those of ``right`` into ``_columns``.

    A key of S and T rows makes S * T pairs. One cell may hold the share of all pairs that ``cells`` equal cells have (default: 32 a
    shuffle partition), so there are at most about that many cut keys. A part of either side meets every part of the other,
    and the numbers of parts follow the sizes of the sides, which keeps the repeated rows fewest.
    """
    if cells is None:
        cells = CELLS_PER_PARTITION * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_s")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_t")), list(on))
    work = F.col("_s").cast("double") * F.col("_t")
    limit = F.greatest(F.lit(1.0), F.col("_all") / F.lit(float(cells)))
    parts = F.ceil(work / limit)
    # as many parts of each side as make cells square, at most one row to a part
    rows = F.least(F.col("_s"), F.greatest(F.lit(1), F.round(F.sqrt(parts * F.col("_s") / F.col("_t"))).cast("long")))
    columns = F.least(F.col("_t"), F.ceil(parts / rows))
    return (
        pairs.withColumn("_all", pairs.agg(F.sum(work)).scalar())
        .filter(work > limit)
        .select(*on, rows.cast("int").alias("_rows"), columns.cast("int").alias("_columns"))
    )


def deal(side: DataFrame, grid: DataFrame, on: Sequence[str], spread: Sequence[str], own: str, other: str) -> DataFrame:
    """``side`` with its cells: each row of a cut key in one part of its ``own`` dimension and all parts of the ``other``."""
    return (
        side.join(grid, list(on), "left")
        .withColumn(f"{own}_part", F.pmod(F.xxhash64(*spread), F.coalesce(F.col(own), F.lit(1))).cast("int"))
        .withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
        .drop("_rows", "_columns")
    )


def grid_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, left_spread: Sequence[str], right_spread: Sequence[str], cells: int | None = None
) -> DataFrame:
    """Inner join of two large tables that both hold some keys often: such keys are cut on both sides.

    Every row of a cut key goes to one part of its own side, by a hash of its ``spread`` columns, and is repeated once for each part of the other
    side, so each pair meets in exactly one cell. Without cut keys it is the plain join. The list of cut keys has at most about ``cells``
    rows; Spark chooses how to join it. Null keys match nothing and are left out at once.
    """
    on = list(on)
    left, right = left.dropna(subset=on), right.dropna(subset=on)
    grid = cut_lineage(join_grid(left, right, on, cells))
    cell = [*on, "_rows_part", "_columns_part"]
    dealt = deal(left, grid, on, left_spread, "_rows", "_columns").join(deal(right, grid, on, right_spread, "_columns", "_rows"), cell)
    return dealt.drop("_rows_part", "_columns_part")
