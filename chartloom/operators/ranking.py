"""Exact positions in a hash order without sending a whole group to one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from chartloom.session import cut_lineage

_PREFIX = 4  # hex digits: 65,536 buckets


def hash_order(key: Column, seed: int) -> Column:
    """Seeded, engine-independent pseudo-random order of a key; null comes first."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string"))), F.lit(""))


def hash_sample(
    rows: DataFrame, key: str, strata: Sequence[str], sizes: Callable[[DataFrame], DataFrame], seed: int = 1
) -> DataFrame:
    """``(key, *strata)`` of the rows that come first in hash order, as many per stratum as its quota says.

    The same rows as those with ``hash_rank`` up to the quota, without ranking the table: a histogram of 65,536 buckets a stratum
    tells in which bucket each quota ends, all rows of the buckets before are taken, and only rows of that bucket are
    ranked. ``sizes`` makes ``(*strata, quota)`` from the histogram ``(*strata, _bucket, count)``; strata without a quota give nothing. The rows
    (keys and strata alone) and the ends of the quotas are written, as they are read more than once.
    """
    strata = list(strata)
    hashed = cut_lineage(rows.select(key, *strata)).withColumn("_hash", hash_order(F.col(key), seed)).withColumn("_bucket", F.substring("_hash", 1, _PREFIX))
    counts = hashed.groupBy(*strata, "_bucket").count().coalesce(1)  # a fixed number of rows a stratum
    running = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = sizes(counts)
    joined = counts.withColumn("_reached", F.sum("count").over(running))
    joined = joined.join(F.broadcast(quotas), strata) if strata else joined.withColumn("quota", quotas.scalar())
    # one row a stratum: the bucket in which its quota ends (after all of them if it covers the stratum), and what is left of it there
    ends = cut_lineage(joined.groupBy(*strata).agg(
        F.coalesce(F.min(F.when(F.col("_reached") > F.col("quota"), F.col("_bucket"))), F.lit("g")).alias("_end"),
        (F.max("quota") - F.coalesce(F.max(F.when(F.col("_reached") <= F.col("quota"), F.col("_reached"))), F.lit(0))).alias("_left"),
    ))
    if strata:
        placed = hashed.join(F.broadcast(ends), strata)
    else:
        placed = hashed.withColumns({c: ends.select(c).scalar() for c in ("_end", "_left")})
    within = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    last = placed.filter("_bucket = _end").withColumn("_position", F.row_number().over(within)).filter("_position <= _left")
    return placed.filter("_bucket < _end").select(key, *strata).unionByName(last.select(key, *strata))


def hash_rank(df: DataFrame, key: str, strata: Sequence[str] = (), seed: int = 1, name: str = "rank") -> DataFrame:
    """Add the 1-based position of each (distinct) key in hash order within its stratum.

    Null is a stratum of its own, and a null key counts as a key. Rows are ranked inside buckets named by the first hash digits, and the number of rows in
    the buckets before is added. A bucket holds 1/65,536 of a stratum, and the bucket sizes
    broadcast back are at most 65,536 rows per stratum.
    """
    strata = list(strata)
    hashed = df.withColumn("_hash", hash_order(F.col(key), seed)).withColumn(
        "_bucket", F.substring("_hash", 1, _PREFIX)
    )
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*strata, "_bucket")
        .count()
        .select(*strata, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    offsets = offsets.select(*(F.col(c).alias(f"_{c}") for c in strata), F.col("_bucket").alias("_b"), "_offset")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in strata), F.col("_bucket") == F.col("_b"))
    within = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_position", F.row_number().over(within))
        .join(F.broadcast(offsets), same)
        .withColumn(name, F.col("_offset") + F.col("_position"))
        .drop("_hash", "_bucket", "_b", "_position", "_offset", *(f"_{c}" for c in strata))
    )
