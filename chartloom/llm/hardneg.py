"""Hard negatives: high-scoring rows of other labels, in a score window below each positive of an anchor.

Slot-decomposed selection. The positives of an anchor are its best rows of the same label; their scores, in falling order, are the upper limits of
overlapping windows, and cut the scores into disjoint slots: slot j holds what lies at or under limit j and above limit j + 1 (the last slot
has no lower end but that of the lowest window). One scan of the rows puts every negative into its one slot, and combiners, in each task
and after the shuffle, keep the k best of each (anchor, slot). The best k at or under limit j are then the best k of slots j, j + 1, ...:
merging slots from the lowest limit up answers all windows, and what lies under a window's lower limit falls off the end
of its list. So a negative is shuffled once, whatever number of windows hold it.

Two passes over the rows for each block of ``ANCHOR_ROWS`` anchors, one for positives and one for negatives; scores are matrix products of
the block with pieces of the scanned rows. The anchors are a stated query set against all rows, in blocks: a block costs each row
about two million multiplications, so reading the rows again for the next one is a small part. The driver and a task hold one block, its k-best lists and one
matrix of ``SCORES`` scores. Labels are compared, never grouped by, so a label may hold any share of the rows.

Cases: rows with a null id, a null label, a null vector, or null or non-finite components take no part. Shorter vectors count as padded with zeros.
Each row takes its own place, also if it repeats an id; rows with the anchor's id are none of its positives or negatives; of rows that repeat
an anchor's id the one with the smallest (label, vector) is the anchor. Ties go to the smaller id. Positives with equal scores have equal windows.
With fewer positives or negatives than asked for, all are returned. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chartloom.llm.common import frame, map_batches, only, table
from chartloom.session import shared_dir

POSITIVES, NEGATIVES, LOW_PERCENT = 5, 5, 80
ANCHOR_ROWS, SCORES = 1 << 14, 1 << 20
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_KEPT = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def points(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: rows that take part, each component times ``scale``, rounded down."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = only(vectors, "vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", label.cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows of ``dim`` numbers, short ones padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), dim))
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten())
    return out


class Slots:
    """The k best (score, then smaller id) of every (anchor, slot) so far."""

    def __init__(self, n: int, k: int):
        self.k, self.worst = k, np.full(n, np.iinfo(np.int64).min)
        self.kept = [np.zeros((3, 0), np.int64)]
        self.waiting = 0

    def offer(self, cell: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hopeful = scores >= self.worst[cell]
        self.kept.append(np.stack([cell[hopeful], ids[hopeful], scores[hopeful]]))
        self.waiting += self.kept[-1].shape[1]
        if self.waiting > SCORES:
            self.result()

    def result(self) -> np.ndarray:
        """``cell, id, score`` by cell, best first."""
        rows = np.concatenate(self.kept, axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        last = rows[:, place == self.k - 1]
        self.worst[last[0]] = last[2]
        self.kept, self.waiting = [rows[:, place < self.k]], 0
        return self.kept[0]


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integers: in doubles as long as these are exact."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def slot_of(values: np.ndarray, limits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The slot of each score (anchors by rows): the lowest of the anchor's falling limits that is not below it; -1: in no window."""
    slot = np.full(values.shape, -1, np.int32)
    for j in range(limits.shape[1]):
        slot += values <= limits[:, j : j + 1]
    slot[values < low[:, None]] = -1
    return slot


def combined(rows: DataFrame, shared: Broadcast, k: int, percent: int = LOW_PERCENT) -> DataFrame:
    """``anchor, slot, vec_id, score``: the k best of each slot in each task, for the shared anchors ``(ids, labels, vectors, limits)``.

    Without limits (None) there is one slot, of rows of the anchor's label; with them the slots hold rows of other labels. A missing limit is
    the smallest integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, x, limits = shared.value
        slots = 1 if limits is None else limits.shape[1]
        best = Slots(len(ids) * slots, k)
        if limits is not None:
            # The lowest score any window of the anchor holds: percent of a limit, upwards.
            known = limits > np.iinfo(np.int64).min
            low = np.where(known, -(-np.where(known, limits, 0) * percent // 100), np.iinfo(np.int64).max).min(axis=1)
        step = max(1, SCORES // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                own, other = np.asarray(part.column("vec_id")), np.asarray(part.column("label"))
                values = scores(x, matrix(part.column("v"), x.shape[1]))
                differ, same = ids[:, None] != own, label[:, None] == other
                if limits is None:
                    a, r = np.nonzero(same & differ & (values >= best.worst[:, None]))
                    cell = a
                else:
                    slot = slot_of(values, limits, low)
                    a, r = np.nonzero(~same & differ & (slot >= 0))
                    cell = a * slots + slot[a, r]
                best.offer(cell, own[r], values[a, r])
        cell, own, value = best.result()
        yield frame(_KEPT, cell // slots, cell % slots, own, value)

    return map_batches(rows, run, "anchor int, slot int, vec_id long, score long")


def best_of(kept: DataFrame, k: int, *cell: str) -> DataFrame:
    order = Window.partitionBy(*cell).orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def suffix_merge(kept: DataFrame, found: DataFrame, negatives: int = NEGATIVES, percent: int = LOW_PERCENT) -> DataFrame:
    """The result rows: ``kept`` are the k best of each slot, ``found`` the positives (``anchor_id, anchor, slot, positive_id, positive_score``).

    Every slot's list is merged into its own window and those of higher limits; what is below a window's lower limit is cut off the merged list.
    """
    offered = kept.select("anchor", F.explode(F.sequence(F.lit(0), F.col("slot"))).alias("slot"), "vec_id", "score")
    merged = best_of(offered, negatives, "anchor", "slot")
    return merged.join(found, ["anchor", "slot"]).filter(percent * F.col("positive_score") <= 100 * F.col("score")).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LOW_PERCENT, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``anchors`` against ``rows`` (both from ``points``)."""
    spark = rows.sparkSession
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")
    n, dim = anchors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = max(1, dim or 0, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    folder = f"{shared_dir(spark)}/table-{uuid4().hex}"
    spark.createDataFrame([], _RESULT).write.parquet(folder)
    blocks = ceil(n / anchor_rows)
    for number in range(blocks):
        block = anchors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        ids, label = np.asarray(block["vec_id"]).astype(np.int64), np.asarray(block["label"]).astype(np.int64)
        x = matrix(block["v"], dim)
        shared = spark.sparkContext.broadcast((ids, label, x, None))
        same = best_of(combined(rows, shared, positives), positives, "anchor").toArrow()
        shared.destroy()
        limits = np.full((len(ids), positives), np.iinfo(np.int64).min)
        limits[np.asarray(same["anchor"]), np.asarray(same["place"]) - 1] = np.asarray(same["score"])
        found = pa.table({
            "anchor_id": pa.array(ids[np.asarray(same["anchor"])]), "anchor": same["anchor"], "slot": pa.array(np.asarray(same["place"], dtype=np.int32) - 1),
            "positive_id": same["vec_id"], "positive_score": same["score"],
        })
        shared = spark.sparkContext.broadcast((ids, label, x, limits))
        kept = best_of(combined(rows, shared, negatives, percent), negatives, "anchor", "slot")
        suffix_merge(kept, spark.createDataFrame(found), negatives, percent).write.mode("append").parquet(folder)
        shared.destroy()
    return spark.read.schema(_RESULT).parquet(folder)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = points(table(spark, sf_dir, "embeddings"), label)
    return mine(rows, rows.filter("vec_id % 100 = 0"))
