"""Exact top-k inner products by dual-tree search over cover trees.

Rows are packed into blocks by the tasks that scan them, each with its cover tree: the children of a node of
radius r are centres more than r / 2 apart, every point lies within r / 2 of its child's centre, and the first child has the
node's own centre. Queries come in blocks of bounded size with a tree of their own. Both trees are descended together: a
pair of nodes with centres c, d and radii r, s is given up when c.d + r |d| + s |c| + r s, the highest possible
score between them, is below the worst k-th score of the query node. A task carries its queries' best scores from block to
block and returns k rows per query; a ranked window merges tasks.

Each query block is one pass over the packed rows: a stated query set against all rows, in blocks.

Cases: vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded with
zeros. ``vec_id`` is the key: rows with the query's own id (null: none) are no candidates for it. Ties go to the smaller id. With fewer than k candidates
all are returned. Equal vectors of a block beyond k + 1 cannot be among the best and are skipped, as ids decide between them. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chartloom.llm.common import map_batches, only, table
from chartloom.session import cut_lineage

BLOCK_ROWS, QUERY_ROWS, LEAF = 4096, 8192, 24


@dataclass
class CoverTree:
    """Nodes in preorder: centre (row), radius, rows ``start:stop`` of the permutation ``order``, children."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    children: list[np.ndarray]


def build(x: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """A cover tree of the rows of ``x``."""
    order = np.arange(len(x))
    centre, radius, start, stop, children = [], [], [], [], []
    todo = [(0, len(x), None, -1)]
    while todo:
        a, b, own, parent = todo.pop()
        rows = order[a:b]
        own = rows[0] if own is None else own
        far = np.sqrt(((x[rows] - x[own]) ** 2).sum(axis=1))
        number = len(centre)
        centre.append(own), radius.append(float(far.max())), start.append(a), stop.append(b), children.append([])
        if parent >= 0:
            children[parent].append(number)
        if b - a <= leaf or radius[-1] == 0:
            continue
        limit, near, which, picked = radius[-1] / 2, far, np.zeros(b - a, np.int64), [own]
        while near.max() > limit:
            k = int(near.argmax())
            d = np.sqrt(((x[rows] - x[rows[k]]) ** 2).sum(axis=1))
            closer = d < near
            near, which = np.where(closer, d, near), np.where(closer, len(picked), which)
            picked.append(rows[k])
        by = np.argsort(which, kind="stable")
        order[a:b] = rows[by]
        cuts = a + np.searchsorted(which[by], np.arange(len(picked) + 1))
        todo += [(int(cuts[k]), int(cuts[k + 1]), picked[k], number) for k in reversed(range(len(picked)))]
    return CoverTree(order, np.array(centre), np.array(radius), np.array(start), np.array(stop), [np.array(c, dtype=np.int64) for c in children])


class Best:
    """The k best scores of each query so far, best first; empty places hold the lowest score."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Offer every candidate of ``ids`` to every query of ``queries``."""
        hopeful = (scores >= self.score[queries, -1:]).any(axis=1)
        if not hopeful.any():
            return
        queries, scores = queries[hopeful], scores[hopeful]
        s = np.concatenate([self.score[queries], scores], axis=1)
        i = np.concatenate([self.id[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        by_id = np.argsort(i, axis=1, kind="stable")
        s, i = np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
        self.score[queries], self.id[queries] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, qt: CoverTree, x: np.ndarray, ids: np.ndarray, xt: CoverTree, best: Best) -> int:
    """Offer to every query all rows of ``x`` that can matter; returns how many scores were worked out."""
    q_norm, x_norm = (np.sqrt((v**2).sum(axis=1)) for v in (queries, x))
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(x).max(initial=0)) * queries.shape[1] < 2**53
    done = 0

    def score(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        if exact:
            return queries[rows] @ x[cols].T
        return (queries[rows].astype(np.int64) @ x[cols].astype(np.int64).T).astype(np.float64)

    def descend(node: int, others: np.ndarray) -> None:
        nonlocal done
        rows = qt.order[qt.start[node] : qt.stop[node]]
        c, r = qt.centre[node], qt.radius[node]
        while len(others):
            d, s = xt.centre[others], xt.radius[others]
            bound = x[d] @ queries[c] + r * x_norm[d] + s * q_norm[c] + r * s
            slack = 1e-9 * (1 + np.abs(bound))
            by = np.argsort(-bound, kind="stable")
            others, bound = others[by], (bound + slack)[by]
            if len(qt.children[node]):
                others = others[bound >= best.score[rows, -1].min()]
                inner = [xt.children[o] if len(xt.children[o]) else o[None] for o in others]
                others = np.concatenate(inner) if inner else others[:0]
                for child in qt.children[node]:
                    descend(int(child), others)
                return
            # A query leaf: the best nodes first, so that the worst k-th score rises early.
            deeper = []
            for k in range(0, len(others), 256):
                part, high = others[k : k + 256], bound[k : k + 256]
                part = part[high >= best.score[rows, -1].min()]
                leaves = [o for o in part if not len(xt.children[o])]
                deeper += [xt.children[o] for o in part if len(xt.children[o])]
                if leaves:
                    cols = np.concatenate([xt.order[xt.start[o] : xt.stop[o]] for o in leaves])
                    values = score(rows, cols)
                    done += values.size
                    values[query_ids[rows][:, None] == ids[cols][None, :]] = -np.inf
                    best.add(rows, ids[cols], values)
            others = np.concatenate(deeper) if deeper else others[:0]

    if len(queries) and len(x):
        descend(0, np.zeros(1, np.int64))
    return done


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: each component times ``scale``, rounded down; vectors with null or non-finite components left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return only(vectors, "vec_id", "embedding").filter(F.col("embedding").isNotNull() & fine).select(
        "vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v")
    )


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim))
    sizes = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(lists)), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, col] = np.asarray(lists.flatten())
    return out


def _few_copies(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` rows, those with the smallest ids, of each distinct vector."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    _, same = np.unique(x, axis=0, return_inverse=True)
    by = np.argsort(same.reshape(-1), kind="stable")
    group = same.reshape(-1)[by]
    place = np.arange(len(by)) - np.searchsorted(group, group)
    keep = np.sort(by[place < most])
    return x[keep], ids[keep]


def packed(rows: DataFrame, dim: int, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the scanned rows as ``ids, data`` (64-bit little-endian integers and doubles), in the order tasks meet them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def block() -> pa.RecordBatch:
            i = np.concatenate(ids)
            # A query leaves out its own rows: as many as share one id here.
            x, i = _few_copies(np.concatenate(parts), i, k + int(np.unique(i, return_counts=True)[1].max()))
            return pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ids.append(np.asarray(part.column("vec_id")))
                parts.append(_matrix(part.column("v"), dim))
                if sum(map(len, ids)) >= block_rows:
                    yield block()
                    ids, parts = [], []
        if ids:
            yield block()

    return map_batches(rows.filter(F.col("vec_id").isNotNull()), run, "ids binary, data binary")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, scale: int = 256, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query with all vectors but its own.

    Every row is a vector: rows that repeat a ``vec_id`` take a rank each, and a query leaves out all rows of its id.
    """
    spark = vectors.sparkSession
    rows, asked = scaled(vectors, scale), scaled(queries, scale).filter(F.col("vec_id").isNotNull()).dropDuplicates(["vec_id"])
    size = F.max(F.size("v"))
    dim = max(rows.agg(size).first()[0] or 1, asked.agg(size).first()[0] or 1)
    blocks = cut_lineage(packed(rows, dim, k))
    found = None
    n = max(1, ceil(asked.count() / query_rows))
    for number in range(n):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == number).toArrow().combine_chunks()
        lists = part.column("v").combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.float64()))
        q, q_ids = _matrix(lists, dim), np.asarray(part.column("vec_id")).astype(np.int64)
        shared = spark.sparkContext.broadcast((q, q_ids, build(q) if len(q) else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, q_ids, tree = shared.value
            best = Best(len(q), k)
            if len(q):
                for batch in batches:
                    for ids, data in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist()):
                        x = np.frombuffer(data).reshape(-1, dim)
                        search(q, q_ids, tree, x, np.frombuffer(ids, np.int64), build(x), best)
            row, place = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[row]), pa.array(best.id[row, place]), pa.array(best.score[row, place].astype(np.int64))], names=["query_id", "vec_id", "score"]
            )

        part = map_batches(blocks, run, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5)
