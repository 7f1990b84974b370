"""MinHash near-duplicate detection with tensored banding.

Two small collections of sub-keys, each of ``ROWS`` MinHash values, are computed per document; a table's key is the
combination of one sub-key from each, so m + m sub-keys make m * m tables. A pair of similarity s meets in no table with
probability about ``2 * (1 - s ** ROWS) ** m``; m is chosen to keep that below ``miss`` at the threshold.

1. Documents with equal shingle sets form a class; its smallest ``doc_id`` stands for it (partial aggregate).
2. Representatives meet in tables, keyed by combinations of sub-keys they share with others. Buckets with the same members are taken once.
3. Buckets of at most ``SMALL`` members are verified whole. Larger ones are merged where they overlap, and
   the merged cells are cut into tiles of about ``TILE``; every pair of tiles is verified. No pair is left out, no task sees more than
   two tiles, and no pairs are emitted: a task counts intersections of its full sets by products of their 0/1 matrices and
   returns a spanning forest of the links it found.
4. Components of links by label propagation.

Cases: null or empty text, or text without words: empty set, linked with nothing, its own component. ``doc_id`` is the
key: rows repeating one with the same text repeat its row; with different texts, links are sought by the greater text. Null ``doc_id`` gives no row. An empty table gives an empty result. Fewer words than a
shingle: all words as one shingle. Sets are compared by 64-bit hashes of their shingles. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import Words, distinct_by_row, frame, map_batches, mix, only, pieces, table, word_class
from chartloom.llm.components import components
from chartloom.session import cut_lineage

INSIDE = ~word_class((9, 13), (32, 32))
ROWS = 3
MISS = 4e-4
SMALL, TILE = 64, 128
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sub", pa.list_(pa.int64()))])


def collections_for(percent: int, miss: float = MISS) -> int:
    """Sub-keys per collection."""
    return ceil(log(miss / 2) / log(1 - (percent / 100) ** ROWS))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts in a row, and the offsets of each text."""
    h, row, _ = Words(texts, INSIDE).shingles(size, short=True)
    h, row = distinct_by_row(h, row)
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


def sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    """``doc_id, n`` (set size), ``f1, f2`` (128-bit fingerprint of the set), ``sub`` (2 * m sub-keys; null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                h, first = shingle_sets(piece.column("text"), size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sub = np.zeros((len(full), 2 * m), np.uint64)
                if len(full):
                    starts = first[full]
                    with np.errstate(over="ignore"):
                        f1[full] = np.add.reduceat(mix(h, 101), starts)
                        f2[full] = np.add.reduceat(mix(h, 102), starts)
                        for j in range(2 * m):
                            for k in range(ROWS):
                                sub[:, j] = mix(sub[:, j] + np.minimum.reduceat(mix(h, j * ROWS + k), starts), k)
                where = np.zeros(len(n) + 1, np.int64)
                np.cumsum(np.where(n > 0, 2 * m, 0), out=where[1:])
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(sub.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], schema=_SKETCH
                )

    return map_batches(docs, run, "doc_id long, n long, f1 long, f2 long, sub array<long>")


def table_keys(full: DataFrame, m: int) -> DataFrame:
    """``(rep, key)`` in every table where the representative may meet another.

    A key combines a sub-key of the first collection with one of the second, so two sets meet in a table only
    where both sub-keys are equal. Sub-keys that no two representatives share are left out before any are combined.
    A key holds a representative once, however many rows repeat it: buckets are told apart by the xor of their members.
    """
    subs = full.select(F.col("doc_id").alias("rep"), F.posexplode("sub").alias("slot", "value")).withColumn("sub", F.xxhash64("slot", "value"))
    shared = cut_lineage(subs.groupBy("sub").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("sub"))
    own = subs.join(shared, "sub").groupBy("rep").agg(F.collect_set(F.when(F.col("slot") < m, F.col("sub"))).alias("a"), F.collect_set(F.when(F.col("slot") >= m, F.col("sub"))).alias("b"))
    return own.select("rep", "b", F.explode("a").alias("x")).select("rep", "x", F.explode("b").alias("y")).select("rep", F.xxhash64("x", "y").alias("key"))


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of positions whose sets have similarity of ``percent`` at least."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = number[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((n, n), np.float64)
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(at, [low, low + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], at[a:b] - low] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.argwhere(np.triu((100 * common >= percent * union) & (common > 0), 1))


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Each position with the smallest one it is joined to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(find(x), x) for x in list(root) if find(x) != x]


def _verified(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` within each task of ``rows`` (task, rep, text)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(reps: list[int], texts: list[str | None]) -> list[tuple[int, int]]:
        h, first = shingle_sets(pa.array(texts, pa.large_string()), size)
        found = forest(linked_pairs([h[first[k] : first[k + 1]] for k in range(len(reps))], percent))
        return [(reps[a], reps[b]) for a, b in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, reps, texts, out = None, [], [], []
        for batch in batches:
            for t, rep, text in zip(*(batch.column(c).to_pylist() for c in ("task", "rep", "text"))):
                if t != task:
                    if len(reps) > 1:
                        out += links(reps, texts)
                    task, reps, texts = t, [], []
                reps.append(rep)
                texts.append(text)
            if len(out) > 10_000:
                yield frame(schema, *zip(*out))
                out = []
        if len(reps) > 1:
            out += links(reps, texts)
        if out:
            yield frame(schema, *zip(*out))

    return map_batches(rows.repartition(F.col("task")).sortWithinPartitions("task"), run, "a long, b long")


def _tasks(members: DataFrame) -> DataFrame:
    """``(task, rep)`` rows that cover every pair meeting in a bucket of ``members`` (key, rep, count, leader)."""
    small = members.filter(F.col("count") <= SMALL).select(F.col("key").alias("task"), "rep")
    large = members.filter(F.col("count") > SMALL)
    if large.isEmpty():
        return small
    # Members of a bucket are connected through its leader. Each names the least of its leaders, and a leader is tied to
    # the names its members gave: as connected as all pairs of member and leader, but with few edges.
    named = cut_lineage(large.groupBy("rep").agg(F.min("leader").alias("name")))
    tied = large.join(named, "rep").select(F.col("leader").alias("a"), F.col("name").alias("b")).distinct()
    cells = components(named.select(F.col("rep").alias("a"), F.col("name").alias("b")).unionByName(tied))
    sizes = cells.groupBy("component").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("tiles"))
    placed = cut_lineage(cells).join(cut_lineage(sizes), "component").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    # Tile t takes part in the tasks (t, u) and (u, t) for every other tile u, and in (t, t).
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    paired = placed.withColumn("other", other).select(
        F.xxhash64("component", F.least("tile", "other"), F.greatest("tile", "other"), F.lit("tile")).alias("task"), F.col("id").alias("rep")
    )
    return small.unionByName(paired)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document; equal texts are never paired with each other."""
    m = collections_for(percent, miss)
    docs = only(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull())
    sk = cut_lineage(sketches(docs, size, m))
    full = sk.filter("n > 0")
    # 1: classes of equal sets
    classes = cut_lineage(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")))
    placed = cut_lineage(full.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).select("doc_id", "n", "rep"))
    # 2: tables, of representatives only
    keys = cut_lineage(table_keys(full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), m))
    buckets = (
        keys.groupBy("key")
        .agg(F.count("*").alias("count"), F.min("rep").alias("leader"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2"))
        .filter("count > 1")
    )
    once = cut_lineage(buckets.groupBy("count", "leader", "x1", "x2").agg(F.min("key").alias("key")).select("key", "count", "leader"))
    members = cut_lineage(keys.join(once, "key"))
    # 3: verification on full sets
    tasks = cut_lineage(_tasks(members))
    reps = cut_lineage(tasks.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.join(reps, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.max("text").alias("text"))
    found = cut_lineage(_verified(tasks.join(texts, "rep").select("task", "rep", "text"), size, percent).distinct())
    # 4: components
    merged = components(found)
    linked = placed.join(cut_lineage(merged.withColumnRenamed("id", "rep")), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    empty = sk.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they were, with one (the smallest ``doc_id``) of each component; null ids stay."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
