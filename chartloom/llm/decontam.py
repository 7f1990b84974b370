"""Benchmark decontamination: size-partitioned MinHash search for test items inside documents.

An item is found in a document when at least ``threshold`` of its distinct five-word shingles
occur there. Items are partitioned by size (powers of two). The sketch of an item is its
smallest MinHash values, and the partition's size says how many are kept: so many that a
document holding the threshold share of the item cannot miss all of them. Documents probe with all
their hashes those partitions whose items fit into their own size. Candidates are verified on
the words themselves, so the result is exact: nothing is estimated and no match is lost.

Words are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lowered.

Cases: null or empty text, or fewer than five words: no shingle, nothing found (documents) or never
found (items). Items with equal shingle sets are all reported. Equal rows in ``docs`` each give their rows.
An empty table on either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import Words, distinct_by_row, frame, map_batches, only, pieces, table, word_class

INSIDE = word_class((48, 57), (97, 122), (128, 255))
SIZE, PERCENT = 5, 80
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


def needed(n: int, percent: int = PERCENT) -> int:
    """How many of ``n`` shingles a document must hold."""
    return -(-n * percent // 100)


class SketchIndex:
    """The items of one block: sketches by size partition, and each item's shingles as words for the final test."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int = SIZE, percent: int = PERCENT):
        self.size = size
        words = Words(pa.array(texts, pa.string()), INSIDE)
        h, row, at = words.shingles(size)
        self.items = []  # of each: id, set of its shingles
        self.parts = []  # of each size partition: fewest shingles a document needs, sorted sketch values, their items
        by_row = defaultdict(dict)
        for value, d, k in zip(h, row, at):
            by_row[d][int(value)] = b" ".join(words.text(k + j) for j in range(size))
        sketches = defaultdict(list)
        for d, found in by_row.items():
            n, number = len(found), len(self.items)
            self.items.append((ids[d], frozenset(found.values()), needed(n, percent)))
            most = 1 << (n - 1).bit_length()  # the partition holds sizes in (most / 2, most]
            keep = max(m - needed(m, percent) + 1 for m in range(most // 2 + 1, most + 1))
            sketches[most] += [(value, number) for value in sorted(found)[:keep]]
        for most, pairs in sorted(sketches.items()):
            pairs.sort()
            self.parts.append((needed(most // 2 + 1, percent), np.array([v for v, _ in pairs], np.uint64), np.array([i for _, i in pairs])))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item id, item size, shared)`` of every item found in every text."""
        words = Words(texts, INSIDE)
        h, row, at = words.shingles(self.size)
        _, distinct = distinct_by_row(h, row)
        sizes = np.bincount(distinct, minlength=len(texts))
        candidates = set()
        for least, values, items in self.parts:
            place = np.minimum(np.searchsorted(values, h), len(values) - 1)
            hit = np.flatnonzero((values[place] == h) & (sizes[row] >= least))
            for k in hit:
                p = int(place[k])
                while p < len(values) and values[p] == h[k]:
                    candidates.add((int(row[k]), int(items[p])))
                    p += 1
        last, own = -1, set()
        for d, number in sorted(candidates):
            if d != last:
                a, b = words.first[d], words.first[d + 1]
                w = [words.text(k) for k in range(a, b)]
                last, own = d, {b" ".join(w[k : k + self.size]) for k in range(len(w) - self.size + 1)}
            item, shingles, need = self.items[number]
            shared = len(shingles & own)
            if shared >= need:
                yield d, item, len(shingles), shared


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items in blocks of about ``block_bytes`` of text by a hash of their id; one block when they are few."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_item, n_shared, containment``.

    Items go to the executors in blocks of bounded bytes; each block is one pass over the documents,
    without a shuffle.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    found = None
    for ids, texts in _blocks(only(items, "item_id", "text"), block_bytes):
        shared = spark.sparkContext.broadcast(SketchIndex(ids, texts, percent=percent))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for piece in pieces(batch, "text"):
                    rows = list(index.search(piece.column("text")))
                    if rows:
                        own = piece.column("doc_id").to_pylist()
                        yield frame(_ARROW, *zip(*((own[d], i, n, s, s / n) for d, i, n, s in rows)))

        part = map_batches(docs, search, SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they were, in which no item is found. Rows with a null ``doc_id`` are judged alike."""
    ids = contained_items(docs, items, percent).select("doc_id").distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
