"""Ranked lexical search with documents reduced to classes of equal term counts.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lowered. The score of a document for an item is the sum
over the item's distinct terms of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and
``m = 10 + (90 * n * N) div L``, in 64-bit integers but for w (see ``search``).

Bag deduplication: one pass over the texts restricts each document to the items' vocabulary, as a vector of (term, tf) pairs.
A document's scores depend on that vector and m alone, so documents are grouped by both: the rows are sent to tasks by a hash, and
the whole vectors are compared there, so equal hashes alone make no class; every map task merges its own copies first. Each class is
scored once, through the items' postings, and every task keeps the k best classes of each item, by score, then smallest doc_id. That is enough: a document
among the k best lies in one of the k best classes. These few classes are then expanded: of each the k members with the smallest doc_id are
taken, and a ranked window gives the result. No class is collected, however large.

Words are found by 64-bit hashes of a vocabulary without hash collisions, and each hit is compared with the term's bytes.

Items come in blocks of ``ITEM_BYTES`` of text, a stated query set against all rows: a block's vocabulary, its postings and df are all
that the driver and each task hold. The corpus statistics (N, L, df) cover all documents.

Cases: null and empty texts, and texts without a term, are no documents (not in N) and never found. Each row is a document: rows that repeat
a doc_id, or equal texts, each take a rank; ties go to the smaller doc_id, null last. Items that share an item_id (null included) count as one
item with the terms of all. Items without a term, or whose terms no document holds, give no rows. Empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chartloom.llm.common import Words, frame, map_batches, only, pieces, table, word_class
from chartloom.session import cut_lineage

INSIDE = word_class((48, 57), (97, 122), (128, 255))
ITEM_BYTES = 16 << 20
PAIRS = 1 << 20  # (class, item) contributions worked out at a time
LAST = np.iinfo(np.int64).max  # stands for a null doc_id when classes are ordered
_BAGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("bag", pa.binary())])
_DF = pa.schema([("term", pa.int64()), ("df", pa.int64())])
_FOUND = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("hash", pa.int64()), ("m", pa.int64()), ("leader", pa.int64())])


class Vocabulary:
    """The distinct terms of a block of items, and which items hold each.

    ``values`` holds the sorted hashes, ``data``, ``start`` and ``size`` the terms in that order; the items of term ``t`` are
    ``items[first[t]:first[t + 1]]``.
    """

    def __init__(self, texts: list[str | None], item: list[int]):
        words = Words(pa.array(texts, pa.string()), INSIDE)
        size = words.end - words.start
        self.values, where, number = np.unique(words.hash, return_index=True, return_inverse=True)
        self.data = words.data
        self.start, self.size = words.start[where], size[where]
        if not self._same(words, np.arange(len(number)), number).all():
            raise ValueError("two terms of one block share a hash: use smaller blocks")
        pairs = np.unique(np.stack([number, np.asarray(item, np.int64)[words.doc]], axis=1), axis=0) if len(number) else np.zeros((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.values) + 1))

    def _same(self, words: Words, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether each word ``at`` has the very bytes of its ``term``."""
        size = self.size[term]
        same = words.end[at] - words.start[at] == size
        at, term, size, rows = at[same], term[same], size[same], np.flatnonzero(same)
        if len(rows):
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = words.data[np.repeat(words.start[at], size) + inner] != self.data[np.repeat(self.start[term], size) + inner]
            same[rows] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
        return same

    def bags(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Of each text the number of its terms, and its vector: all term numbers in order, then their counts, as 32-bit integers."""
        words = Words(texts, INSIDE)
        n = np.diff(words.first)
        row = term = np.zeros(0, np.int64)
        if len(self.values) and len(words.hash):
            term = np.minimum(np.searchsorted(self.values, words.hash), len(self.values) - 1)
            at = np.flatnonzero(self.values[term] == words.hash)
            at = at[self._same(words, at, term[at])]
            row, term = words.doc[at], term[at]
        key, tf = np.unique(row * max(1, len(self.values)) + term, return_counts=True)
        row, term = np.divmod(key, max(1, len(self.values)))
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        term, tf = term.astype("<i4"), tf.astype("<i4")
        return n, [term[a:b].tobytes() + tf[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def unpack(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of these vectors."""
    size = np.array([len(b) // 8 for b in bags], np.int64)
    both = np.frombuffer(b"".join(bags), "<i4").astype(np.int64)
    at = np.arange(size.sum()) + np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(bags)), size), both[at], both[at + np.repeat(size, size)]


class BestClasses:
    """The k best classes of each item so far: highest score, then smallest leader. Buffered offers are cut as they pile up."""

    def __init__(self, n_items: int, k: int):
        self.k, self.worst = k, np.zeros(n_items, np.int64)
        self.kept = [np.zeros((5, 0), np.int64)]
        self.waiting = 0

    def offer(self, *columns: np.ndarray) -> None:
        """``item, score, hash, m, leader`` of candidates; those below an item's k-th best score are dropped at once."""
        hopeful = (columns[1] >= self.worst[columns[0]]) & (columns[1] > 0)
        if hopeful.any():
            self.kept.append(np.stack([c[hopeful] for c in columns]))
            self.waiting += int(hopeful.sum())
            if self.waiting > 4 * self.k * len(self.worst) + PAIRS:
                self.result()

    def result(self) -> np.ndarray:
        rows = np.concatenate(self.kept, axis=1)
        rows = rows[:, np.lexsort((rows[4], -rows[1], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        last = rows[:, place == self.k - 1]
        self.worst[last[0]] = last[1]
        self.kept, self.waiting = [rows[:, place < self.k]], 0
        return self.kept[0]


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int | None], Vocabulary]]:
    """Items by a hash of their id, in blocks of about ``block_bytes`` of text: their ids and vocabulary."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        ids = list(dict.fromkeys(r.item_id for r in rows))
        number = {i: j for j, i in enumerate(ids)}
        yield ids, Vocabulary([r.text for r in rows], [number[r.item_id] for r in rows])


def bags(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``doc_id, n, bag`` of every document with a term: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                n, vectors = shared.value.bags(piece.column("text"))
                some = np.flatnonzero(n)
                if len(some):
                    yield frame(_BAGS, piece.column("doc_id").take(pa.array(some)), n[some], [vectors[k] for k in some])

    return map_batches(docs, run, "doc_id long, n long, bag binary")


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term: counted by every task, summed by term, one number a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for piece in pieces(batch, "bag"):
                df += np.bincount(unpack(piece.column("bag").to_pylist())[1], minlength=terms)
        held = np.flatnonzero(df)
        yield frame(_DF, held, df[held])

    out = np.zeros(terms, np.int64)
    sums = map_batches(rows.select("bag"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[np.asarray(sums["term"])] = np.asarray(sums["df"])
    return out


def best_classes(classes: DataFrame, shared: Broadcast, weight: np.ndarray, n_items: int, k: int) -> DataFrame:
    """The k best classes of each item in each task: ``item, score, hash, m, leader``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, best = shared.value, BestClasses(n_items, k)
        postings = np.diff(vocabulary.first)
        for batch in batches:
            for piece in pieces(batch, "bag"):
                row, term, tf = unpack(piece.column("bag").to_pylist())
                h, m, leader = (np.asarray(piece.column(c)) for c in ("hash", "m", "leader"))
                part = weight[term] * ((10**9 * tf) // (1000 * tf + 8 * m[row]))
                # Whole classes at a time, as many as their contributions fit into the limit: one at least.
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, postings[term], len(m)))])
                entry = np.searchsorted(row, np.arange(len(m) + 1))
                a = 0
                while a < len(m):
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + PAIRS, side="right")) - 1)
                    inside = slice(entry[a], entry[b])
                    size = postings[term[inside]]
                    at = np.arange(size.sum()) + np.repeat(vocabulary.first[term[inside]] - np.cumsum(size) + size, size)
                    pair = np.repeat(row[inside] - a, size) * n_items + vocabulary.items[at]
                    order = np.argsort(pair, kind="stable")
                    pair, value = pair[order], np.repeat(part[inside], size)[order]
                    if len(pair):
                        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                        own, item = np.divmod(pair[new], n_items)
                        own += a
                        best.offer(item, np.add.reduceat(value, new), h[own], m[own], leader[own])
                    a = b
        found = best.result()
        yield frame(_FOUND, *found)

    return map_batches(classes, run, "item long, score long, hash long, m long, leader long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring rows of ``docs`` (``doc_id, text``) of each item (``item_id, text``)."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    found = None
    for ids, vocabulary in _blocks(only(items, "item_id", "text"), block_bytes):
        shared = spark.sparkContext.broadcast(vocabulary)
        rows = cut_lineage(bags(docs, shared))
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = document_frequencies(rows, len(vocabulary.values))
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L").alias("m")
        rows = rows.filter(F.octet_length("bag") > 0).select("doc_id", F.xxhash64("bag").alias("hash"), m, "bag")
        classes = rows.groupBy("hash", "m", "bag").agg(F.coalesce(F.min("doc_id"), F.lit(int(LAST))).alias("leader"))
        ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), "leader")
        top = best_classes(classes, shared, weight, len(ids), k).withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k)
        top = cut_lineage(top.drop("place"))
        shared.destroy()
        # At most k classes an item are expanded; their keys are a few bytes each.
        wanted = F.broadcast(top.select("hash", "m").distinct())
        by_id = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
        members = (
            rows.join(wanted, ["hash", "m"], "left_semi")
            .withColumn("place", F.row_number().over(by_id))
            .filter(F.col("place") <= k)
            .withColumn("leader", F.coalesce(F.min("doc_id").over(Window.partitionBy("hash", "m", "bag")), F.lit(int(LAST))))
        )
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        block = (
            members.select("hash", "m", "leader", "doc_id")
            .join(top, ["hash", "m", "leader"])
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        found = block if found is None else found.unionByName(block)
    return found


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
