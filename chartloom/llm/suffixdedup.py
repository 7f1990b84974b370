"""Repeated substrings by sorting sampled suffixes: bytes covered by a 50-byte string of an earlier document are removed.

As in a difference-cover suffix array, only a sample of suffixes is named first, and the others are placed through
the sampled one that follows them. The sample is chosen by content (in every 50-byte string, the position whose 20-byte gram hashes
lowest), which has the covering property of a difference cover: two equal strings contain sampled positions at the same offset.
Positions modulo three would make every suffix of the corpus take part in several global sorts; here unrepeated text drops
out after one count of the sample.

1. Sample: one row per sampled position with the name of its gram, and the name of the stretch of text that all strings
   placed through it span.
2. Grams seen in one document only cannot repeat; the rest keep their rows. Equal stretches form a class: every document but
   the class's first loses all its strings there.
3. Classes that share a gram: all their strings (sampled suffix with up to 30 bytes before it) are sorted by
   50-byte prefix, adjacent prefixes are compared byte by byte, and a string whose run holds an earlier document is marked. A gram
   with very many classes is not gathered: its strings go through partial aggregates and a join instead.
4. Marked strings become intervals of their documents; overlapping ones merge.

Cases: null text is empty; texts shorter than the length lose nothing. ``doc_id`` is the key: rows repeating one with the
same text give equal rows. Rows with a null ``doc_id`` lose nothing and make no other lose anything. An empty table gives an empty
result. Bytes are those of the UTF-8 form, so a cut may fall inside a character. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import _BYTE, _powers, map_batches, mix, only, pieces, table, utf8
from chartloom.session import Scratch, cut_lineage, tidy_shuffles

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1  # grams in a string
MOST_CLASSES = 5_000  # of a gram that one task sorts
_TASK_STRINGS = 2_000_000


class Sample:
    """Sampled positions of a string column: row, first string, number of strings, names of gram and stretch."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        n = len(data)
        sizes = np.diff(offsets)
        valid = np.zeros(n, bool)  # strings that start here lie inside their text
        for a, b in zip(offsets[:-1][sizes >= LENGTH].tolist(), offsets[1:][sizes >= LENGTH].tolist()):
            valid[a : b - LENGTH + 1] = True
        if not valid.any():
            empty = np.zeros(0, np.int64)
            self.row = self.first = self.count = empty
            self.gram = self.stretch = empty.view(np.uint64)
            return
        up, down = _powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
            h = np.full(n, 2**64 - 1, np.uint64)
            h[: n - GRAM + 1] = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
            # Lowest gram, the leftmost of equals, of every run of SPAN grams, by doubling.
            low, at, width = h, np.arange(n, dtype=np.int32), 1
            while width < SPAN:
                step = min(width, SPAN - width)
                other = low[step:] < low[:-step]
                at = np.where(other, at[step:], at[:-step])
                low = np.minimum(low[:-step], low[step:])
                width += step
            starts = np.flatnonzero(valid)
            anchor = at[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
            where = np.flatnonzero(new)
            begin = starts[where]
            count = np.diff(np.append(where, len(starts)))
            p = anchor[where]
            stop = begin + count - 1 + LENGTH
            self.gram = h[p]
            shape = (p - begin).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)
            self.stretch = mix(mix((sums[stop] - sums[begin]) * down[begin]) + shape, 5)
        self.row = np.searchsorted(offsets, begin, side="right") - 1
        self.first, self.count = begin - offsets[self.row], count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_FIELDS = {"doc_id": "long", "first": "int", "count": "byte", "gram": "long", "stretch": "long"}


def sampled(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, first, count, gram, stretch``, or some of them, of every sampled position."""
    names = columns or tuple(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                s = Sample(piece.column("text"))
                made = {
                    "doc_id": lambda: piece.column("doc_id").take(pa.array(s.row)),  # noqa: B023
                    "first": lambda: pa.array(s.first, pa.int32()),  # noqa: B023
                    "count": lambda: pa.array(s.count, pa.int8()),  # noqa: B023
                    "gram": lambda: _signed(s.gram),  # noqa: B023
                    "stretch": lambda: _signed(s.stretch),  # noqa: B023
                }
                yield pa.RecordBatch.from_arrays([made[name]() for name in names], names=list(names))

    return map_batches(docs, run, ", ".join(f"{name} {_FIELDS[name]}" for name in names))


def _stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of each wanted stretch (``doc_id, first, count, gram, stretch``)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("first", "count", "gram", "stretch")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                data = text.encode()
                rows += [(doc, f["count"], f["gram"], f["stretch"], data[f["first"] : f["first"] + f["count"] - 1 + LENGTH]) for f in found]
            if rows:
                doc, count, gram, stretch, data = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(count, pa.int8()), pa.array(gram, pa.int64()), pa.array(stretch, pa.int64()), pa.array(data, pa.binary())],
                    names=["doc_id", "count", "gram", "stretch", "data"],
                )

    joined = docs.join(lists, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("found").alias("found"))
    return map_batches(joined, run, "doc_id long, count byte, gram long, stretch long, data binary")


def marked(data: list[bytes], count: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each stretch, a bit mask of its strings that also start in a stretch of an earlier document.

    All strings are sorted by prefix (by a hash of it first) and neighbours are compared byte by byte.
    """
    flat = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum([0, *map(len, data)])[:-1]
    owner = np.repeat(np.arange(len(data)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + number
    up, down = _powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_BYTE[flat] * up[: len(flat)], out=sums[1:])
        h = mix((sums[at + LENGTH] - sums[at]) * down[at])
    order = np.argsort(h, kind="stable")
    h, at, owner, number = h[order], at[order], owner[order], number[order]
    strings = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    same = np.zeros(len(h), bool)
    close = np.flatnonzero(h[1:] == h[:-1]) + 1
    for k in range(0, len(close), 100_000):
        c = close[k : k + 100_000]
        same[c] = (strings[at[c]] == strings[at[c - 1]]).all(axis=1)
    if (~same[close]).any():  # two prefixes with one hash: order them by their bytes
        by = sorted(range(len(h)), key=lambda k: strings[at[k]].tobytes())
        at, owner, number = at[by], owner[by], number[by]
        same = np.array([False, *(strings[a].tobytes() == strings[b].tobytes() for a, b in zip(at[1:], at[:-1]))])
    group = np.cumsum(~same) - 1
    least = np.minimum.reduceat(doc[owner], np.flatnonzero(~same))[group]
    hit = least < doc[owner]
    masks = np.zeros(len(data), np.int64)
    np.bitwise_or.at(masks, owner[hit], np.int64(1) << number[hit])
    return masks


def _sorted_strings(classes: DataFrame) -> DataFrame:
    """``gram, stretch, mask`` of the classes of one gram at a time, many grams per task."""
    schema = pa.schema([("gram", pa.int64()), ("stretch", pa.int64()), ("mask", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            gram, stretch, doc, count, data = zip(*rows)
            masks = marked(list(data), np.array(count, np.int64), np.array(doc, np.int64))
            some = np.flatnonzero(masks)
            return pa.RecordBatch.from_arrays([pa.array([gram[k] for k in some], pa.int64()), pa.array([stretch[k] for k in some], pa.int64()), pa.array(masks[some])], schema=schema)

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "stretch", "doc_id", "count", "data"))):
                if held > _TASK_STRINGS // 8 and r[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(r)
                held += r[3]
        if rows:
            yield solve(rows)

    return map_batches(classes.repartition(F.col("gram")).sortWithinPartitions("gram"), run, "gram long, stretch long, mask long")


def _aggregated_strings(classes: DataFrame, tables: Scratch) -> DataFrame:
    """The same for grams with very many classes: strings meet in partial aggregates and joins that can be split."""
    each = F.posexplode(F.sequence(F.lit(1), F.col("count").cast("int")))
    strings = tables.keep(classes.select("gram", "stretch", "doc_id", "data", each.alias("number", "start")).select(
        "gram", "stretch", "doc_id", "number", F.expr(f"substring(data, start, {LENGTH})").alias("string")
    ))
    least = tables.keep(strings.groupBy("string").agg(F.min("doc_id").alias("least")))
    hit = strings.join(least, "string").filter("least < doc_id")
    return hit.groupBy("gram", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, number)")).alias("mask"))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """``doc_id, start, stop``: bytes of each document that lie in strings which also start in an earlier one; may overlap.

    Every step is stored for the next ones, and deleted with its exchanges as soon as they are done.
    """
    docs = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    with tidy_shuffles(docs.sparkSession), Scratch(docs.sparkSession) as tables:
        shared = tables.keep(sampled(docs, "doc_id", "gram").groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("gram"))
        # Shared grams are distinct, so hashing spreads them evenly: a partition's part of them is small, and the sample need not be sorted.
        rows = tables.keep(sampled(docs).join(shared.hint("shuffle_hash"), "gram"))
        tables.drop(shared)
        classes = tables.keep(rows.groupBy("gram", "stretch").agg(F.min("doc_id").alias("owner"), F.min_by("first", "doc_id").alias("sample_first"), F.min("count").alias("n")))
        # Several classes at a gram: their strings may agree in part.
        sizes = classes.groupBy("gram").agg(F.count("*").alias("classes"), F.min("owner").alias("a"), F.max("owner").alias("b")).filter("classes > 1 AND a < b")
        several = tables.keep(classes.join(tables.keep(sizes.select("gram", "classes")), "gram"))
        wanted = several.select(F.col("owner").alias("doc_id"), F.col("sample_first").alias("first"), F.col("n").alias("count"), "gram", "stretch")
        texts = tables.keep(_stretches(docs, wanted))
        few = texts.join(several.filter(F.col("classes") <= MOST_CLASSES).select("gram", "stretch"), ["gram", "stretch"])
        found = tables.keep(_sorted_strings(few))
        many = several.filter(F.col("classes") > MOST_CLASSES).select("gram", "stretch")
        if not many.isEmpty():
            found = found.unionByName(_aggregated_strings(texts.join(many, ["gram", "stretch"]), tables))
        masks = tables.keep(classes.select("gram", "stretch", "owner").join(found, ["gram", "stretch"], "left"))
        tables.drop(classes, several, texts)
        placed = rows.join(masks, ["gram", "stretch"])
        # Strings marked in this row: all of them where the class has an earlier owner.
        every = F.expr("shiftleft(1L, cast(count AS int)) - 1")
        bits = F.when(F.col("doc_id") > F.col("owner"), every).otherwise(F.coalesce("mask", F.lit(0).cast("long")))
        placed = placed.withColumn("bits", bits).filter("bits <> 0")
        # Marked strings start less than 50 bytes apart, so those from the first to the last marked cover everything between.
        low = F.floor(F.log2(F.col("bits").bitwiseAND(-F.col("bits")).cast("double"))).cast("int")
        high = F.floor(F.log2(F.col("bits").cast("double"))).cast("int")
        return cut_lineage(placed.select("doc_id", (F.col("first") + low).alias("start"), (F.col("first") + high + LENGTH).alias("stop")))


def without(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``doc_id, text, found`` without the bytes in their ``found`` intervals, all texts as one array of bytes."""
    data, offsets = utf8(batch.column("text"))
    size, n = np.diff(offsets), batch.num_rows
    found = batch.column("found")
    owner = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(found), 0)))
    items = found.flatten()
    start, stop = (np.asarray(pc.struct_field(items, name), dtype=np.int64) + offsets[owner] for name in ("start", "stop"))
    order = np.argsort(start, kind="stable")
    start, owner, reach = start[order], owner[order], np.maximum.accumulate(stop[order])
    # A run of overlapping or touching intervals begins where nothing before reaches, or with the next text.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    low, owner = start[heads], owner[heads]
    high = reach[np.append(heads[1:], len(start))[: len(heads)] - 1]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[low] += 1
    edge[high] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
    removed = np.bincount(owner, weights=high - low, minlength=n).astype(np.int64)
    spans = np.bincount(owner, minlength=n).astype(np.int64)
    ends = lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array((x - offsets[owner]).astype(np.int32)) for x in (low, high)], names=["start", "stop"])
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends(size - removed)), pa.py_buffer(np.ascontiguousarray(kept))]),
            pa.array(size.astype(np.int64)), pa.array(removed), pa.array(spans),
            pa.ListArray.from_arrays(pa.array(ends(spans)), runs),
        ],
        names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans"],
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``doc_id, kept`` (bytes left), ``n_bytes, n_removed, n_spans`` and ``spans`` (removed runs) of every row."""
    docs = only(docs, "doc_id", "text")
    gone = repeated_intervals(docs).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    joined = docs.join(gone, docs["doc_id"] == gone["_doc"], "left").select("doc_id", "text", "found")
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield without(piece)

    return map_batches(joined, run, schema)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
