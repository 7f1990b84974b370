"""CSV with line breaks inside quotes, read by many tasks.

Whether a line break ends a record depends on all quotes before it in the file, so a plain reader gives a whole file to one task. Here a
first pass counts the quotes of every split of a file. Running sums of the counts tell which splits start inside quotes,
and a second pass starts each split at its first true record end. What a split holds of records that begin or end in others is put
together by record afterwards: at most two pieces a split.

The files are quoted as most writers do: fields with quotes, line breaks or separators stand in quotes, and a quote inside is doubled. Bare
quotes inside unquoted fields are not allowed. The first record of a file is its header. Empty lines are skipped. Compressed files
have one split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUOTE = '"'
OPTIONS = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
RECORD, HEAD, MIDDLE, TAIL = range(4)
_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int8()), ("header", pa.bool_()), ("record", pa.string())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: physical lines in order, with the file and the offset of their split; carriage returns stay in the value."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def split_states(lines: DataFrame) -> DataFrame:
    """``file, start, inside``: whether each split starts inside quotes."""
    counts = lines.groupBy("file", "start").agg(F.sum(F.regexp_count("value", F.lit(QUOTE))).alias("quotes"))
    order = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("file", "start", (before % 2 == 1).alias("inside"))


class _Split:
    """Turns the lines of one split, batch by batch, into records and pieces of records."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.odd, self.open, self.first = inside, inside, start == 0
        self.pending: list[pa.Array] = []

    def _row(self, kind: int, lines: list[pa.Array]) -> list[pa.RecordBatch]:
        whole = pa.concat_arrays(lines)
        return self._batch(kind, pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), "\n"))

    def _batch(self, kind: int, records: pa.Array) -> list[pa.RecordBatch]:
        n = len(records)
        header = np.zeros(n, bool)
        if n and self.first:
            header[0], self.first = True, False
        columns = [pa.array([self.file] * n), pa.array([self.start] * n, pa.int64()), pa.array([kind] * n, pa.int8()), pa.array(header), records]
        return [pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)] if n else []

    def feed(self, lines: pa.Array) -> list[pa.RecordBatch]:
        quotes = pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False)
        after = (int(self.odd) + np.cumsum(quotes)) % 2
        self.odd = bool(after[-1])
        ends = np.flatnonzero(after == 0)
        if not len(ends):
            self.pending.append(lines)
            return []
        out = self._row(HEAD if self.open else RECORD, [*self.pending, lines.slice(0, ends[0] + 1)])
        self.open = False
        offsets = pa.array(np.concatenate([[0], ends[1:] - ends[0]]).astype(np.int32))
        records = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.slice(ends[0] + 1, ends[-1] - ends[0])), "\n")
        out += self._batch(RECORD, records)
        rest = lines.slice(ends[-1] + 1)
        self.pending = [rest] if len(rest) else []
        return out

    def end(self) -> list[pa.RecordBatch]:
        return self._row(MIDDLE if self.open else TAIL, self.pending) if self.pending else []


def _records(inside: dict[tuple[str, int], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
            codes = files.indices.to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                file, start = files.dictionary[int(codes[a])].as_py(), int(starts[a])
                if split is None or (split.file, split.start) != (file, start):
                    if split is not None:
                        yield from split.end()
                    if (file, start) not in inside:
                        raise ValueError(f"the splits of {file} changed while it was read")
                    split = _Split(file, start, inside[file, start])
                yield from split.feed(batch.column("value").slice(a, b - a))
        if split is not None:
            yield from split.end()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: every record of the files but their headers, as text with its line breaks.

    The driver holds one flag per split, as it holds one task for each.
    """
    lines = _lines(spark, path)
    inside = {(r["file"], r["start"]): r["inside"] for r in split_states(lines).toLocalIterator()}
    found = lines.mapInArrow(_records(inside), "file string, start long, kind byte, header boolean, record string")
    pieces = found.filter(F.col("kind") != RECORD)
    # A record in pieces begins with a tail; the pieces up to the next tail of the file are its rest.
    order = Window.partitionBy("file").orderBy("start", "kind")
    chain = F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (
        pieces.withColumn("chain", chain)
        .groupBy("file", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "header", "record"))).alias("of"))
        .select(F.array_join("of.record", "\n").alias("record"), F.get("of.header", F.lit(0)).alias("header"))
    )
    whole = found.filter(F.col("kind") == RECORD).select("record", "header").unionByName(joined)
    # the line break that ends a record may have two characters
    record = F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    return whole.filter(~F.col("header")).select(record.alias("record")).filter(F.col("record") != "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files, as strings under the names of the header."""
    names = spark.read.csv(path, header=True, quote=QUOTE, escape=QUOTE, multiLine=True, enforceSchema=True).columns
    schema = ", ".join(f"_{k} string" for k in range(len(names)))
    row = F.from_csv("record", F.lit(schema), OPTIONS).alias("row")
    return records(spark, path).select(row).select(*(F.col("row")[f"_{k}"].alias(name) for k, name in enumerate(names)))
