"""Helpers the operators share: table access, pieces of Arrow batches, spans of words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

PIECE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Exactly these columns, by exact name first, so that extra ones do no harm, also where names differ in case only."""
    names = df.columns
    places = [names.index(c) if c in names else [n.lower() for n in names].index(c.lower()) for c in columns]
    df = df.toDF(*(f"_{k}" for k in range(len(names))))
    return df.select(*(F.col(f"_{k}").alias(c) for k, c in zip(places, columns)))


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: 10,000 long texts at once would not fit a worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text each, one row at least: bounds what a task holds at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start = 0
    ends = np.cumsum(sizes)
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``n + 1`` offsets into them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(((seed + 1) * int(_PRIME)) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_power.get("up", ())) < n:
        n = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
        inverse = np.uint64(pow(int(_PRIME), -1, 2**64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _PRIME), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _power[name] = np.cumprod(steps)
    return _power["up"], _power["down"]


def word_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to words."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a string column: ``start`` and ``end`` in its bytes, ``doc`` (row), ``hash``, ``first`` (offsets by row).

    Only A-Z are lowered. Words never reach over a row. Equal words have equal hashes; different
    ones differ but for about one pair in 2**64.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray):
        data, offsets = utf8(column)
        self.data, self.offsets, n = _LOWER[data], offsets, len(data)
        word = inside[self.data]
        begins, ends = word.copy(), np.zeros(n + 1, bool)
        cuts = offsets[1:-1]
        cuts = cuts[cuts < n]
        begins[1:] &= ~word[:-1]
        begins[cuts] = word[cuts]
        ends[1:] = word
        ends[1:n] &= ~word[1:]
        inner = cuts[cuts > 0]
        ends[inner] = word[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        up, down = _powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:n], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def shingles(self, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and first word of every run of ``size`` words; ``short``: rows with fewer words give all of them as one."""
        count = np.diff(self.first)
        n = len(self.start)
        at = np.arange(n)
        whole = at + size <= self.first[1:][self.doc] if n else np.zeros(0, bool)
        at = at[whole]
        with np.errstate(over="ignore"):
            h = np.full(len(at), size, np.uint64)
            for k in range(size):
                h = mix(h * _PRIME + self.hash[at + k])
            row = self.doc[at]
            if short:
                few = np.flatnonzero((count > 0) & (count < size))
                extra = np.zeros(len(few), np.uint64)
                for j, d in enumerate(few):
                    x = np.full(1, count[d], np.uint64)
                    for w in self.hash[self.first[d] : self.first[d + 1]]:
                        x = mix(x * _PRIME + w)
                    extra[j] = x[0]
                h, row, at = np.concatenate([h, extra]), np.concatenate([row, few]), np.concatenate([at, self.first[few]])
        return h, row, at

    def text(self, word: int) -> bytes:
        return self.data[self.start[word] : self.end[word]].tobytes()


def distinct_by_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted by row, then hash."""
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    else:
        h = h.copy()
    cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(h)]):
        h[start:stop].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def frame(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of these columns, cast to the schema's types."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
