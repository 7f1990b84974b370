"""Vectorized pre-selection of word spans, run per Arrow batch inside Spark tasks.

Only a filter: it keeps every span that can still reach the threshold. Similar terms are
found afterwards by a Spark join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chartloom.functions.similarity import least_shared

CHARS_AT_ONCE = 24_000  # keeps the working arrays inside the processor caches
MOST_GRAMS = 96  # larger spans get a coarser test
_BREAK = 28
# places lie between -32,768 and 32,767
_PLACE_BITS = 16
_SHIFT = 1 << 15
_NEVER = np.iinfo(np.int16).max


@dataclass
class KeyBounds:
    """What the terms of a dictionary allow at each place of the global order that their prefixes use.

    ``row`` gives each place (shifted to 0..65,535) its row, -1 for places that no prefix uses. ``need[row, n]`` is how many
    trigrams a span of ``n`` must have from that place on to reach some term. ``low``, ``high`` and ``rest`` are the smallest and
    largest term of a row and the most trigrams any of its terms has from there on.
    """

    row: np.ndarray
    need: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rest: np.ndarray


def key_bounds(kind: str, threshold: float, key: Sequence[int], size: Sequence[int], rest: Sequence[int]) -> KeyBounds:
    """Bounds from ``(place, size of terms, longest rest among them)``."""
    key, size, rest = (np.asarray(c, dtype=np.int64) for c in (key, size, rest))
    places, own = np.unique(key, return_inverse=True)
    row = np.full(2 * _SHIFT, -1, dtype=np.int32)
    row[places + _SHIFT] = np.arange(len(places))
    need = np.full((len(places), MOST_GRAMS + 1), _NEVER, dtype=np.int16)
    for n in range(1, MOST_GRAMS + 1):
        shared = least_shared(kind, threshold, n, size)
        fits = (shared <= rest) & (shared <= n)
        np.minimum.at(need[:, n], own[fits], shared[fits].astype(np.int16))
    low, high, longest = (np.zeros(len(places), dtype=np.int64) for _ in range(3))
    low[:] = np.iinfo(np.int64).max
    np.minimum.at(low, own, size)
    np.maximum.at(high, own, size)
    np.maximum.at(longest, own, rest)
    return KeyBounds(row, need, low, high, longest)


def _symbols() -> np.ndarray:
    table = np.full(256, _BREAK, dtype=np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord(".")] = 27
    table[ord(" ")] = 0
    return table


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """``data[start:end]`` of every pair as a string column."""
    size = end - start
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1], dtype=np.int32) + np.repeat((start - offsets[:-1]).astype(np.int32), size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def _joined(blocks: pa.Array) -> np.ndarray:
    """The bytes of all blocks, a line break after each and two more at the end."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(blocks)], pa.int32()), blocks)
    text = pc.binary_join(whole, "\n")[0].as_buffer()
    return np.concatenate([np.frombuffer(text, dtype=np.uint8), np.full(3, 10, dtype=np.uint8)])


def span_filter(
    places: Sequence[int],
    bounds: KeyBounds,
    share: float,
    min_grams: int,
    max_words: int,
    first_words: int,
    key_columns: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``(*key_columns, first, block)`` to
    ``(*key_columns, word_pos, n_words, span, places, keys)``.

    ``places`` maps trigram codes to the global order; ``bounds`` says what dictionary prefixes allow at each
    place; ``share`` is the part of a set any partner must contain. A span
    stays when its own prefix holds such a place with terms it can reach: these are its
    ``keys``. ``places`` out is the sorted set of the span's trigrams.
    """
    held_of = (np.asarray(places, dtype=np.int32) + _SHIFT).astype(np.uint16)
    is_key = bounds.row >= 0
    table = _symbols()
    need = bounds.need.reshape(-1)
    # the fewest shared trigrams that a span of n trigrams needs (the last place: of any larger one), and one of at least n
    fewest = np.append(bounds.need.min(axis=0, initial=_NEVER).astype(np.int64), max(1, math.ceil((MOST_GRAMS + 1) * share - 1e-9)))
    if fewest[-1] > bounds.high.max(initial=0):
        fewest[-1] = _NEVER
    least = np.minimum.accumulate(fewest[::-1])[::-1]

    def running(flags: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))

    def to_lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32) - _SHIFT))

    def candidates(sym: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans ``(row, word, n_words, start, end)`` with a dictionary key inside and enough trigrams that the dictionary knows.

        A span has at least as many distinct trigrams as positions whose trigram did not occur shortly before.
        """
        n_key, n_known = running(is_key[place]), running(place > _SHIFT)
        inside = (sym != 0) & (sym != _BREAK)
        edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        row = running(sym == _BREAK)[starts]
        word = np.arange(len(starts)) - np.searchsorted(row, row, side="left")
        letter = (sym >= 1) & (sym <= 26)
        longest = int((ends[max_words - 1 :] - starts[: len(starts) - max_words + 1]).max(initial=0)) if len(starts) >= max_words else len(sym)
        by_place = np.argsort(place, kind="stable")
        again = np.zeros(len(place), dtype=bool)
        again[by_place[1:]] = (place[by_place[1:]] == place[by_place[:-1]]) & (by_place[1:] - by_place[:-1] < longest)
        n_again = running(again)
        found = []
        for n in range(1, min(max_words, len(starts)) + 1):
            i = np.arange(len(starts) - n + 1)
            last = i + n - 1
            start, end = starts[i], ends[last]
            ok = (row[i] == row[last]) & (word[i] < first_words) & (end - start - 2 >= min_grams)
            ok &= letter[start] & letter[end - 1]
            stop = np.maximum(end - 2, start)
            ok &= n_key[stop] > n_key[start]
            distinct = stop - start - (n_again[stop] - n_again[start])
            ok &= n_known[stop] - n_known[start] >= least[np.minimum(distinct, MOST_GRAMS + 1)]
            i = i[ok]
            found.append((row[i], word[i], np.full(len(i), n), start[ok], end[ok]))
        return tuple(np.concatenate(part) if found else np.zeros(0, dtype=np.int64) for part in zip(*found)) or (
            np.zeros(0, dtype=np.int64),
        ) * 5

    def reachable(key: np.ndarray, size: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Whether a span of ``size`` trigrams, ``rest`` of them from ``key`` on, can reach a term there."""
        row = bounds.row[key]
        match = rest >= need[row * (MOST_GRAMS + 1) + np.minimum(size, MOST_GRAMS)]
        large = np.flatnonzero(size > MOST_GRAMS)
        if len(large):
            row, size, rest = row[large], size[large], rest[large]
            needed = np.maximum(1.0, size * share - 1e-9)
            coarse = (np.minimum(rest, bounds.rest[row]) >= needed) & (bounds.high[row] >= needed)
            match[large] = coarse & (size >= bounds.low[row] * share - 1e-9)
        return match

    def select(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
        data = _joined(texts)
        sym = table[data]
        place = held_of[(sym[:-2] << 10) | (sym[1:-1] << 5) | sym[2:]]
        row, word, n_words, start, end = candidates(sym, place)

        if not len(start):
            nothing = np.zeros(0, dtype=np.int64)
            return row, word, n_words, _strings(data, start, end), to_lists(nothing, nothing), to_lists(nothing, nothing)

        # all trigrams of all spans, sorted and made distinct within their span
        kind = np.uint32 if len(start) < 1 << _PLACE_BITS else np.uint64
        grams = end - start - 2
        before = np.cumsum(grams) - grams
        item = np.repeat(np.arange(len(start), dtype=kind) << kind(_PLACE_BITS), grams)
        item |= place[np.arange(len(item), dtype=np.int32) + np.repeat((start - before).astype(np.int32), grams)]
        item.sort()
        new = np.ones(len(item), dtype=bool)
        np.not_equal(item[1:], item[:-1], out=new[1:])
        size = np.add.reduceat(new, before, dtype=np.int32)
        item = item[new]

        # a span can only reach terms through the first few of its trigrams
        prefix = np.maximum(size - fewest[np.minimum(size, MOST_GRAMS + 1)] + 1, 0)
        ahead = np.cumsum(size) - size
        inner = np.arange(prefix.sum(), dtype=np.int32) - np.repeat((np.cumsum(prefix) - prefix).astype(np.int32), prefix)
        owner = np.repeat(np.arange(len(start), dtype=np.int32), prefix)
        key = (item[ahead.astype(np.int32)[owner] + inner] & kind(2 * _SHIFT - 1)).astype(np.int32)
        hit = np.flatnonzero(is_key[key])
        owner, key = owner[hit], key[hit]
        match = reachable(key, size[owner], size[owner] - inner[hit])
        owner, key = owner[match], key[match]
        kept = np.zeros(len(start), dtype=bool)
        kept[owner] = True
        sets = to_lists(size[kept], item[np.repeat(kept, size)] & kind(2 * _SHIFT - 1))
        keys = to_lists(np.bincount(owner, minlength=len(start))[kept], key)
        return row[kept], word[kept], n_words[kept], _strings(data, start[kept], end[kept]), sets, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names[:key_columns]
            reached = np.cumsum(pc.binary_length(whole.column("block")).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(reached // CHARS_AT_ONCE)) + 1
            for begin, stop in pairwise([0, *cuts.tolist(), whole.num_rows]):
                batch = whole.slice(begin, stop - begin)
                if not batch.num_rows:
                    continue
                row, word, n_words, text, sets, keys = select(batch.column("block"))
                taken = batch.select([*names, "first"]).take(pa.array(row, type=pa.int64()))
                first = taken.column("first").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(taken.column(c) for c in range(key_columns)),
                        pa.array((first + word).astype(np.int32)),
                        pa.array(n_words.astype(np.int32)),
                        text,
                        sets,
                        keys,
                    ],
                    names=[*names, "word_pos", "n_words", "span", "places", "keys"],
                )

    return run
