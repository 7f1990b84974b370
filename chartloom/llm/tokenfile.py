"""Token-ID files: texts to ids with the tokenizers library, coded by the context-mixing coder, and back.

Documents are range-partitioned and sorted by ``doc_id``; each task writes one file, whose rows in the written
table of files (path, first id, counts) say which attempts count: files of failed attempts are never read.

A file is ``TOKMIX3\\n``, then blocks, then the document index, then its place. A block: id count, byte count and crc32 of the
coded bytes (unsigned 32-bit little-endian), coded bytes. Blocks hold 4,096 ids, are reset and checked on their own, and run across
documents. The index: compressed ``doc_id``, null mark and id count of each document, with a crc32.

Encoding asks the library once for each distinct run of pieces that its own splitting pattern makes from blank to blank; pieces do not influence each other.

Cases: null or empty text gives the end id only. Null ``doc_id`` sorts first. Equal ``doc_id``s stand next to each other in any order. An
empty table writes no file. A damaged block raises ValueError. Whole texts are encoded. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from chartloom.llm.common import map_batches, only, pieces, table
from chartloom.llm.mixcoder import BLOCK_IDS, decode_blocks, encode_blocks
from chartloom.llm.wordbpe import _byte_letters
from chartloom.session import cut_lineage, shared_dir

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
LANES = 2048  # blocks coded together
MOST_KNOWN = 300_000
MOST_WORD = 64  # bytes of a word that is remembered whole
TEXT_BYTES = 2 << 20  # encoded together
MAGIC = b"TOKMIX3\n"


class PieceTokenizer:
    """The library's tokenizer with a memory of distinct pieces and of words of several pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.split = regex.compile(public_tokenizers.PATTERN)
        # The same pattern with the classes of Latin-1 written out, for the faster engine.
        letters, digits, blanks = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
        latin = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]")
        latin = latin.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"(?!\S)", f"(?![^{blanks}])").replace(r"\s", f"[{blanks}]")
        import re

        self.latin = re.compile(latin)
        self.blank = regex.compile(r"\s")
        # The model spells every byte as a letter.
        self.model, self.letters = self.library.model, dict(enumerate(_byte_letters()))
        self.known: dict[str, int] = {}  # entries by key, in order
        self.flat, self.starts, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self, keep: np.ndarray) -> None:
        """Remember only these entries, by place."""
        self.known = {k: place for place, k in enumerate(compress(self.known, keep.tolist()))}
        sizes = np.diff(self.starts)
        self.flat, self.starts = self.flat[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])
        self.uses = self.uses[keep] >> 1

    def _remember(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.flat, self.uses = np.concatenate([self.flat, ids]), np.concatenate([self.uses, np.zeros(len(keys), np.int64)])

    def _pieces(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return [text] if text.lstrip(" ").isalpha() and text[1:2] != " " else self.latin.findall(text)
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return self.split.findall(text)

    def _library(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        plain = piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())
        spelled = piece.replace(" ", self.letters[32]) if plain else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(spelled)]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries in a row, and the offsets of each entry."""
        sizes = self.starts[at + 1] - self.starts[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])], before

    def _learn(self, keys: list[str]) -> np.ndarray:
        """The entry of each key, a piece or a word without special tokens; the library encodes the pieces not known yet."""
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        if not (at < 0).any():
            return at
        if len(self.known) + (at < 0).sum() > MOST_KNOWN:
            least = 2  # rare ones go, until half the room is free
            while (keep := self.uses >= least).sum() > MOST_KNOWN // 2:
                least *= 2
            keep[at[at >= 0]] = True
            self._forget(keep)
            at[at >= 0] = (np.cumsum(keep) - 1)[at[at >= 0]]
        missing = np.flatnonzero(at < 0)
        fresh = list(dict.fromkeys([keys[k] for k in missing.tolist()]))
        lists = [[k] if k in self.special else self._plain(k) for k in fresh]
        new = [p for p in dict.fromkeys(chain.from_iterable(lists)) if p not in self.known]
        got = [self._library(p) for p in new]
        self._remember(new, np.array([*chain.from_iterable(got)], np.uint32), np.array([*map(len, got)], dtype=np.int64))
        find = self.known.__getitem__
        joined = [(k, x) for k, x in zip(fresh, lists) if len(x) != 1]
        ids, before = self._gather(np.array([find(p) for _, x in joined for p in x], dtype=np.int64))
        ends = before[np.cumsum([0, *(len(x) for _, x in joined)])]
        self._remember([k for k, _ in joined], ids, np.diff(ends))
        at[missing] = [find(keys[k]) for k in missing.tolist()]
        return at

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text.

        A blank before anything but white space begins a piece, so texts are cut there and each distinct cut is encoded once. Texts where a blank
        precedes white space, with special tokens or very long words are cut into the pattern's own pieces.
        """
        column = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        lists = pc.split_pattern(column, " ")
        counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        word, words = np.asarray(coded.indices), coded.dictionary
        ends = np.cumsum(counts)
        firsts = ends - counts
        unfit = np.asarray(pc.greater(pc.binary_length(words), MOST_WORD))
        special = np.zeros(len(column), bool)
        for token in self.special:
            if " " in token:
                special |= np.asarray(pc.match_substring(column, token))
            else:
                unfit = unfit | np.asarray(pc.match_substring(words, token))
        begins = pc.dictionary_encode(pc.utf8_slice_codeunits(words, 0, 1))
        blank = np.array([not c or c.isspace() or self.blank.match(c) is not None for c in begins.dictionary.to_pylist()], bool)
        # A text's first word has no blank before it.
        inner = blank[np.asarray(begins.indices)][word]
        inner[firsts] = False
        slow = special | np.logical_or.reduceat(inner | unfit[word], firsts) if len(word) else special
        heads = words.take(pa.array(word[firsts])).to_pylist()
        lists = [self._pieces(column[k].as_py()) for k in np.flatnonzero(slow).tolist()]
        keys = pc.binary_join_element_wise("", words, " ").to_numpy(zero_copy_only=False).tolist()
        for k in np.flatnonzero(unfit).tolist():
            keys[k] = ""
        at = self._learn([*keys, *("" if s else h for h, s in zip(heads, slow.tolist())), *chain.from_iterable(lists)])
        pieces_at = at[len(keys) + len(heads) :]
        head = at[len(keys) : len(keys) + len(heads)]
        at = at[word]
        at[firsts] = head
        if len(lists):
            mine = np.array([len(x) for x in lists], dtype=np.int64)
            places = np.split(pieces_at, np.cumsum(mine)[:-1])
            rows = iter(places)
            at = np.concatenate([next(rows) if s else at[a:b] for s, a, b in zip(slow.tolist(), firsts.tolist(), ends.tolist())])
            counts[slow] = mine
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, before = self._gather(at)
        return ids, before[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


class TokenFileWriter:
    """Writes one file; blocks are coded ``LANES`` at a time."""

    def __init__(self, out):
        self.out, self.parts, self.held = out, [], 0
        self.docs, self.sizes = [], []
        out.write(MAGIC)

    def add(self, docs: list[int | None], ids: np.ndarray, offsets: np.ndarray) -> None:
        self.docs += docs
        self.sizes += np.diff(offsets).tolist()
        self.parts.append(ids.astype(np.uint32))
        self.held += len(ids)
        if self.held >= LANES * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.parts])
        stop = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        self.parts = []
        for low in range(0, stop, LANES * BLOCK_IDS):
            blocks = [ids[k : min(k + BLOCK_IDS, stop)] for k in range(low, min(low + LANES * BLOCK_IDS, stop), BLOCK_IDS)]
            for block, coded in zip(blocks, encode_blocks(blocks)):
                self.out.write(struct.pack("<III", len(block), len(coded), zlib.crc32(coded)) + coded)
        self.parts, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        numbers = np.array([d or 0 for d in self.docs], "<i8")
        index = zlib.compress(null.tobytes() + numbers.tobytes() + np.array(self.sizes, "<i8").tobytes())
        self.out.write(struct.pack("<III", 0, len(index), zlib.crc32(index)) + index + struct.pack("<IQ", len(self.docs), len(index)))


def read_token_file(file: pa.NativeFile) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Documents and their ids, in order, some at a time."""
    size = file.size()
    if file.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a token file")
    n, length = struct.unpack("<IQ", file.read_at(12, size - 12))
    end = size - 12 - length - 12
    index = file.read_at(length, end + 12)
    if zlib.crc32(index) != struct.unpack("<III", file.read_at(12, end))[2]:
        raise ValueError("damaged index")
    plain = zlib.decompress(index)
    null, numbers, sizes = np.frombuffer(plain, np.uint8, n), np.frombuffer(plain, "<i8", n, n), np.frombuffer(plain, "<i8", n, 9 * n)
    ends = np.cumsum(sizes)
    at, doc, done, rest = len(MAGIC), 0, 0, np.zeros(0, np.uint32)
    while at < end:
        coded, counts = [], []
        while at < end and len(coded) < LANES:
            count, length, check = struct.unpack("<III", file.read_at(12, at))
            data = file.read_at(length, at + 12)
            if zlib.crc32(data) != check:
                raise ValueError("damaged block")
            coded.append(data)
            counts.append(count)
            at += 12 + length
        ids = np.concatenate([rest, *decode_blocks(coded, counts)])
        stop = int(np.searchsorted(ends, done + len(ids), side="right"))
        cuts = ends[doc:stop] - done
        if stop > doc:
            yield [None if null[k] else int(numbers[k]) for k in range(doc, stop)], np.split(ids[: cuts[-1]], cuts[:-1])
            rest, done, doc = ids[cuts[-1] :], int(ends[stop - 1]), stop
        else:
            rest = ids


_FILES = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents in ascending ``doc_id`` order; returns the table of files ``path, first_doc, n_docs, n_tokens``."""
    ordered = only(docs, "doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, total = None, f"{folder}/{uuid4().hex}.tokens", 0
        for batch in batches:
            for piece in pieces(batch, "text", TEXT_BYTES):
                if writer is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    writer = TokenFileWriter(store.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None))
                ids, offsets = tokenizer(tokenizer_path).encode(piece.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                writer.add(piece.column("doc_id").to_pylist(), ids, offsets)
                total += len(ids)
        if writer is not None:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([writer.docs[0]], pa.int64()), pa.array([len(writer.docs)]), pa.array([total])], schema=_FILES
            )

    return cut_lineage(map_batches(ordered, run, "path string, first_doc long, n_docs long, n_tokens long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, ``start`` counting the ids of all documents before it."""
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    # One small row per file; the files themselves are read by as many tasks.
    placed = cut_lineage(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for docs, lists in read_token_file(file):
                        for low in range(0, len(docs), 1000):
                            some = lists[low : low + 1000]
                            offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])])
                            flat = pa.array(np.concatenate(some).astype(np.int32))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(docs[low : low + 1000], pa.int64()), pa.array(start + offsets[:-1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                                schema=schema,
                            )
                            start += int(offsets[-1])

    spread = placed.select("path", "start").repartition(max(1, placed.count()), F.xxhash64("path"))
    return map_batches(spread, run, "doc_id long, start long, ids array<int>")


def with_ids_crc32(df: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the crc32 of the ids as unsigned 32-bit little-endian numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.asarray(ids.offsets)
            flat = np.asarray(ids.flatten()).astype("<u4")
            cuts = (offsets - offsets[0]).tolist()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], schema=schema)

    return map_batches(df, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_BPE))
    return with_ids_crc32(read_token_files(files))
