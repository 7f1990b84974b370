"""Word-level BPE by speculate and verify.

For each distinct word of a batch, greedy longest match over the vocabulary proposes tokens. A proposal is what
merging gives exactly when each of its tokens, and each pair of neighbours, is stable: merging their own
symbols gives them back. (If merging the word crossed a boundary between two tokens, the first such merge would
also happen in those two alone, as merges go by rank and each side passes through the same states.) Distinct neighbour
pairs are looked up together in a sorted table of known pairs; only unknown pairs are worked out, and only words
with an unstable pair are merged exactly, symbol by symbol.

The normalization, splitting and special tokens are those the vocabulary file states: NFC, white space, lower case by
character, words by pattern, special tokens cut out of the raw text first.

Cases: null or empty text has no ids and decodes to the empty text. Repeated rows give equal rows. Lone surrogates
cannot occur in Spark strings. Whole texts are encoded, whatever their length. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import map_batches, only, pieces, table

WORD_BPE = "word_bpe_49k.json"
MOST_KNOWN = 200_000  # words a worker remembers; beyond that it starts afresh
_PIECE = 1 << 19


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary with its memory of encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], dtype=np.int64)
        self.merge_rank = np.argsort(keys, kind="stable")
        self.merge_keys = keys[self.merge_rank]
        self.merge_id = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)[self.merge_rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        # The same pattern for lowered Latin-1 text: classes written out, for the faster engine.
        classes = {r"\p{L}": "a-zªµºß-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}
        self.latin_word = re.compile(reduce(lambda t, c: t.replace(*c), classes.items(), split))
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
        self.letters = _byte_letters()
        self.spelling = {b: c for b, c in enumerate(self.letters) if b != 10}
        self.inner_symbol = np.array([self.vocab[c] for c in self.letters], dtype=np.int64)
        self.final_symbol = np.array([self.vocab[c + self.end] for c in self.letters], dtype=np.int64)
        self.trie = ahocorasick.Automaton()
        parts = [[] for _ in range(max(self.vocab.values()) + 1)]  # the symbols of each token
        for token, number in self.vocab.items():
            final = self.end and token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if final else token
            self.trie.add_word(body + "\n" if final else body, number)
            parts[number] = [self.vocab[c] for c in body]
            if final:
                parts[number][-1] = self.vocab[body[-1] + self.end]
        self.trie.make_automaton()
        self.part_start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.parts = np.array([i for p in parts for i in p], dtype=np.int64)
        self.pairs, self.stable = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fallbacks = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- splitting

    def words(self, text: str) -> list[str]:
        """Words in order; a special token is marked by a leading blank, which no word holds."""
        if not self.special or not any(s in text for s in self.special):
            return self._words(text)
        out = []
        for part in self.cut.split(text):
            out += [" " + part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin_word.findall(text.lower())
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text)
            # Lower case goes by character: a capital sigma has one form only.
            text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.word.findall(text)

    # -- exact merging

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the table of merges, -1 if it never merges."""
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[place] == keys, place, -1)

    def merge(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many symbol sequences at once, lying in a row with these sizes; gives ids and sizes alike.

        Each round makes in every sequence the merge of lowest rank, the leftmost of equals.
        """
        never = np.int64(len(self.merge_keys))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids = ids.astype(np.int64)
        row = np.full(len(ids), -1)  # of the pair that starts here
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        row[inner] = self._lookup(ids[inner], ids[inner + 1])
        done_ids, done_owner = [], []
        while len(ids):
            n = len(ids)
            rank = np.where(row >= 0, self.merge_rank[row], never)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank * n + np.arange(n), first)
            over = best >= never * n
            if over.any():
                stay = np.repeat(~over, np.diff(np.append(first, n)))
                done_ids.append(ids[~stay])
                done_owner.append(owner[~stay])
                shift = np.cumsum(~stay)
                at = best[~over] % n
                at = at - shift[at]
                ids, owner, row = ids[stay], owner[stay], row[stay]
            else:
                at = best % n
            if not len(ids):
                break
            ids[at] = self.merge_id[row[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, row = ids[keep], owner[keep], row[keep]
            at = at - np.arange(len(at))  # one symbol fell out of every earlier sequence
            changed = np.concatenate([at, at[at > 0] - 1])
            last = len(ids) - 1
            joined = (changed < last) & (owner[changed] == owner[np.minimum(changed + 1, last)])
            row[changed] = -1
            changed = changed[joined]
            row[changed] = self._lookup(ids[changed], ids[changed + 1])
        ids, owner = np.concatenate([np.zeros(0, np.int64), *done_ids]), np.concatenate([np.zeros(0, np.int64), *done_owner])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    def _spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words, in a row, and their sizes."""
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data])
        ids = self.inner_symbol[np.frombuffer(b"".join(data), np.uint8)]
        last = np.cumsum(sizes) - 1
        ids[last] = self.final_symbol[[d[-1] for d in data]]
        return ids, sizes

    # -- speculation

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in each word: ids in a row and sizes; size 0 if no token is left for the word's end."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "\n".join([*words, ""]).encode().decode("latin-1").translate(self.spelling)  # no word holds a line break
        found = np.array(list(self.trie.iter_long(text)), dtype=np.int64).reshape(-1, 2)
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
        owner = np.searchsorted(ends, found[:, 0])
        ended = np.zeros(len(words), bool)
        ended[owner[found[:, 0] == ends[owner]]] = True
        keep = ended[owner]
        return found[keep, 1], np.bincount(owner[keep], minlength=len(words))

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays apart; ``left`` -1: whether ``right`` alone is reached."""
        keys = (left + 1) << 32 | right
        wanted = np.unique(keys)
        new = wanted[~np.isin(wanted, self.pairs, assume_unique=True)]
        if len(new):
            sides = np.stack([(new >> 32) - 1, new & 0xFFFFFFFF], axis=1).reshape(-1)
            tokens = sides[sides >= 0]
            sizes = self.part_start[tokens + 1] - self.part_start[tokens]
            ends = np.cumsum(sizes)
            ids = self.parts[np.repeat(self.part_start[tokens] - ends + sizes, sizes) + np.arange(ends[-1])]
            both = sides.reshape(-1, 2)[:, 0] >= 0
            count = 1 + both
            stop = np.cumsum(count)
            total = np.concatenate([[0], ends])
            merged, n = self.merge(ids, total[stop] - total[stop - count])
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            same = n == count
            same[same] = merged[first[same]] == tokens[(stop - count)[same]]
            two = same & both
            same[two] = merged[first[two] + 1] == tokens[(stop - 1)[two]]
            pairs = np.concatenate([self.pairs, new])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.stable = pairs[order], np.concatenate([self.stable, same])[order]
        return self.stable[np.searchsorted(self.pairs, keys)]

    def learn(self, words: set[str]) -> None:
        """Encode words not known yet."""
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > MOST_KNOWN:
            self._forget()
            fresh = list(words)
        special = [w for w in fresh if w[0] == " "]
        fresh = [w for w in fresh if w[0] != " "]
        ids, sizes = self.propose(fresh)
        owner = np.repeat(np.arange(len(fresh)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        bad = ~self._stable(np.full(len(ids), -1), ids)
        bad[inner] |= ~self._stable(ids[inner - 1], ids[inner])
        wrong = sizes == 0
        wrong[owner[bad]] = True
        again = np.flatnonzero(wrong)
        self.fallbacks += len(again)
        if len(again):
            exact, n = self.merge(*self._spelled([fresh[k] for k in again]))
            keep = ~wrong[owner]
            owner = np.concatenate([owner[keep], np.repeat(again, n)])
            ids = np.concatenate([ids[keep], exact])
            order = np.argsort(owner, kind="stable")
            ids, sizes = ids[order], np.bincount(owner, minlength=len(fresh))
        first = len(self.known)
        self.known.update(zip([*fresh, *special], range(first, first + len(fresh) + len(special))))
        ids = np.concatenate([ids, np.array([self.special[w[1:]] for w in special], dtype=np.int64)])
        sizes = np.concatenate([sizes, np.ones(len(special), np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    # -- whole texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        lists = [self.words(t) for t in texts]
        self.learn(set().union(*lists))
        look = self.known.__getitem__
        counts = np.array([len(w) for w in lists], dtype=np.int64)
        at = np.fromiter(map(look, chain.from_iterable(lists)), np.int64, counts.sum())
        sizes = self.starts[at + 1] - self.starts[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        return ids, before[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each list's tokens joined by blanks, special ones included."""
        tokens = self.tokens.take(ids.flatten())
        offsets = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens)
        joined = pc.binary_join(lists, " ")
        return joined if not ids.null_count else pc.if_else(ids.is_valid(), joined, None)


@lru_cache
def tokenizer(path: str) -> WordBpe:
    """One per worker and file."""
    return WordBpe(path)


def _encoded(path: str, piece: pa.RecordBatch) -> pa.ListArray:
    texts = pc.fill_null(piece.column("text"), "").to_pylist()
    ids, offsets = tokenizer(path).encode(texts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row; one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", _PIECE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _encoded(path, piece)], names=["doc_id", "ids"])

    return map_batches(only(docs, "doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of rows of ``encode``; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = tokenizer(path).decode(batch.column("ids").combine_chunks() if isinstance(batch.column("ids"), pa.ChunkedArray) else batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), text], names=["doc_id", "ids", "decoded"])

    return map_batches(only(encoded, "doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string")


def with_ids_digest(df: DataFrame) -> DataFrame:
    """Adds ``n_tokens`` and ``ids_sha256``, the digest of the decimal ids joined by a blank."""
    return df.withColumn("n_tokens", F.size("ids").cast("long")).withColumn(
        "ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    )


def op9_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return with_ids_digest(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
