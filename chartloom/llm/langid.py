"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended spectrum presence kernel: k(x, y) counts the distinct character n-grams, n = 1..3, that x
and y share, divided by the root of the product of their own counts. Letters are lowered, every run of other characters is one
blank, and n-grams are hashed to 65,536 slots. Landmarks are training texts; the Nyström map
turns kernel values against them into features for ridge regression, one target per language.
Since the kernel is a product of presence vectors, landmarks and weights multiply out to one matrix
of slots by languages, and a batch of whole texts is scored by one product of its presence matrix with it.

The model is fitted on a bounded sample: at most ``max_rows`` labelled rows, shared evenly by the languages, in
hash order of ``doc_id``; ``landmarks`` of them serve as landmarks. Counting languages and scoring cover all rows.

Cases: null text or text without a letter gives ``und`` and score 0. Null ``lang`` is not learned from.
Without any usable labelled row everything is ``und``. Ties between languages go to the smaller name. Repeated rows are scored
alike. An empty table gives an empty result. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.llm.common import frame, map_batches, only, pieces, table

SLOTS = 1 << 16
ORDERS = (1, 2, 3)
MAX_ROWS, LANDMARKS, RIDGE, SHARPNESS = 1536, 192, 0.3, 6.0
FOLDS = 5
_ROWS = 32  # texts scored at a time: a presence matrix of 2 MB


@lru_cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, 0 if it is no letter."""
    codes = np.zeros(sys.maxunicode + 1, np.uint32)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            codes[k] = ord(low) if len(low) == 1 else k
    return codes


def presence(texts: list[str | None]) -> np.ndarray:
    """The 0/1 matrix of texts by n-gram slots; rows of texts without letters are zero."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    flat = out.reshape(-1)
    letters = _letters()
    for row, text in enumerate(texts):
        codes = letters[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not codes.any():
            continue
        gap = np.zeros(1, np.uint32)
        codes = np.concatenate([gap, codes, gap])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        h = np.zeros(len(codes), np.uint32)
        for n in ORDERS:
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            slot = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
            flat[slot.astype(np.int64) + row * SLOTS] = 1
    return out


class LanguageModel:
    """Languages in order of name and the matrix of slots by languages."""

    def __init__(self, languages: list[str], weights: np.ndarray, sharpness: float = SHARPNESS):
        self.languages, self.weights, self.sharpness = languages, weights, sharpness

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (-1: no letter) and its share of the sharpened scores."""
        counts = x.sum(axis=1, dtype=np.int64)
        if not self.languages:
            return np.full(len(x), -1), np.zeros(len(x))
        f = (x.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(counts, 1))[:, None]
        e = np.exp(self.sharpness * (f - f.max(axis=1, keepdims=True)))
        best = f.argmax(axis=1)
        share = e[np.arange(len(x)), best] / e.sum(axis=1)
        return np.where(counts > 0, best, -1), np.where(counts > 0, share, 0.0)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalized presence kernel of two presence matrices, in blocks of rows."""
    norm_x, norm_y = (np.sqrt(np.maximum(m.sum(axis=1, dtype=np.int64), 1)) for m in (x, y))
    right = y.astype(np.float32).T
    blocks = [x[k : k + 64].astype(np.float32) @ right for k in range(0, len(x), 64)]
    return np.concatenate(blocks).astype(np.float64) / norm_x[:, None] / norm_y[None, :]


def fit(x: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Kernel ridge regression on rows in the given order; landmarks are taken from the languages in turn."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    by = {n: [k for k, v in enumerate(langs) if v == n] for n in names}
    turns = [by[n][k] for k in range(max(map(len, by.values()))) for n in names if k < len(by[n])]
    marks = x[turns[:landmarks]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map: kernel values to features
    z = kernel(x, marks) @ root
    target = np.array([[1.0 if v == n else -1.0 for n in names] for v in langs])
    share = np.array([1 / len(by[v]) for v in langs])[:, None] * len(langs) / len(names)  # languages weigh alike
    w = np.linalg.solve(z.T @ (z * share) + ridge * np.eye(z.shape[1]), z.T @ (target * share))
    norm = np.sqrt(np.maximum(marks.sum(axis=1, dtype=np.int64), 1))[:, None]
    alpha = ((root @ w) / norm).astype(np.float32)
    weights = np.zeros((SLOTS, len(names)), np.float32)
    for k in range(0, len(marks), 64):
        weights += marks[k : k + 64].astype(np.float32).T @ alpha[k : k + 64]
    return LanguageModel(names, weights)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == 0


def train(docs: DataFrame, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on the bounded sample of rows that are not held out.

    Presence vectors are computed by the executors; the driver receives at most about ``max_rows`` of them, 8 KB each.
    """
    rows = only(docs, "doc_id", "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, SLOTS), np.uint8), [])
    each = max(1, max_rows // len(counts))
    order = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    # A few more than needed by chance, cut to the exact number below.
    limits = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (each + 4 * each**0.5 + 8) / n) * (1 << 30)))))
    chosen = rows.withColumn("_order", order).filter(F.col("_order") < limits[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                bits = np.packbits(presence(part.column("text").to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_order"), part.column("doc_id"), part.column("lang").cast(pa.string()), pa.array([b.tobytes() for b in bits], pa.binary())],
                    names=["_order", "doc_id", "lang", "bits"],
                )

    sample = chosen.select("_order", F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    sample = map_batches(sample, vectors, "_order long, doc_id string, lang string, bits binary")
    taken: dict[str, int] = {}
    picked = []
    for r in sorted(sample.collect(), key=lambda r: (r[0], r.doc_id)):
        if taken.setdefault(r.lang, 0) < each:
            taken[r.lang] += 1
            picked.append(r)
    if not picked:
        return fit(np.zeros((0, SLOTS), np.uint8), [])
    x = np.unpackbits(np.stack([np.frombuffer(r.bits, np.uint8) for r in picked]), axis=1)
    return fit(x, [r.lang for r in picked], landmarks)


_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for k in range(0, len(texts), _ROWS):
        best, share = model.score(presence(texts[k : k + _ROWS]))
        names += ["und" if b < 0 else model.languages[b] for b in best]
        scores += [min(1.0, max(0.0, float(s))) for s in share]
    return names, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; reads ``text`` only, one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield frame(_ARROW, piece.column("doc_id"), *_predict(shared.value, piece.column("text").to_pylist()))

    return map_batches(only(docs, "doc_id", "text"), predict, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float) -> DataFrame:
    """The documents, all columns as they were, whose language is found with ``min_score`` at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                names, scores = _predict(shared.value, piece.column("text").to_pylist())
                yield piece.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return map_batches(docs, choose, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
