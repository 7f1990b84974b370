"""Quality classifier by co-training two views: text content and page metadata.

Text view: shares of pairs of neighbouring character classes, hashed word shares, repetition. Metadata view: hashed source
and language, length class, which of them are missing. Each view is a logistic regression.
In every round each view labels the unlabelled rows it is most sure of, and hands them to the other view as training rows: of
all free rows it is ``sure`` of, the surest 1 / (rounds left) of each class, so the last round hands over every such row. The views then learn by
Newton steps on gradients and curvature summed over the whole table. In the end each view is calibrated on labelled rows kept
apart, and the two are combined as independent evidence: their log odds add up, less the prior's.

Every unlabelled row takes part, whatever the size of the table. Only the labels are a bounded sample, in hash order of ``doc_id``: about
``max_labelled``; rows with other labels count as unlabelled. Labelled rows whose crc32 is a multiple of ``FOLDS`` are never used for fitting
(held out). Scoring covers all rows.

Cases: null text, source, language or length are values of their own; null labels are unlabelled. Repeated labels of a document: the
lowest counts. With no label, or one class only, every row gets that prior (0.5 without labels). An empty table gives an empty
result. Whole texts are read. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from chartloom.llm.common import Words, frame, map_batches, mix, only, pieces, table, utf8, word_class
from chartloom.session import cut_lineage

MAX_LABELLED, ROUNDS, SURE, STEPS, PARTS = 4000, 5, 0.95, 2, 8
FOLDS, CALIBRATION = 5, 1
WORD_SLOTS, META_SLOTS = 256, 64
THRESHOLD = 0.5

#: Character classes by byte: lower, upper, digit, blank, line end, each common sign, other signs, beyond ASCII.
_SIGNS = b".,!?*%$#&|;:'\"-"
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 0
_CLASS[[9, 32]], _CLASS[[10, 13]] = 3, 4
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
for _k, _c in enumerate(_SIGNS):
    _CLASS[_c] = 6 + _k
N_CLASS = 6 + len(_SIGNS)
TEXT_DIM, META_DIM = N_CLASS**2 + WORD_SLOTS + 3, 2 * META_SLOTS + 40 + 3
_INSIDE = ~word_class((9, 13), (32, 32))


def text_features(texts: pa.Array) -> np.ndarray:
    data, offsets = utf8(texts)
    n = len(texts)
    out = np.zeros((n, TEXT_DIM), np.float32)
    words = Words(texts, _INSIDE)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kind = _CLASS[data]
    if len(data) > 1:
        same = row[1:] == row[:-1]
        pair = (row[1:] * N_CLASS**2 + kind[:-1] * N_CLASS + kind[1:])[same]
        out[:, : N_CLASS**2] = np.sqrt(np.bincount(pair, minlength=n * N_CLASS**2).reshape(n, -1) / np.maximum(sizes - 1, 1)[:, None])
    count = np.diff(words.first)
    slot = (words.hash % np.uint64(WORD_SLOTS)).astype(np.int64)
    found = np.bincount(words.doc * WORD_SLOTS + slot, minlength=n * WORD_SLOTS).reshape(n, -1)
    out[:, N_CLASS**2 : -3] = np.sqrt(found / np.maximum(count, 1)[:, None])
    again = np.zeros(len(words.doc), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    out[:, -3] = np.bincount(words.doc, weights=again, minlength=n) / np.maximum(count, 1)
    out[:, -2] = np.log1p(count) / 10
    out[:, -1] = count == 0
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_DIM), np.float32)

    def slot(value: str) -> int:
        number = np.frombuffer(value.encode().ljust(-(-len(value.encode()) // 8) * 8 or 8, b"\0"), np.uint64)
        return int(mix(np.bitwise_xor.reduce(mix(number, len(value)), keepdims=True))[0] % np.uint64(META_SLOTS))

    known: dict[str, int] = {}
    for k, (s, g, c) in enumerate(zip(source, lang, n_chars)):
        for at, value in ((0, s), (META_SLOTS, g)):
            if value is not None:
                if value not in known:
                    known[value] = slot(value)
                out[k, at + known[value]] = 1
        if c is not None:
            out[k, 2 * META_SLOTS + min(39, int(2 * np.log2(max(c, 0) + 1)))] = 1
        out[k, -3:] = (s is None, g is None, c is None)
    return out


# -- learning


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights, the intercept last, by accelerated gradient steps; the classes weigh alike."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    size = 4 / max(float((share * (x**2).sum(axis=1)).sum()), 1e-9)
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ahead = w.copy()
    for t in range(steps):
        slope = x.T @ (share * (_sigmoid(x @ ahead.astype(np.float32)) - y)).astype(np.float32) + ridge * ahead
        new = ahead - size * slope
        ahead, w = new + t / (t + 3) * (new - w), new
    return w


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt scaling, by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(_logit(pos / len(y)))
    z = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        slope = z.T @ (p - target)
        bend = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class View:
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.margin(x) + self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.odds(x))


@dataclass
class CoTrained:
    text: View | None
    meta: View | None
    prior: float
    handed: int = 0  # pseudo-labels the views gave each other

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        a, b = self.text.probability(text), self.meta.probability(meta)
        return a, b, _sigmoid(_logit(a) + _logit(b) - _logit(self.prior))


RIDGE = 1e-4
#: Log odds from which rows count as sure are told apart in so many steps up to ``_TOP``.
_BINS, _TOP = 2048, 40.0
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # text, meta, label (0, 1, -1), fold
Round = tuple[tuple[View, View], np.ndarray]  # models, and the log odds from which view v handed over class c


def handed_labels(rows: Rows, rounds: list[Round]) -> np.ndarray:
    """What each view was handed by the other in these rounds: 0, 1 or -1, as (view, row)."""
    free = rows[2] < 0
    got = np.full((2, len(free)), -1)
    for models, cuts in rounds:
        for v in (0, 1):
            odds = models[v].odds(rows[v])
            for value, belief in ((1, odds), (0, -odds)):
                got[1 - v][free & (got[1 - v] < 0) & (belief >= cuts[v, value])] = value
    return got


def sure_counts(rows: Rows, rounds: list[Round], models: tuple[View, View], sure: float) -> np.ndarray:
    """Free rows each view is sure of, by view, class and step of log odds."""
    got, low = handed_labels(rows, rounds), float(_logit(sure))
    out = np.zeros((2, 2, _BINS))
    for v in (0, 1):
        odds = models[v].odds(rows[v])
        free = (rows[2] < 0) & (got[1 - v] < 0)
        for value, belief in ((1, odds), (0, -odds)):
            belief = belief[free & (belief >= low)]
            out[v, value] = np.bincount(np.minimum((belief - low) / (_TOP - low) * _BINS, _BINS - 1).astype(int), minlength=_BINS)
    return out.reshape(-1)


def learning_rows(rows: Rows, rounds: list[Round], v: int) -> np.ndarray:
    """The label view ``v`` learns each row by, or -1."""
    return np.where((rows[2] >= 0) & (rows[3] != CALIBRATION), rows[2], handed_labels(rows, rounds)[v])


def class_counts(rows: Rows, rounds: list[Round]) -> np.ndarray:
    return np.array([float((learning_rows(rows, rounds, v) == c).sum()) for v in (0, 1) for c in (0, 1)])


def slopes(rows: Rows, rounds: list[Round], weights: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of both views at ``weights``; the classes weigh alike."""
    out = []
    for v in (0, 1):
        y = learning_rows(rows, rounds, v)
        use = y >= 0
        y = y[use].astype(np.float64)
        x = np.concatenate([rows[v][use], np.ones((len(y), 1), np.float32)], axis=1)
        share = np.where(y > 0, 0.5 / max(count[v, 1], 1), 0.5 / max(count[v, 0], 1))
        z = x @ weights[v].astype(np.float32)
        p = _sigmoid(z.astype(np.float64))
        bend = (x * (share * p * (1 - p)).astype(np.float32)[:, None]).T @ x
        loss = (share * np.logaddexp(0, np.where(y > 0, -z, z))).sum()
        out += [[loss], x.T.astype(np.float64) @ (share * (p - y)), bend.reshape(-1)]
    return np.concatenate(out)


def newton(total: Callable, rounds: list[Round], start: list[np.ndarray], steps: int = STEPS) -> list[np.ndarray]:
    """Weights of both views, from ``start``; a step that raised the loss is cut to a quarter."""
    count = total(class_counts, rounds).reshape(2, 2)
    now = [w.copy() for w in start]
    best: list[tuple[float, np.ndarray] | None] = [None, None]
    for _ in range(steps):
        sums, at = total(slopes, rounds, now, count), 0
        for v in (0, 1):
            d = len(now[v])
            loss, slope, bend = sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
            at += 1 + d + d * d
            loss += RIDGE / 2 * float(now[v] @ now[v])
            if best[v] and loss > best[v][0]:
                now[v] = best[v][1] + (now[v] - best[v][1]) / 4
                continue
            best[v] = (loss, now[v])
            now[v] = now[v] - np.linalg.solve((bend + bend.T) / 2 + RIDGE * np.eye(d), slope + RIDGE * now[v])
    return now


def co_train_over(total: Callable, known: Rows, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """``known``: the labelled rows. ``total(work, *args)`` is the sum of ``work(rows, *args)`` over all parts of the table."""
    label, fold = known[2], known[3]
    train, held = fold != CALIBRATION, fold == CALIBRATION
    if not held.any() or len(set(label[held])) < 2:
        held = train
    if not len(label):
        return CoTrained(None, None, 0.5)
    prior = float(label.mean())
    if len(set(label[train])) < 2:
        return CoTrained(None, None, prior)

    def calibrated(weights: list[np.ndarray]) -> tuple[View, View]:
        made = [View(w, 1.0, 0.0) for w in weights]
        for v, m in enumerate(made):
            m.slope, m.offset = calibration(m.margin(known[v][held]), label[held])
        return made[0], made[1]

    # Before anything is handed over, the views learn from the labelled rows alone.
    models = calibrated([logistic(known[v][train], label[train].astype(np.float32)) for v in (0, 1)])
    done: list[Round] = []
    handed, low = 0, float(_logit(sure))
    for k in range(rounds):
        count = total(sure_counts, done, models, sure).reshape(2, 2, _BINS)
        cuts = np.full((2, 2), np.inf)
        for v, value in np.ndindex(2, 2):
            above = np.cumsum(count[v, value][::-1])[::-1]
            if above[0]:
                step = np.flatnonzero(above >= above[0] / (rounds - k))[-1]
                cuts[v, value] = low + step * (_TOP - low) / _BINS
                handed += int(above[step])
        if np.isinf(cuts).all():
            break
        done.append((models, cuts))
        models = calibrated(newton(total, done, [m.weights for m in models]))
    return CoTrained(models[0], models[1], prior, handed)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """``label`` is 0, 1 or -1 (unlabelled); labelled rows of fold ``CALIBRATION`` only calibrate."""
    rows, known = (text, meta, label, fold), label >= 0
    return co_train_over(lambda work, *args: work(rows, *args), (text[known], meta[known], label[known], fold[known]), rounds, sure)


# -- on Spark


def _fold(column) -> F.Column:
    return (F.crc32(column.cast("string")) % FOLDS).cast("int")


_COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _views(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_features(piece.column("text")), meta_features(*(piece.column(c).to_pylist() for c in ("source", "lang", "n_chars")))


def _rows(batch: pa.RecordBatch | pa.Table) -> Rows:
    view = lambda name, dim: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
    return view("text", TEXT_DIM), view("meta", META_DIM), np.array(batch.column("label"), np.int64), np.array(batch.column("fold"), np.int64)


def feature_table(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``label, fold, text, meta`` of every row but the labelled ones held out; label -1: unlabelled. Stored, as every round reads it."""
    docs, labels = only(docs, *_COLUMNS), only(labels, "doc_id", "quality").filter("quality IN (0, 1)")
    limit = int(min(1.0, max_labelled / max(labels.count(), 1)) * (1 << 30))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < limit
    known = labels.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("label", F.when(chosen, F.col("quality")).otherwise(-1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array([r.tobytes() for r in m.astype(np.float16)], pa.binary()) for m in _views(piece))],
                    names=["doc_id", "text", "meta"],
                )

    made = map_batches(docs, vectors, "doc_id long, text binary, meta binary").join(known, "doc_id", "left")
    fold = F.coalesce(_fold(F.col("doc_id")), F.lit(-1))
    return cut_lineage(made.filter(F.col("quality").isNull() | (fold != 0)).select(F.coalesce("label", F.lit(-1)).alias("label"), fold.alias("fold"), "text", "meta"))


def totals(stored: DataFrame) -> Callable:
    """``total`` of ``co_train_over`` on Spark: a sum per task, then ``PARTS`` sums of those, then one on the driver."""

    def total(work: Callable, *args) -> np.ndarray:
        shared = stored.sparkSession.sparkContext.broadcast(args)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for k in range(0, batch.num_rows, 2048):
                    one = work(_rows(batch.slice(k, 2048)), *shared.value)
                    found = one if found is None else found + one
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["part"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for one in batch.column("part"):
                    one = np.frombuffer(one.as_py(), np.float64)
                    found = one if found is None else found + one
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["part"])

        sums = map_batches(map_batches(stored, part, "part binary").repartition(PARTS), added, "part binary").toArrow()
        return np.sum([np.frombuffer(one, np.float64) for one in sums.column("part").to_pylist()], axis=0)

    return total


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    """Fit on all rows and a bounded sample of labels; only labelled rows and sums reach the driver."""
    stored = feature_table(docs, labels, max_labelled)
    return co_train_over(totals(stored), _rows(stored.filter("label >= 0").toArrow()))


_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.float64()) for c in ("text_score", "meta_score", "score")), ("keep", pa.bool_())])


def score(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` of every row; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                a, b, both = shared.value.score(*_views(piece))
                yield frame(_ARROW, piece.column("doc_id"), a, b, both, both >= threshold)

    return map_batches(only(docs, *_COLUMNS), run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
