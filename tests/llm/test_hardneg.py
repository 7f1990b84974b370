"""Hard negatives against brute force, slots and merges, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import with_clashes
from pyspark.sql import functions as F

from chartloom.llm import hardneg

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, n_pos=5, n_neg=5, percent=80):
    fine = [(k, y, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for k, v, y in rows
            if k is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dim = max((len(v) for *_, v in fine), default=0)
    fine = [(k, y, v + [0] * (dim - len(v))) for k, y, v in fine]
    out = []
    for a in sorted({k for k, *_ in fine if k in anchors}):
        _, label, own = min((k, y, v) for k, y, v in fine if k == a)
        scored = sorted((-sum(p * q for p, q in zip(own, v)), k, y) for k, y, v in fine if k != a)
        positives = [(-s, k) for s, k, y in scored if y == label][:n_pos]
        for u, positive in positives:
            window = [(-s, k) for s, k, y in scored if y != label and percent * u <= -100 * s <= 100 * u]
            out += [(a, positive, rank + 1, k, u, s) for rank, (s, k) in enumerate(window[:n_neg])]
    return sorted(out)


def random_vectors(seed, n, dim, labels, spread):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(k, [c + rng.choice([0.0, 0.0, spread]) for c in rng.choice(centres)], rng.randrange(labels)) for k in range(n)]
    return rows


def mined(spark, rows, anchors, **options):
    points = hardneg.points(with_clashes(spark.createDataFrame(rows, VECTORS)).withColumn("v", F.lit("x")).withColumn("slot", F.lit("x")).repartition(3), F.col("label"))
    return sorted(tuple(r) for r in hardneg.mine(points, points.filter(F.col("vec_id").isin(sorted(anchors))), **options).collect())


@pytest.mark.parametrize("seed,spread,options,limit", [(1, 0.05, {}, 1 << 20), (2, 0.3, {"anchor_rows": 4, "positives": 7}, 60), (3, 0.0, {"negatives": 2, "percent": 95}, 300), (4, 0.3, {"positives": 1}, 1 << 20)])
def test_mining_equals_brute_force(spark, monkeypatch, seed, spread, options, limit):
    monkeypatch.setattr(hardneg, "SCORES", limit)
    rows = random_vectors(seed, 240, 6, 3, spread)
    anchors = set(range(0, 240, 11))
    want = brute(rows, anchors, options.get("positives", 5), options.get("negatives", 5), options.get("percent", 80))
    assert mined(spark, rows, anchors, **options) == want and want


def test_slots_are_disjoint_and_cover_the_windows():
    limits = np.array([[50, 40, 40, -10, np.iinfo(np.int64).min]])
    values = np.array([[51, 50, 41, 40, 39, -9, -10, -11]])
    assert hardneg.slot_of(values, limits, np.array([-10])).tolist() == [[-1, 0, 0, 2, 2, 2, 3, -1]]


def test_slots_keep_the_best_whatever_the_order():
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(30), rng.randrange(8)) for _ in range(400)]
    best = hardneg.Slots(4, 3)
    for at in range(0, 400, 7):
        best.offer(*np.array(rows[at : at + 7]).T)
        if at % 5 == 0:
            best.result()
    want = [sorted(((-s, k) for c, k, s in rows if c == cell))[:3] for cell in range(4)]
    got = best.result()
    assert [[(-s, k) for k, s in got[1:, got[0] == cell].T] for cell in range(4)] == want


def test_large_integers_are_exact():
    x = np.array([[2.0**40 + 1, 3.0]])
    assert hardneg.scores(x, np.array([[2.0**20 + 1, 5.0]])).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15]]


def test_negative_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (3, [1.0, 0.5], None), (4, None, 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (7, [None, 1.0], 2),
            (8, [1.0], 2), (9, [], 1), (10, [-1.0, 0.0], 2), (11, [0.0, 0.0], 2), (None, [1.0, 0.5], 2), (12, [1.0, 0.4], 1), (0, [2.0, 0.5], 3), (12, [1.0, 0.4], 1)]
    anchors = {0, 2, 3, 9, 10, 11}
    assert mined(spark, rows, anchors) == brute(rows, anchors)
    assert mined(spark, rows, set()) == [] and mined(spark, rows[:1], {0}) == []
    empty = hardneg.points(spark.createDataFrame([], VECTORS), F.col("label"))
    assert hardneg.mine(empty, empty).count() == 0
