"""Ranked search against brute force, classes of copies, odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from math import floor, log

import pyarrow as pa
import pytest
from helpers import LONG, docs, odd_rows, with_clashes
from pyspark.sql import functions as F

from chartloom.llm import lexical

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items, k):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in own.items():
        scored = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_rows(seed, n, copies):
    rng = random.Random(seed)
    words = ["ab", "Ab", "été", "x1", "q", "zz", "lo", "ß", "one", "two", "red", "blue"]
    text = lambda most: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, most)))
    rows = [(rng.randrange(10**6), text(30)) for _ in range(n)]
    rows += [(rng.randrange(10**6), rng.choice(rows)[1] + rng.choice(["", " unseen", " other"])) for _ in range(copies)]
    return rows, [(k, text(8)) for k in range(20)]


@pytest.mark.parametrize("seed,block,pairs", [(1, 1 << 20, 1 << 20), (2, 100, 50)])
def test_search_equals_brute_force(spark, monkeypatch, seed, block, pairs):
    monkeypatch.setattr(lexical, "PAIRS", pairs)
    rows, items = random_rows(seed, 150, 150)
    got = found(lexical.search(docs(spark, rows).repartition(5), spark.createDataFrame(items, ITEMS), 10, block))
    assert got == brute(rows, items, 10)


def test_large_class_is_expanded_by_id(spark):
    rows = [(k * 7 % 1009, "the same words, twice the words" + " !" * (k % 3)) for k in range(1, 400)] + [(2000 + k, f"other words {k}") for k in range(30)]
    items = [(1, "same words"), (2, "words twice"), (3, "nothing here"), (4, "other")]
    assert found(lexical.search(docs(spark, rows).repartition(6), spark.createDataFrame(items, ITEMS))) == brute(rows, items, 10)


def test_equal_bags_are_one_class(spark):
    shared = spark.sparkContext.broadcast(lexical.Vocabulary(["red blue"], [0]))
    rows = [(1, "red blue x red"), (2, "blue red, red: y"), (3, "red blue blue z"), (4, "q")]
    bags = {r.doc_id: (r.n, r.bag) for r in lexical.bags(docs(spark, rows).select("doc_id", "text"), shared).collect()}
    assert bags[1] == bags[2] != bags[3] and bags[4] == (1, b"")
    assert [x.tolist() for x in lexical.unpack([bags[1][1], b"", bags[3][1]])][0] == [0, 0, 2, 2]


def test_equal_hashes_are_no_match():
    vocabulary = lexical.Vocabulary(["cat"], [0])
    words = lexical.Words(pa.array(["dog cats cat"]), lexical.INSIDE)
    vocabulary.values = words.hash[:1]  # as if "dog" had the hash of "cat"
    n, (bag,) = vocabulary.bags(pa.array(["dog cats cat"]))
    assert n.tolist() == [3] and bag == b""


def test_search_edges(spark):
    rows = odd_rows() + [(9, "lorem"), (None, "lorem"), (10, "\x00\x7f"), (11, "İstanbul ISTANBUL")]
    items = [(1, "lorem ipsum"), (1, "été"), (2, None), (3, ""), (None, "harbour istanbul"), (5, "absentterm"), (6, LONG), (7, "lorem"), (7, "lorem")]
    item_frame = with_clashes(spark.createDataFrame(items, ITEMS)).withColumn("doc_id", F.lit("x"))
    got = found(lexical.search(with_clashes(docs(spark, rows)).withColumn("item_id", F.lit("y")).withColumn("item", F.lit("y")), item_frame))
    assert got == brute(rows, items, 10)
    frame = docs(spark, rows)
    assert lexical.search(frame.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(frame, spark.createDataFrame([], ITEMS)).count() == 0
