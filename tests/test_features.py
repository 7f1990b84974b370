from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from chartloom.operators import features, pooling
from chartloom.operators.vectors import term_vectors, with_vectors

NOTES = [
    (1, 1, "a b a "), (1, 2, "b c"), (2, 1, ""), (2, 2, None), (3, 1, "d d d d A"), (3, 2, "a b c d"), (4, 9, "zz"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "subject_id long, hadm_id long, text string")


def brute_tfidf(rows):
    tf = {(s, h): Counter((t or "").split(" ")) for s, h, t in rows}
    df = Counter(term for c in tf.values() for term in c)
    idf = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}
    out = {}
    for key, counts in tf.items():
        raw = {t: n * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out.update({(*key, t): w / norm for t, w in raw.items()})
    return out


@pytest.mark.parametrize("hot_rows", [1, 2, 1_000_000])
def test_tfidf_and_patient_sum(notes, hot_rows):
    expected = brute_tfidf(NOTES)
    rows = features.tfidf(notes, ["subject_id", "hadm_id"], hot_rows=hot_rows)
    got = {(r["subject_id"], r["hadm_id"], r["term"]): r["weight"] for r in rows.collect()}
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)
    sums = defaultdict(float)
    for (s, _, t), w in expected.items():
        sums[s, t] += w
    summed = {(r["subject_id"], r["term"]): r["weight"] for r in features.patient_sum(rows).collect()}
    assert summed.keys() == sums.keys()
    assert all(math.isclose(summed[k], sums[k], rel_tol=1e-12) for k in sums)


def test_idf_learned_on_train_only_drops_unseen_terms(notes):
    tagged = notes.withColumn("split", F.when(F.col("subject_id") < 3, "train").otherwise("test"))
    rows = features.tfidf(tagged, ["subject_id", "hadm_id"], keep=["split"], fit_filter=F.col("split") == "train")
    assert {r["term"] for r in rows.collect()} == {"a", "b", "c", ""}


def test_term_frequencies_need_no_shuffle(notes):
    assert "Exchange" not in plan_of(features.term_frequencies(notes, ["subject_id", "hadm_id"]))


def test_patient_token_counts_bound_the_feature_rows(notes):
    bound = {r["subject_id"]: r["count"] for r in features.patient_token_counts(notes).collect()}
    rows = features.patient_sum(features.tfidf(notes, ["subject_id", "hadm_id"])).groupBy("subject_id").count().collect()
    assert all(r["count"] <= bound[r["subject_id"]] for r in rows)


def test_sparse_vectors(spark, notes):
    rows = features.patient_sum(features.tfidf(notes, ["subject_id", "hadm_id"]))
    vectors = {r["subject_id"]: r["features"] for r in term_vectors(rows).collect()}
    terms = {r["term"] for r in rows.collect()}
    for subject, group in rows.groupBy("subject_id").agg(F.collect_list("weight").alias("w")).collect():
        v = vectors[subject]
        assert v.size == len(terms) and sorted(v.values) == sorted(group)
    with pytest.raises(ValueError):
        term_vectors(rows, max_features=2)
    row = spark.createDataFrame([([1, 4], [1e-17, 1 / 3])], "i array<int>, w array<double>")
    one = with_vectors(row, 5, F.col("i"), F.col("w"), "v").first()["v"]
    assert list(one.indices) == [1, 4] and list(one.values) == [1e-17, 1 / 3]


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_note_vectors(spark, notes, hot_rows):
    table = {"a": [1.0, -2.0], "b": [0.0, 4.0], "d": [-1.0, -1.0]}
    words = spark.createDataFrame(list(table.items()), "word string, vector array<double>")
    rows = pooling.note_vectors(notes, ["subject_id", "hadm_id"], F.split(F.coalesce("text", F.lit("")), " "), words, 2, hot_rows=hot_rows)
    got = {(r["subject_id"], r["hadm_id"]): r["vector"] for r in rows.collect()}
    assert len(got) == len(NOTES)
    for s, h, t in NOTES:
        known = np.array([table[w] for w in (t or "").split(" ") if w in table])
        expected = np.concatenate([known.mean(0), known.max(0), known.min(0)]) if len(known) else np.zeros(6)
        assert np.allclose(got[s, h], expected)
    means = {r["subject_id"]: r["vector"] for r in pooling.mean_vectors(rows).collect()}
    assert np.allclose(means[1], np.mean([got[1, 1], got[1, 2]], 0)) and np.allclose(means[4], got[4, 9])


def test_note_vectors_send_a_word_once_a_block(spark):
    """Blocks of a few words, keys that repeat or are null, a word with two vectors; no partial sums of vectors are shuffled."""
    rows = [(i % 40, "a b a" if i % 3 else f"b w{i % 7} {'z' * (i % 2)}") for i in range(80)] + [(None, "a"), (99, None)]
    notes = spark.createDataFrame(rows, "note int, text string")
    table = [("a", [1.0, -2.0]), ("a", [3.0, 0.5]), ("b", [-1.0, 4.0])] + [(f"w{i}", [float(i), -float(i)]) for i in range(6)]
    words = spark.createDataFrame(table, "word string, vector array<double>")
    vectors = pooling.note_vectors(notes, ["note"], F.split("text", " "), words, 2, block_values=40)
    assert "aggregate_metrics" not in plan_of(vectors) and "summary" not in plan_of(vectors).lower()
    got = vectors.collect()
    assert sorted((r["note"] is None, r["note"]) for r in got if r["note"] is not None) == sorted((False, n) for n, _ in rows if n is not None)
    for r in got:
        known = np.array([v for n, t in rows if n == r["note"] and t for w in t.split(" ") for x, v in table if x == w])
        expected = np.concatenate([known.mean(0), known.max(0), known.min(0)]) if r["note"] is not None and len(known) else np.zeros(6)
        assert np.allclose(r["vector"], expected)


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None]])
def test_note_vectors_refuse_broken_word_vectors(spark, bad):
    notes = spark.createDataFrame([(1, "a b")], "note int, text string")
    words = spark.createDataFrame([("a", [1.0, 2.0]), ("b", bad)], "word string, vector array<double>")
    with pytest.raises(Exception, match="a word vector is null"):
        pooling.note_vectors(notes, ["note"], F.split("text", " "), words, 2).collect()


def test_fits_get_partitions_that_outweigh_their_gradients(spark):
    from chartloom.operators import models

    rows = spark.range(64).repartition(8).select("id", F.array(F.col("id")).alias("i"), F.array(F.lit(1.0)).alias("w"))
    stored = with_vectors(rows, 1 << 20, F.col("i"), F.col("w")).select("id", "features")
    assert stored.rdd.getNumPartitions() > 1 and models.compact(stored, least=8).rdd.getNumPartitions() == 1
    assert models.compact(stored.drop("features"), least=8).count() == models.compact(stored, least=8).count() == 64
