from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from chartloom.operators import splits
from chartloom.operators.ranking import hash_rank, hash_sample
from chartloom.operators.skew import hot_keys, skewed_join


@pytest.fixture(scope="module")
def labels(spark):
    return spark.range(200).select(F.col("id").alias("subject_id"), (F.col("id") % 3 == 0).cast("int").alias("readm"))


@pytest.fixture(scope="module")
def notes(spark):
    # patient 7 holds a third of all notes; patients 200.. have no label
    heavy = spark.range(300).select(F.lit(7).cast("bigint").alias("subject_id"), F.col("id").alias("hadm_id"))
    light = spark.range(600).select((F.col("id") % 210).alias("subject_id"), (F.col("id") + 1000).alias("hadm_id"))
    return heavy.unionByName(light)


def ids(df):
    return sorted(r["subject_id"] for r in df.select("subject_id").distinct().collect())


def test_hash_rank_is_the_global_order(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 2)
    got = {r["id"]: r["rank"] for r in hash_rank(df, "id", ["g"], seed=5).collect()}
    for g in (0, 1):
        members = sorted((i for i in range(5000) if i % 2 == g), key=lambda i: hashlib.md5(f"5-{i}".encode()).hexdigest())
        assert [got[i] for i in members] == list(range(1, len(members) + 1))


def test_holdout_sizes_are_exact(labels):
    chosen = splits.holdout_patients(labels, 0.2, seed=3).collect()
    size = int(0.2 * 200)
    positives = int(67 / 200 * size)
    assert Counter(r["readm"] for r in chosen) == {1: positives, 0: size - positives}
    assert {r["subject_id"] for r in chosen} == {r["subject_id"] for r in splits.holdout_patients(labels, 0.2, seed=3).collect()}
    assert {r["subject_id"] for r in chosen} != {r["subject_id"] for r in splits.holdout_patients(labels, 0.2, seed=4).collect()}


@pytest.mark.parametrize("frac", [0.0, -0.1, 0.41, 1.0])
def test_holdout_fraction_is_checked(labels, frac):
    with pytest.raises(ValueError):
        splits.holdout_patients(labels, frac)


def test_splits_partition_the_notes(notes, labels):
    chosen = splits.holdout_patients(splits.labels_with_notes(labels, notes))
    train, test = splits.outside(notes, chosen, ["hadm_id"]), splits.inside(notes, chosen, ["hadm_id"])
    assert train.count() + test.count() == notes.count()
    assert not set(ids(train)) & set(ids(test))
    assert set(range(200, 210)) <= set(ids(train))  # unlabelled patients stay in train
    marked = splits.split_column(notes, chosen, ["hadm_id"])
    assert marked.filter("split = 'test'").count() == test.count()


def test_validation_keeps_patients_whole(notes):
    chosen = splits.validation_patients(notes, 0.25)
    assert chosen.count() == int(0.25 * 210)
    marked = splits.split_column(notes, chosen, ["hadm_id"])
    assert marked.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_folds_are_balanced(labels):
    counts = splits.stratified_folds(labels, 5).groupBy("readm", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r["readm"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,), (None,)], "readm int")
    got = {r["readm"]: r["class_weight"] for r in splits.class_weights(df).collect()}
    assert got == {1: 4 / (2 * 3), 0: 4 / (2 * 1)}
    rows = splits.with_class_weight(df).collect()
    assert len(rows) == 5 and sum(r["class_weight"] is None for r in rows) == 1


def test_audit(labels):
    rows = splits.holdout_audit(labels).collect()
    assert sum(r["n"] for r in rows if r["split"] == "test") == rows[0]["holdout_expected"] == 40


def test_corpus_summary(notes, labels):
    got = {(r["source"], r["measure"]): r["value"] for r in splits.corpus_summary(notes, labels).collect()}
    assert got == {
        ("notes", "rows"): 900, ("notes", "admissions"): 900, ("notes", "patients"): 210,
        ("labels", "rows"): 200, ("labels", "patients"): 200,
    }


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_equals_a_plain_join(notes, labels, how):
    dim = labels.filter("subject_id % 2 = 1")
    plain = notes.join(dim, "subject_id", how)
    cut = skewed_join(notes, dim, ["subject_id"], how, spread_by=["hadm_id"], hot_rows=10)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_hot_keys_are_cut_in_proportion(notes):
    got = {r["subject_id"]: r["_parts"] for r in hot_keys(notes.groupBy("subject_id").count(), ["subject_id"], 100).collect()}
    assert got == {7: 4}  # 303 rows


def test_join_types_that_repeat_facts_are_refused(notes, labels):
    with pytest.raises(ValueError):
        skewed_join(notes, labels, ["subject_id"], "full", spread_by=["hadm_id"])


def test_null_keys_and_strata_stay(spark):
    from chartloom.operators.ranking import hash_rank, hash_sample
    from chartloom.operators.skew import skewed_join

    rows = spark.createDataFrame([(1, 0), (2, None), (None, 1), (None, None), (3, 0), (4, None)], "subject_id long, readm int")
    ranked = [(r.readm, r["rank"]) for r in hash_rank(rows, "subject_id", ["readm"]).collect()]
    assert sorted(ranked, key=str) == sorted([(0, 1), (0, 2), (None, 1), (None, 2), (None, 3), (1, 1)], key=str)
    dim = spark.createDataFrame([(1, "a"), (None, "b")], "subject_id long, name string")
    for how, count in (("left", 6), ("left_anti", 5), ("inner", 1), ("left_semi", 1)):
        assert skewed_join(rows, dim, ["subject_id"], how, spread_by=["readm"], hot_rows=1).count() == count


@pytest.mark.parametrize("strata,quotas", [(["g"], {0: 700, 1: 3, 2: 0}), (["g"], {0: 10_000, 2: 1999}), ([], 2500), ([], 0), ([], 10_000)])
def test_sample_without_ranking_equals_the_ranked_one(spark, strata, quotas):
    df = spark.range(6000).withColumn("g", F.when(F.col("id") % 100 < 99, F.col("id") % 3).cast("int"))
    if strata:
        wanted = spark.createDataFrame(list(quotas.items()), "g int, quota long")
        ranked = hash_rank(df, "id", strata, seed=4).join(wanted, "g")
    else:
        wanted = spark.createDataFrame([(quotas,)], "quota long")
        ranked = hash_rank(df, "id", seed=4).withColumn("quota", F.lit(quotas))
    got = hash_sample(df, "id", strata, lambda counts: wanted, seed=4)
    assert got.columns == ["id", *strata]
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in ranked.filter("rank <= quota").collect())


def test_sampling_moves_few_rows(labels):
    chosen = splits.holdout_patients(labels, 0.2)
    assert plan_of(chosen).count("Exchange hashpartitioning") + plan_of(chosen).count("Arguments: hashpartitioning") <= 3
    empty = splits.holdout_patients(labels.limit(0), 0.2)
    assert empty.count() == 0 and splits.holdout_audit(labels.limit(0)).count() == 0
