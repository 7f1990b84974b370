from __future__ import annotations

from datetime import datetime, timedelta

from conftest import plan_of

from chartloom.operators import labels

DAY = timedelta(days=1)
START = datetime(2100, 1, 1)


def run(spark, cases):
    rows = [(s, h, t) for s, times in cases.items() for h, t in enumerate(times)]
    df = spark.createDataFrame(rows, "subject_id long, hadm_id long, admittime timestamp")
    return {r["subject_id"]: r["readm"] for r in labels.readmission_labels(df).collect()}


def test_edges(spark):
    got = run(
        spark,
        {
            1: [START],  # one admission
            2: [START, START + 10 * DAY],
            3: [START, START],  # gap 0: dropped
            4: [START, START + 180 * DAY],  # strict upper bound
            5: [START, START + 180 * DAY - timedelta(microseconds=1)],
            6: [START, START + DAY, START + 400 * DAY],  # only the last gap counts
            7: [START + 500 * DAY, START, START + 499 * DAY],  # unordered input
            8: [START, None],  # unknown time sorts last
            9: [None, None],
            10: [START, START + timedelta(microseconds=1)],
            11: [None],
        },
    )
    assert got == {1: 0, 2: 1, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0, 9: 0, 10: 1, 11: 0}


def test_group_limit_runs_before_the_exchange(spark):
    df = spark.createDataFrame([(1, 1, START)], "subject_id long, hadm_id long, admittime timestamp")
    plan = plan_of(labels.readmission_labels(df))
    assert plan.count("WindowGroupLimit") >= 2


def test_prevalence(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "subject_id long, readm int")
    row = labels.prevalence(df).first()
    assert (row["n_patients"], row["n_readmitted"], row["prevalence"], row["prevalence_pct"]) == (4, 2, 0.5, 50.0)


def test_prevalence_of_nobody(spark):
    row = labels.prevalence(spark.createDataFrame([], "subject_id long, readm int")).first()
    assert (row["n_patients"], row["n_readmitted"], row["prevalence"]) == (0, 0, None)
