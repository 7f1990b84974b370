from __future__ import annotations

import pytest

from chartloom.plans import preprocess
from chartloom.sources import sinks
from chartloom.sources.release import Release, current


def both(spark, root, n):
    out = Release(spark, root)
    for name in ("a", "b"):
        sinks.write_table(spark.range(n), out.path(name))
    return out


def counts(spark, root):
    return {name: spark.read.parquet(path).count() for name, path in current(spark, root).items()}


def test_a_release_is_seen_whole(spark, tmp_path):
    root = str(tmp_path / "r")
    assert current(spark, root) == {}
    first = both(spark, root, 1)
    assert current(spark, root) == {}
    assert first.publish() == current(spark, root) and counts(spark, root) == {"a": 1, "b": 1}
    second = both(spark, root, 2)
    assert counts(spark, root) == {"a": 1, "b": 1}
    second.publish()
    assert counts(spark, root) == {"a": 2, "b": 2}


def test_a_failed_run_leaves_the_release_before_it(spark, tmp_path):
    root = str(tmp_path / "r")
    both(spark, root, 3).publish()
    out = Release(spark, root)
    sinks.write_table(spark.range(9), out.path("a"))
    with pytest.raises(Exception):
        sinks.write_table(spark.sql("SELECT raise_error('no') AS x"), out.path("b"))
        out.publish()
    out.path("c")
    with pytest.raises(FileNotFoundError):
        out.publish()
    assert counts(spark, root) == {"a": 3, "b": 3}


def test_unfinished_manifests_are_passed_over_and_numbers_are_taken_once(spark, tmp_path):
    root = tmp_path / "r"
    both(spark, str(root), 3).publish()
    (root / "_manifests" / "000000000002.json").write_text('{"outputs": {"a"')
    assert counts(spark, str(root)) == {"a": 3, "b": 3}
    both(spark, str(root), 4).publish()
    assert counts(spark, str(root)) == {"a": 4, "b": 4}
    assert sorted(p.name for p in (root / "_manifests").iterdir() if not p.name.startswith(".")) == ["000000000001.json", "000000000002.json", "000000000003.json"]


def test_holdout_tables_are_published_together(spark, tmp_path):
    notes = spark.range(60).selectExpr("id % 20 AS subject_id", "id AS hadm_id", "'x' AS text")
    labels = spark.range(20).selectExpr("id AS subject_id", "CAST(id % 2 AS INT) AS readm")
    paths = preprocess.holdout_tables(notes, labels, ["subject_id", "hadm_id"], str(tmp_path / "h"))
    assert paths == current(spark, str(tmp_path / "h"))
    bad = labels.selectExpr("subject_id", "IF(subject_id = 7, raise_error('no'), readm) AS readm")
    with pytest.raises(Exception):
        preprocess.holdout_tables(notes, bad, ["subject_id", "hadm_id"], str(tmp_path / "h"))
    assert current(spark, str(tmp_path / "h")) == paths
