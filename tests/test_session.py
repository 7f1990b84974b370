"""Stored tables and their removal."""

from __future__ import annotations

import os

from chartloom.session import SHUFFLE_CLEANUP_KEY, Scratch, tidy_shuffles


def test_scratch_tables_go_and_the_setting_comes_back(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY)
    with tidy_shuffles(spark), Scratch(spark) as tables:
        first, second = tables.keep(spark.range(10)), tables.keep(spark.range(20).repartition(3))
        folders = [path.removeprefix("file:") for _, path in tables.tables]
        assert spark.conf.get(SHUFFLE_CLEANUP_KEY) == "true" and all(map(os.path.exists, folders))
        tables.drop(first)
        assert [os.path.exists(f) for f in folders] == [False, True] and second.count() == 20
    assert not any(map(os.path.exists, folders)) and spark.conf.get(SHUFFLE_CLEANUP_KEY) == before
