"""Every catalog query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
import os
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from conftest import plan_of

import __spark_entry__ as contract
from chartloom.catalog import QUERIES
from chartloom.catalog_sql import SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
ORACLE = SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA / name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, str) else round(float(v), 6) + 0.0

    return sorted((tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


# Whole searches take minutes; RUN_SLOW=1 adds them.
SLOW = {"grid_search", "w2v_search", "patient_alpha_search", "bow_report", "embedding_report"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    if name in SLOW and not os.environ.get("RUN_SLOW"):
        pytest.skip("slow")
    ours = contract.queries()[name](spark, str(DATA)).toPandas()
    theirs = duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_query_runs(spark, name):
    assert contract.queries()[name](spark, str(DATA)).count() > 0


@pytest.mark.parametrize("name,columns", [
    ("corpus_summary", {"conv_id", "turn"}), ("split_anti", {"conv_id", "turn"}), ("annotate_concepts", {"doc_id", "text"}),
    ("binary_metrics", {"doc_id", "n_chars"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = plan_of(contract.queries()[name](spark, str(DATA)))
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<(.*?)>\n", plan) for c in schema.split(",") if c}
    others = {"text", "role", "lang", "source", "n_chars", "conv_id", "turn", "doc_id"} - columns
    assert columns <= read and not read & others - ({"text"} if name == "annotate_concepts" else set())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["subject_id", "term", "weight", "readm"] and df.count() > 0


def test_no_oracle_without_a_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
