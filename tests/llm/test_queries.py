"""Registered queries against their SQL on the smallest tables, and the pipeline against its stages' brute force."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from test_groups import brute_components
from test_texts import brute_items

import __spark_entry__ as contract
import corpus_pipeline
from chartloom.llm import queries, secrets

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA / table}.parquet'")
    theirs = con.sql(queries.SQL[name])
    columns = sorted(theirs.columns)
    ours = contract.queries()[name](spark, str(DATA))
    assert sorted(ours.columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in ours.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    bench = [tuple(r) for r in spark.read.parquet(str(DATA / "benchmark.parquet")).select("item_id", "text").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True]):
        out = stage(spark, docs, str(DATA))
        assert last or out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)  # as if written and read again
        got = {r.doc_id: r for r in out.collect()}
        texts = [(d, r.text) for d, r in rows.items()]
        if name == "language_id":
            assert set(got) == {d for d, t in texts if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            assert set(got) == {d for d, (_, _, kept) in brute_components(texts, 5, 80).items() if kept}
        elif name == "decontamination":
            assert set(got) == set(rows) - {d for d, *_ in brute_items(texts, bench)} and len(got) < len(rows)
        elif name == "secret_scan":
            assert set(got) == set(rows)
            for d, t in texts:
                spans = secrets.all_spans(t or "")[1]
                assert (got[d].text == t) if not spans else not secrets.base_spans(got[d].text)
                assert got[d].n_chars == len(got[d].text)
        else:
            assert set(got) == set(rows) and all(r.n_tokens == len(r.ids) for r in got.values())
        rows, docs = got, out
