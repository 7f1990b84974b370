from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chartloom.functions import scores
from chartloom.operators import windows
from chartloom.operators.vocabulary import CLS_ID, PAD_ID, SEP_ID, UNK_ID
from chartloom.session import cut_lineage

L = 6


@pytest.fixture(scope="module")
def notes(spark):
    lengths = [0, 1, L - 3, L - 2, L - 1, 2 * L - 2, 2 * L - 1, 3 * L, 50]
    rows = [(i, " ".join(f"w{(i + k) % 7}" for k in range(n)), i % 2) for i, n in enumerate(lengths)]
    return spark.createDataFrame([*rows, (99, None, None)], "note long, text string, readm int")


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_windows_rebuild_the_notes(notes, hot_rows):
    vocab = windows.corpus_vocabulary(notes)
    ids = {r["term"]: r["token_id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(SEP_ID + 1, SEP_ID + 1 + len(ids)))
    rows = windows.sequence_windows(notes, ["note"], vocab, seq_len=L, keep=["readm"], hot_rows=hot_rows).collect()
    for note, text, readm in notes.collect():
        mine = sorted((r for r in rows if r["note"] == note), key=lambda r: r["seq_idx"])
        tokens = [ids[w] for w in (text or "").split()]
        overflow = max(0, len(tokens) - (L - 2))
        assert [r["seq_idx"] for r in mine] == list(range(1 + -(-overflow // L)))
        assert all(len(r["input_ids"]) == len(r["attn_mask"]) == L and r["readm"] == readm for r in mine)
        real = [[i for i, m in zip(r["input_ids"], r["attn_mask"]) if m] for r in mine]
        assert real[0][0] == CLS_ID and real[0][-1] == SEP_ID
        assert real[0][1:-1] + [i for block in real[1:] for i in block] == tokens
        assert all(i == PAD_ID for r in mine for i, m in zip(r["input_ids"], r["attn_mask"]) if not m)


def test_rare_terms_become_unknown(spark):
    df = spark.createDataFrame([(1, "a a b")], "note long, text string")
    row = windows.sequence_windows(df, ["note"], windows.corpus_vocabulary(df, min_count=2), seq_len=5).first()
    assert row["input_ids"] == [CLS_ID, 103, 103, UNK_ID, SEP_ID]


def test_a_note_sends_each_distinct_term_once(spark):
    """One word over thousands of positions and blocks; a stored vocabulary serves as the counts, so three exchanges remain."""
    df = spark.createDataFrame([(1, "x " * 5000 + "y"), (2, "y x")], "note long, text string")
    vocab = cut_lineage(windows.corpus_vocabulary(df))
    ids = {r["term"]: r["token_id"] for r in vocab.collect()}
    rows = windows.sequence_windows(df, ["note"], vocab, seq_len=L, totals=vocab, hot_rows=3)
    got = {(r["note"], r["seq_idx"]): [i for i, m in zip(r["input_ids"], r["attn_mask"]) if m] for r in rows.collect()}
    long = [i for k in range(1 + -(-(5001 - (L - 2)) // L)) for i in got[1, k]]
    assert long == [CLS_ID, *[ids["x"]] * (L - 2), SEP_ID, *[ids["x"]] * (5000 - (L - 2)), ids["y"]]
    assert got[2, 0] == [CLS_ID, ids["y"], ids["x"], SEP_ID] and max(map(len, got.values())) == L
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_window_length_is_checked(notes):
    with pytest.raises(ValueError):
        windows.sequence_windows(notes, ["note"], windows.corpus_vocabulary(notes), seq_len=2)


def test_pooled_scores(spark):
    rows = [(1, 0, [0.5, 2.0], 1), (2, 1, [1.0, -1.0], 0), (2, 0, [3.0, 5.0], 1), (2, 2, [2.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "subject_id long, seq_idx long, logits array<double>, label int")
    got = {r["subject_id"]: r for r in windows.pool_scores(df).collect()}
    assert got[1]["logits"] == [0.5, 2.0] and got[1]["label"] == 1
    factor = 3 / 2.0
    expected = [(3.0 + 2.0 * factor) / (1 + factor), (5.0 + 4 / 3 * factor) / (1 + factor)]
    assert got[2]["logits"] == pytest.approx(expected) and got[2]["label"] == 1 and got[2]["n_sequences"] == 3
    assert 2.0 <= got[2]["logits"][0] <= 3.0


def test_score_expressions(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([1000.0, -1000.0], 1), ([-1.0, 2.0], 1)], "x array<double>, y int")
    rows = df.select(scores.predicted_class(F.col("x")), scores.margin(F.col("x")), scores.cross_entropy(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in rows] == [0, 0, 1]
    assert [r[1] for r in rows] == [0.0, -2000.0, 3.0]
    assert [r[2] for r in rows] == pytest.approx([0.6931471805599453, 2000.0, 0.04858735157374196])
