"""Small tables shared by the operator tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
PLAIN = (
    "One morning the old keeper walked along the harbour wall and counted every boat that had come home before the storm. "
    "He wrote their names in a small blue book, closed it, and waited for the lamps to be lit on the far side of the bay."
)


def docs(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Nulls, empty and very long texts, repeated rows."""
    return [(1, PLAIN), (2, None), (3, ""), (4, LONG), (5, PLAIN), (5, PLAIN), (None, "text without an id"), (7, "*** %%% 123"), (8, "été à Noël ﬁn 中文")]


def with_clashes(df):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["n", "count", "key", "rep", "task", "component", "found", "_found", "_order", "score", "ids", "spans", "gram", "stretch"]
    return df.withColumns({name: F.lit("x") for name in names if name not in df.columns})
