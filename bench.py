"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores (default 8) and
BENCH_QUERIES a comma-separated list of query names (default: the list below). Every query
is run in full and its rows are discarded by the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from chartloom.catalog import QUERIES
from chartloom.session import build_session

HEADLINE = [
    "readmission_labels",
    "remove_stopwords",
    "tokenize_words",
    "corpus_summary",
    "notes_left_labels",
    "stratified_holdout",
    "stratified_folds",
    "union_corpus",
    "term_frequency",
    "idf",
    "tfidf",
    "patient_tfidf",
    "vector_pool",
    "patient_mean_vector",
    "annotate_concepts",
    "annotate_sentences",
    "matches_dice",
    "sequence_windows",
    "pool_scores",
    "auroc",
    "evaluation_report",
    "metrics_by_level",
    "svm_scores",
    "w2v_note_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__checkpoint__dir=os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-"),
        # small test files still give every core a share of their row groups
        spark__sql__files__maxPartitionBytes="2m",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
