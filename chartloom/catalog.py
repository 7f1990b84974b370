"""Every operator as a runnable query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chartloom.functions import scores, text as tx
from chartloom.functions.similarity import MEASURES, similarity
from chartloom.operators import annotate, features, fits, metrics, models, pooling, splits, windows
from chartloom.operators.labels import admission_counts, prevalence
from chartloom.operators.vocabulary import vocabulary
from chartloom.plans import bow, embedding, preprocess, sequence
from chartloom.session import cut_lineage, shared_dir
from chartloom.sources import fixtures as fx, notes as src, sinks
from chartloom.sources.release import Release, current

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = fx.NOTE_KEY
EXCLUDED_TYPES = ["T0", "T3"]
DIM = 64
SEQ_LEN = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r6(c: Column | str) -> Column:
    return F.round(c, 6)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- scans, projections, filters --------------------------------------------------------------


@query
def scan_notes(spark, sf):
    return fx.turns(spark, sf).select(*KEY, tx.fill_null(F.col("text")).alias("text"))


@query
def scan_admissions(spark, sf):
    return fx.admissions(spark, sf).select(*KEY, F.unix_micros("admittime").alias("admit_us"))


@query
def csv_notes(spark, sf):
    """Documents written as CSV, with the line breaks of their texts in quotes, and read again as notes."""
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("subject_id"), F.col("doc_id").cast("string").alias("hadm_id"), "text")
    path = sinks.write_table(docs, f"{shared_dir(spark)}/notes-{uuid4().hex}", "csv")
    return src.read_notes(spark, path, "text", fmt="csv", multiline=True)


@query
def skip_ranges(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return src.skip_ranges(docs, "doc_id", [10, 60, 200, 450])


@query
def preview_limit(spark, sf):
    return src.preview(fx.turns(spark, sf).select(*KEY, "text"), KEY, 128)


@query
def normalize_text(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.normalize(F.col("text")).alias("text"))


@query
def tokenize_words(spark, sf):
    words = tx.word_tokens(tx.normalize(F.col("text")))
    return fx.documents(spark, sf).select(
        "doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, "|").alias("words")
    )


@query
def tokenize_sentences(spark, sf):
    found = tx.sentences(tx.normalize(F.col("text")))
    return fx.documents(spark, sf).select("doc_id", F.posexplode(found).alias("sentence_no", "sentence"))


@query
def word_granularity(spark, sf):
    found = F.posexplode(tx.sentence_words(F.col("text"))).alias("sentence_no", "w")
    return fx.documents(spark, sf).select("doc_id", found).select(
        "doc_id", "sentence_no", F.array_join("w", " ").alias("words")
    )


@query
def remove_stopwords(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.clean(F.col("text")).alias("text"))


@query
def augment_semtypes(spark, sf):
    types = F.nullif(F.col("role"), F.lit("assistant"))
    return fx.turns(spark, sf).select(*KEY, tx.append_semtypes(F.col("text"), types).alias("text"))


# --- labels and splits ------------------------------------------------------------------------


@query
def readmission_labels(spark, sf):
    return fx.derived_labels(spark, sf)


@query
def admissions_per_patient(spark, sf):
    return admission_counts(fx.admissions(spark, sf))


@query
def readmission_prevalence(spark, sf):
    return _rounded(prevalence(fx.derived_labels(spark, sf)))


@query
def corpus_summary(spark, sf):
    return splits.corpus_summary(fx.turns(spark, sf), fx.derived_labels(spark, sf))


@query
def distinct_patients(spark, sf):
    return splits.patients(fx.admissions(spark, sf))


@query
def notes_left_labels(spark, sf):
    notes = fx.turns(spark, sf).select(*KEY)
    # a double keeps unlabelled notes comparable across engines
    return splits.attach_labels(notes, fx.derived_labels(spark, sf), KEY).withColumn("readm", F.col("readm").cast("double"))


@query
def labels_with_notes(spark, sf):
    return splits.labels_with_notes(fx.derived_labels(spark, sf), fx.turns(spark, sf))


@query
def label_alignment(spark, sf):
    notes = fx.turns(spark, sf).select(*KEY)
    return splits.attach_labels(notes, fx.derived_labels(spark, sf), KEY, "inner")


@query
def patient_label_alignment(spark, sf):
    return splits.patient_labels(fx.turns(spark, sf), fx.derived_labels(spark, sf))


@query
def stratified_holdout(spark, sf):
    return splits.holdout_patients(fx.derived_labels(spark, sf))


@query
def holdout_audit(spark, sf):
    return splits.holdout_audit(fx.derived_labels(spark, sf))


def _noted_labels(spark, sf):
    return splits.labels_with_notes(fx.derived_labels(spark, sf), fx.turns(spark, sf))


@query
def holdout_of_noted_patients(spark, sf):
    """The hold-out set as drawn for an experiment: of labelled patients that have notes."""
    return splits.holdout_patients(_noted_labels(spark, sf))


@query
def audit_of_noted_patients(spark, sf):
    return splits.holdout_audit(_noted_labels(spark, sf))


def _holdout(spark, sf):
    """Hold-out patients, drawn once: several joins of a query use the same list."""
    labels = cut_lineage(fx.derived_labels(spark, sf))
    return cut_lineage(splits.holdout_patients(splits.labels_with_notes(labels, fx.turns(spark, sf))))


@query
def split_anti(spark, sf):
    return splits.outside(fx.turns(spark, sf).select(*KEY), _holdout(spark, sf), KEY)


@query
def split_semi(spark, sf):
    return splits.inside(fx.turns(spark, sf).select(*KEY), _holdout(spark, sf), KEY)


@query
def union_corpus(spark, sf):
    notes, chosen = fx.turns(spark, sf).select(*KEY, "text"), _holdout(spark, sf)
    return src.union_corpus(splits.outside(notes, chosen, KEY), splits.inside(notes, chosen, KEY))


@query
def grouped_split(spark, sf):
    notes = fx.turns(spark, sf).select(*KEY)
    chosen = splits.validation_patients(notes, 0.2)
    return splits.split_column(notes, chosen, KEY).withColumn(
        "split", F.when(F.col("split") == "test", "validation").otherwise("train")
    )


@query
def stratified_folds(spark, sf):
    return splits.stratified_folds(fx.derived_labels(spark, sf))


@query
def class_weights(spark, sf):
    notes = fx.turns(spark, sf).select(*KEY)
    return _rounded(splits.class_weights(splits.attach_labels(notes, fx.derived_labels(spark, sf), KEY)))


# --- bag of words -----------------------------------------------------------------------------


@query
def term_frequency(spark, sf):
    return features.term_frequencies(fx.documents(spark, sf), ["doc_id"])


@query
def idf(spark, sf):
    docs = fx.documents(spark, sf)
    df = features.document_frequencies(features.term_frequencies(docs, []))
    return _rounded(features.smoothed_idf(df, docs.agg(F.count("*")).scalar()))


@query
def tfidf(spark, sf):
    return _rounded(features.tfidf(fx.documents(spark, sf), ["doc_id"]))


def _clean_turns(spark, sf):
    return fx.turns(spark, sf).select(*KEY, tx.clean(F.col("text")).alias("text"))


@query
def patient_tfidf(spark, sf):
    notes = _clean_turns(spark, sf)
    rows = features.patient_sum(features.tfidf(notes, KEY))
    freq = features.patient_token_counts(notes)
    return _rounded(splits.attach_labels(rows, fx.derived_labels(spark, sf), ["term"], "inner", freq))


# --- vectors ----------------------------------------------------------------------------------


def _note_vectors(spark, sf):
    notes = fx.turns(spark, sf).select(*KEY, "text")
    words = tx.word_tokens(tx.normalize(F.col("text")))
    totals = notes.select(F.inline(tx.term_counts(words))).groupBy("term").agg(F.sum("tf").alias("count"))
    return pooling.note_vectors(notes, KEY, words, fx.word_vectors(spark, sf, totals), DIM)


@query
def vector_pool(spark, sf):
    vectors = _note_vectors(spark, sf)
    return _rounded(vectors.select(*KEY, F.posexplode("vector").alias("pos", "value")))


@query
def patient_mean_vector(spark, sf):
    vectors = pooling.mean_vectors(_note_vectors(spark, sf))
    return _rounded(vectors.select("subject_id", F.posexplode("vector").alias("pos", "value")))


@query
def embedding_group_mean(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select(
        F.col("label").alias("subject_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    means = pooling.mean_vectors(rows)
    return _rounded(means.select("subject_id", F.posexplode("vector").alias("pos", "value")))


# --- annotation -------------------------------------------------------------------------------


def _best(spark, sf, granularity="N", first=11, n_words=2):
    matches = annotate.match_spans(
        fx.documents(spark, sf), ["doc_id"], fx.dictionary(spark, sf, first, n_words), granularity=granularity
    )
    return annotate.best_concepts(matches, ["doc_id"])


def _best_rows(rows):
    columns = ["doc_id", "unit", "word_pos", "n_words", "span", "term", "cui"]
    return rows.select(
        *columns, F.array_join("semtypes", " ").alias("semtypes"), _r6("similarity").alias("similarity")
    )


@query
def best_concept(spark, sf):
    return _best_rows(_best(spark, sf))


@query
def annotate_sentences(spark, sf):
    return _best_rows(_best(spark, sf, "S"))


@query
def annotate_words(spark, sf):
    return _best_rows(_best(spark, sf, "W", 11, 1))


@query
def filter_semtypes(spark, sf):
    return _best_rows(annotate.drop_excluded(_best(spark, sf), EXCLUDED_TYPES))


@query
def filter_listed_semtypes(spark, sf):
    """As ``filter_semtypes``, with the types read from a line list."""
    path = f"{shared_dir(spark)}/types-{uuid4().hex}"
    fx.dictionary(spark, sf).select(F.explode("semtypes").alias("value")).filter(F.col("value").isin(EXCLUDED_TYPES)).write.text(path)
    return _best_rows(annotate.drop_excluded(_best(spark, sf), src.read_line_list(spark, path)))


@query
def annotate_sentence_cuis(spark, sf):
    return annotate.annotate(fx.documents(spark, sf), ["doc_id"], fx.dictionary(spark, sf), granularity="S", attribute="cui")


@query
def annotate_word_terms(spark, sf):
    return annotate.annotate(fx.documents(spark, sf), ["doc_id"], fx.dictionary(spark, sf, 11, 1), granularity="W", attribute="term")


def _score_string(c: str) -> Column:
    return F.array_join(F.transform(c, lambda s: F.format_number(s, 4)), " ")


@query
def annotate_concepts(spark, sf):
    rows = annotate.annotate(
        fx.documents(spark, sf), ["doc_id"], fx.dictionary(spark, sf), keep_similarity=True, excluded=EXCLUDED_TYPES
    )
    return rows.withColumn("sim_score", _score_string("sim_score"))


@query
def concept_strings(spark, sf):
    docs = fx.documents(spark, sf)
    arrays = annotate.concept_arrays(docs, _best(spark, sf), ["doc_id"])
    return annotate.concept_strings(arrays, ["doc_id"]).drop("sim_score")


@query
def corpus_variants(spark, sf):
    docs = fx.documents(spark, sf)
    strings = annotate.annotate(docs, ["doc_id"], fx.dictionary(spark, sf))
    variants = F.array(
        *(
            F.struct(F.lit(v + ("_st" if st else "")).alias("variant"),
                     (tx.append_semtypes(F.col(v), F.col("semtypes")) if st else F.col(v)).alias("text"))
            for v in ("term", "cui") for st in (False, True)
        )
    )
    original = docs.select("doc_id", F.lit("text").alias("variant"), tx.fill_null(F.col("text")).alias("text"))
    return original.unionByName(strings.select("doc_id", F.inline(variants)))


def _measures(pairs: DataFrame) -> DataFrame:
    def grams(c):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))

    sized = pairs.select(
        "span", "term",
        F.size(F.array_intersect(grams("span"), grams("term"))).alias("i"),
        F.size(grams("span")).alias("a"),
        F.size(grams("term")).alias("b"),
    )
    return sized.select(
        "span", "term", *(_r6(similarity(k, F.col("i"), F.col("a"), F.col("b"))).alias(k) for k in MEASURES)
    )


@query
def similarity_measures(spark, sf):
    return _measures(_best(spark, sf, first=11, n_words=1).select("span", "term").distinct())


@query
def similarity_of_candidates(spark, sf):
    """All measures of every word and one-word term that share a trigram."""
    words = annotate.distinct_words(fx.documents(spark, sf))
    rows = annotate.match_spans(
        words, ["word"], fx.dictionary(spark, sf, 11, 1), "word", granularity="W", kind="overlap", threshold=1e-6
    )
    return _measures(rows.select("span", "term").distinct())


def _measure_matches(spark, sf, kind, threshold):
    rows = annotate.match_spans(
        fx.turns(spark, sf), KEY, fx.dictionary(spark, sf), kind=kind, threshold=threshold
    )
    return rows.select(*KEY, "word_pos", "n_words", "span", "term", "cui", _r6("similarity").alias("similarity"))


@query
def matches_dice(spark, sf):
    return _measure_matches(spark, sf, "dice", 0.8)


@query
def matches_cosine(spark, sf):
    return _measure_matches(spark, sf, "cosine", 0.8)


@query
def matches_overlap(spark, sf):
    return _measure_matches(spark, sf, "overlap", 0.9)


# --- sequences and scores ---------------------------------------------------------------------


@query
def corpus_vocabulary(spark, sf):
    notes = _clean_turns(spark, sf)
    return windows.corpus_vocabulary(notes, min_count=2)


@query
def sequence_prepare(spark, sf):
    """Labelled windows with their split by patient and the weight of their class."""
    rows = sequence.prepare(_clean_turns(spark, sf), fx.derived_labels(spark, sf), KEY, seq_len=SEQ_LEN)
    return _rounded(rows.select(*KEY, "seq_idx", "split", F.col("readm").cast("double").alias("readm"), "class_weight"))


@query
def sequence_windows(spark, sf):
    # cleaned once and stored, as is the vocabulary: both are read again
    notes = cut_lineage(splits.attach_labels(_clean_turns(spark, sf), fx.derived_labels(spark, sf), KEY))
    vocab = cut_lineage(vocabulary(windows.term_totals(notes), min_count=2))
    rows = windows.sequence_windows(notes, KEY, vocab, seq_len=SEQ_LEN, keep=["readm"], totals=vocab)
    return rows.select(
        *KEY, F.col("readm").cast("double").alias("readm"), "seq_idx",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attn_mask").cast("array<string>"), " ").alias("attn_mask"),
    )


@query
def predicted_classes(spark, sf):
    rows = fx.logits(spark, sf)
    return rows.select("subject_id", "seq_idx", scores.predicted_class(F.col("logits")).alias("prediction"))


@query
def pool_scores(spark, sf):
    pooled = windows.pool_scores(fx.logits(spark, sf))
    return pooled.select(
        "subject_id", "n_sequences", "label",
        *(_r6(F.get("logits", F.lit(c))).alias(f"logit{c}") for c in (0, 1)),
        scores.predicted_class(F.col("logits")).alias("prediction"),
    )


# --- metrics ----------------------------------------------------------------------------------


@query
def binary_metrics(spark, sf):
    return _rounded(metrics.binary_metrics(fx.document_scores(spark, sf)))


@query
def weighted_metrics(spark, sf):
    return _rounded(metrics.weighted_metrics(fx.document_scores(spark, sf)))


@query
def auroc(spark, sf):
    return _rounded(metrics.auroc(fx.document_scores(spark, sf)))


@query
def cross_entropy(spark, sf):
    return _rounded(metrics.mean_cross_entropy(fx.logits(spark, sf)))


@query
def metrics_guard(spark, sf):
    """All documents, and those with a positive label alone, in one pass."""
    groups = F.array_compact(F.array(F.lit("both"), F.when(F.col("label") == 1, F.lit("positive"))))
    return _rounded(metrics.guarded_metrics(fx.document_scores(spark, sf).withColumn("labels", F.explode(groups)), by=["labels"]))


@query
def evaluation_report(spark, sf):
    return _rounded(metrics.evaluation_report(fx.logits(spark, sf)))


@query
def report_sink(spark, sf):
    """The evaluation report written as JSON and read again."""
    rows = _rounded(metrics.evaluation_report(fx.logits(spark, sf)))
    path = sinks.write_report(rows, f"{shared_dir(spark)}/report-{uuid4().hex}")
    return spark.read.schema(rows.schema).json(path)


@query
def metrics_by_level(spark, sf):
    return _rounded(metrics.metrics_by_level(fx.logits(spark, sf)))


# --- models and sinks ---------------------------------------------------------------------------
# Trained numbers have no SQL twin. These queries train with the operators' own parameters and
# return what is determined: who is scored, candidates, known words, and the relations that must hold.


def _valid(auroc: str = "auroc") -> Column:
    return F.col(auroc).between(0.0, 1.0).alias("valid")


def _bow_rows(spark, sf):
    labels = cut_lineage(fx.derived_labels(spark, sf))
    notes = _clean_turns(spark, sf)
    chosen = cut_lineage(splits.holdout_patients(splits.labels_with_notes(labels, notes)))
    vectors = bow.patient_vectors(notes, KEY)
    return models.compact(cut_lineage(vectors.join(splits.split_column(labels, chosen, ["subject_id"]), "subject_id")))


def _scores(spark, sf, estimator):
    rows = _bow_rows(spark, sf)
    model = estimator.fit(rows.filter("split = 'train'"))
    scored = models.score(model, rows.filter("split = 'test'"))
    finite = F.col("score").isNotNull() & ~F.isnan("score")
    agrees = (F.col("score") > 0) == (F.col("prediction") == 1)
    return scored.select("subject_id", "readm", finite.alias("scored"), agrees.alias("agrees"))


@query
def svm_scores(spark, sf):
    return _scores(spark, sf, models.linear_svm(1e-2))


@query
def elastic_net_scores(spark, sf):
    return _scores(spark, sf, models.elastic_net(1e-2))


@query
def model_reload(spark, sf):
    """Both classifiers saved and loaded again: whether they score every test patient as before."""
    rows = _bow_rows(spark, sf)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    out = Release(spark, f"{shared_dir(spark)}/models-{uuid4().hex}")
    fitted = {"l2": models.linear_svm(1e-2).fit(train), "elasticnet": models.elastic_net(1e-2).fit(train)}
    for penalty, model in fitted.items():
        sinks.save_model(model, out.path(penalty))
    out.publish()
    found = []
    for penalty, path in current(spark, out.root).items():
        again = type(fitted[penalty]).load(path)
        both = models.score(fitted[penalty], test).join(models.score(again, test).withColumnRenamed("score", "again"), "subject_id")
        found.append(both.select(F.lit(penalty).alias("penalty"), "subject_id", (F.col("score") == F.col("again")).alias("equal")))
    return reduce(DataFrame.unionByName, found)


def _tables(spark, sf):
    """Notes and labels of train and test patients, as the experiments take them."""
    labels = cut_lineage(_noted_labels(spark, sf))
    notes, chosen = fx.turns(spark, sf).select(*KEY, "text"), _holdout(spark, sf)
    by_label = (splits.outside(labels, chosen, ["subject_id"]), splits.inside(labels, chosen, ["subject_id"]))
    return splits.outside(notes, chosen, KEY), by_label[0], splits.inside(notes, chosen, KEY), by_label[1]


def _report_shape(report: DataFrame) -> DataFrame:
    """What is determined of a report: how many patients it covers, and that its rates are rates."""
    rates = [c for c in report.columns if c != "n"]
    inside = [F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True)) for c in rates]
    return report.select("n", reduce(and_, inside).alias("valid"))


@query
def bow_report(spark, sf):
    """The bag-of-words experiment from end to end: features, whole search, test report."""
    return _report_shape(bow.run(*_tables(spark, sf), KEY, parallelism=8).report)


@query
def embedding_report(spark, sf):
    """The embedding experiment from end to end, on one embedding of the grid: note-level search, patient-level refinement, both reports."""
    grid = embedding.embedding_grid([100], [5], [1e-2])
    outcome, dev = embedding.run(*_tables(spark, sf), KEY, grid=grid)
    reports = (_report_shape(r).withColumn("report", F.lit(name)) for name, r in (("test", outcome.report), ("train", dev)))
    return reduce(DataFrame.unionByName, reports)


@query
def grid_search(spark, sf):
    rows = _bow_rows(spark, sf).filter("split = 'train'").drop("split")
    found = models.grid_search(rows, parallelism=8)
    return models.candidates_table(found, rows).select("penalty", "alpha", _valid())


def _embedding(spark, sf):
    return models.train_embedding(fx.turns(spark, sf), embedding.tokens())


@query
def w2v_note_vectors(spark, sf):
    notes = fx.turns(spark, sf)
    vectors = embedding.note_features(notes, KEY, _embedding(spark, sf))
    size = F.size("vector") / 3
    mean, high, low = (F.slice("vector", (k * size + 1).cast("int"), size.cast("int")) for k in range(3))
    inside = F.zip_with(F.arrays_zip(low.alias("low"), high.alias("high")), mean, lambda r, m: (r["low"] <= m + 1e-6) & (m <= r["high"] + 1e-6))
    known = F.exists("vector", lambda x: x != 0)
    return vectors.select(*KEY, known.alias("known"), F.forall(inside, lambda b: b).alias("ordered"))


@query
def w2v_refit(spark, sf):
    notes, chosen = fx.turns(spark, sf).select(*KEY, "text"), _holdout(spark, sf)
    model = embedding.refit(
        splits.outside(notes, chosen, KEY), splits.inside(notes, chosen, KEY)
    )
    return models.word_table(model).select("word", F.size("vector").alias("size"))


@query
def w2v_search(spark, sf):
    notes, labels = fx.turns(spark, sf), fx.derived_labels(spark, sf)
    _, found = embedding.search(notes, labels, KEY)
    return fits.table_of(spark, found).select("size", "window", "rate", "alpha", _valid())


@query
def patient_alpha_search(spark, sf):
    vectors = embedding.note_features(fx.turns(spark, sf).select(*KEY, "text"), KEY, _embedding(spark, sf))
    rows = cut_lineage(embedding.patient_features(vectors, fx.derived_labels(spark, sf)))
    found = models.refine_alpha(rows, 1e-2, parallelism=8)
    return models.candidates_table(found, rows).select("penalty", "alpha", _valid())


@query
def holdout_tables(spark, sf):
    """Writes the four split tables to the shared folder and counts them after reading back."""
    out = f"{shared_dir(spark)}/holdout-{uuid4().hex}"
    paths = preprocess.holdout_tables(
        fx.turns(spark, sf).select(*KEY, "text"), fx.derived_labels(spark, sf), KEY, out
    )

    def counts(name):
        stored = spark.read.parquet(paths[name]).groupBy("split").agg(
            F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_patients")
        )
        return stored.withColumn("table", F.lit(name))

    return counts("notes").unionByName(counts("labels"))
