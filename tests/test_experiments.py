from __future__ import annotations

import random

import pytest
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import functions as F

from chartloom.operators import fits, models, splits
from chartloom.operators.annotate import annotate
from chartloom.plans import bow, embedding, preprocess, sequence
from chartloom.sources import sinks

KEY = ["subject_id", "hadm_id"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(30)]
    rows, labels = [], []
    for s in range(60):
        sick = s % 2
        labels.append((s, sick))
        for h in range(rng.randint(1, 3)):
            ws = [rng.choice(filler) for _ in range(12)] + [rng.choice(["relapse", "edema"] if sick else ["fine", "stable"])] * 3
            rng.shuffle(ws)
            rows.append((s, h, " ".join(ws)))
    notes = spark.createDataFrame(rows, "subject_id long, hadm_id long, text string").repartition(2).cache()
    return notes, spark.createDataFrame(labels, "subject_id long, readm int").cache()


@pytest.fixture(scope="module")
def tables(corpus):
    notes, labels = corpus
    chosen = splits.holdout_patients(labels, 0.3)
    return (
        splits.outside(notes, chosen, KEY), splits.outside(labels, chosen, ["subject_id"]),
        splits.inside(notes, chosen, KEY), splits.inside(labels, chosen, ["subject_id"]),
    )


def test_bow_experiment(tables, tmp_path):
    outcome = bow.run(*tables, KEY, alphas=[1e-3, 1e-1], n_folds=2, max_iter=5)
    assert len(outcome.search.candidates) == 4
    assert outcome.search.best["auroc"] == max(c["auroc"] for c in outcome.search.candidates) > 0.8
    row = outcome.report.first()
    assert row["n"] == 18 and row["auroc"] > 0.8 and row["accuracy"] > 0.6
    assert models.candidates_table(outcome.search, outcome.scores).columns == ["alpha", "auroc", "penalty"]
    root = str(tmp_path / "published")
    bow.publish(outcome, root)
    again = bow.published_model(tables[0].sparkSession, root)
    assert again.stages[-1].coefficients == outcome.search.model.stages[-1].coefficients
    stage = outcome.search.model.stages[-1]
    path = sinks.save_model(stage, str(tmp_path / "model"))
    if isinstance(stage, LinearSVCModel):
        assert LinearSVCModel.load(path).coefficients == stage.coefficients


def test_embedding_experiment(tables):
    outcome, dev = embedding.run(
        *tables, KEY, n_folds=2, max_iter=5, grid=embedding.embedding_grid([8], [5], [0.025]), alphas=[1e-2], min_count=1
    )
    assert [c["alpha"] for c in outcome.search.candidates] == pytest.approx([5e-3, 1e-2, 2e-2])
    assert outcome.report.first()["n"] == 18
    assert 0.0 <= dev.first()["auroc"] <= 1.0


def test_full_grids():
    assert len(embedding.embedding_grid()) * len(models.RATES) == 54
    assert len(models.BOW_ALPHAS) * 2 == 10


def test_unknown_penalty_is_refused(corpus):
    with pytest.raises(ValueError):
        models.grid_search(corpus[1], penalties=["l3"])


def test_sequence_preparation(corpus):
    notes, labels = corpus
    rows = sequence.prepare(notes, labels.filter("subject_id < 50"), KEY, seq_len=8)
    assert rows.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert rows.filter("readm IS NULL AND class_weight IS NOT NULL").count() == 0
    assert rows.filter("readm IS NULL").select("subject_id").distinct().count() == 10


def test_preprocessing_tables(spark, corpus, tmp_path):
    notes, labels = corpus
    paths = preprocess.holdout_tables(notes, labels, KEY, str(tmp_path / "h"))
    stored = spark.read.parquet(paths["notes"])
    assert stored.count() == notes.count()
    chosen = {r["subject_id"] for r in spark.read.parquet(paths["holdout"]).collect()}
    assert len(chosen) == 12
    assert {r["subject_id"] for r in stored.filter("split = 'test'").collect()} == chosen
    admissions = spark.createDataFrame([(1, 1, "2101-01-01"), (1, 2, "2101-02-01"), (2, 3, "2101-01-01")], "subject_id long, hadm_id long, t string")
    out = preprocess.label_tables(admissions.withColumn("admittime", F.to_timestamp("t")), str(tmp_path / "l"))
    assert spark.read.json(out["prevalence"]).first()["prevalence_pct"] == 50.0
    assert preprocess.clean_notes(notes).filter("text LIKE '%  %'").count() == 0


def test_annotated_table(spark, corpus, tmp_path):
    notes, _ = corpus
    terms = spark.createDataFrame([("relapse", "C1", ["T1"])], "term string, cui string, semtypes array<string>")
    path = preprocess.annotated_table(notes, KEY, terms, str(tmp_path / "a"), "csv", keep_similarity=True)
    stored = spark.read.csv(path, header=True)
    assert stored.columns == [*KEY, "text", "term", "cui", "semtypes", "sim_score"] and stored.count() == notes.count()
    assert annotate(notes, KEY, terms).filter("cui LIKE '%C1%'").count() > 0


def test_plans_take_any_note_key(spark):
    from chartloom.plans import bow, sequence

    notes = spark.createDataFrame(
        [(k, k % 4, f"word{k % 3} common text number{k}") for k in range(12)], "row_id long, subject_id long, text string"
    )
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "subject_id long, readm int")
    vectors = bow.patient_vectors(notes, ["row_id"], fit_filter=notes["row_id"] < 3)
    assert sorted(r.subject_id for r in vectors.collect()) == [0, 1, 2, 3]  # 3 has no known term but "common text"
    assert sequence.prepare(notes, labels, ["row_id"], seq_len=8).select("row_id").distinct().count() == 12


def test_stopped_search_goes_on_where_it_ended(spark, corpus, tmp_path):
    notes, labels = corpus
    trained, train = [], models.train_embedding

    def counting(*args, **options):
        trained.append(options["size"])
        if len(trained) == 3:
            raise RuntimeError("stopped")
        return train(*args, **options)

    options = dict(grid=embedding.embedding_grid([6, 8], [5], [0.025]), alphas=[1e-2, 1e-1], n_folds=2, max_iter=5, min_count=1, parallelism=1, results=str(tmp_path / "fits"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(models, "train_embedding", counting)
        with pytest.raises(RuntimeError):
            embedding.search(notes, labels, KEY, **options)
        best, found = embedding.search(notes, labels, KEY, **options)
        assert trained == [6, 6, 8, 8, 8]  # the third stopped the first search; the second trains the two that were left
        assert embedding.search(notes, labels, KEY, **options)[1] == found and len(trained) == 5
    assert len(found) == 4 and best in found


def test_fits_side_by_side_keep_their_own_properties(spark):
    """Queries inside threads that share local properties fail now and then; each fit has its own."""
    def fit(params):
        spark.sparkContext.setLocalProperty("own", str(params["k"]))
        n = spark.range(200).rdd.count()  # a query inside a query's properties
        return [{"auroc": float(n), "own": spark.sparkContext.getLocalProperty("own")}]

    params = [{"k": k} for k in range(24)]
    got = fits.run_fits(spark, params, fit, parallelism=8)
    assert [r[0]["own"] for r in got] == [str(k) for k in range(24)] and spark.sparkContext.getLocalProperty("own") is None


def test_mean_scores_leave_out_folds_without_a_value():
    params = [{"a": a, "fold": f} for a in (1, 2) for f in (0, 1)]
    scores = [[{"auroc": 0.5}], [{"auroc": None}], [{"auroc": 0.25}], [{"auroc": 0.75}]]
    assert fits.mean_scores(params, scores) == [{"a": 1, "auroc": 0.5}, {"a": 2, "auroc": 0.5}]
