from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_text import normalize, words

from chartloom.functions.text import STOP_WORDS
from chartloom.functions import similarity as sim
from chartloom.operators import annotate, skew
from chartloom.operators.span_filter import least_shared

FORMULA = {
    "jaccard": lambda i, a, b: i / (a + b - i),
    "dice": lambda i, a, b: 2 * i / (a + b),
    "cosine": lambda i, a, b: i / (a * b) ** 0.5,
    "overlap": lambda i, a, b: i / min(a, b),
}
DICTIONARY = [
    ("heart failure", "C01", ["T1"]), ("heart failures", "C02", ["T2", "T0"]), ("renal failure", "C03", []),
    ("vitamin b12", "C04", ["T1"]), ("haha haha", "C05", ["T3"]), ("lung", "C06", ["T0"]), ("abc", "C07", ["T0", "T3"]),
    ("acute lung injury of the chest", "C08", ["T4"]), ("ab", "C09", ["T1"]), ("Heart Failure", "C10", ["T9"]),
]


def grams(s):
    return {s[i : i + 3] for i in range(len(s) - 2)}


def units_of(text, granularity):
    clean = normalize(text)
    if granularity == "N":
        return [words(clean)]
    parts = [p.strip(" ") for p in clean.replace(". ", ".\n").split("\n")]
    parts = [p for p in parts if p]
    if granularity == "S":
        return [words(p) for p in parts]
    return [[w for w in words(p.replace(".", "")) if w not in STOP_WORDS] for p in parts]


def brute(notes, dictionary, kind, threshold, granularity="N"):
    found = set()
    for note, text in notes:
        for u, ws in enumerate(units_of(text, granularity)):
            for k in range(len(ws)):
                for n in range(1, 2 if granularity == "W" else 6):
                    if k + n > len(ws):
                        break
                    span = " ".join(ws[k : k + n])
                    if not re.fullmatch("[a-z](.*[a-z])?", span):
                        continue
                    a = grams(span)
                    for term, cui, types in dictionary:
                        b = grams(term.lower())
                        shared = len(a & b)
                        if shared and FORMULA[kind](shared, len(a), len(b)) >= threshold:
                            value = round(FORMULA[kind](shared, len(a), len(b)), 9)
                            found.add((note, u, k, n, span, term.lower(), cui, tuple(sorted(types)), value))
    return found


def collected(df):
    return {
        (r["note"], r["unit"], r["word_pos"], r["n_words"], r["span"], r["term"], r["cui"], tuple(r["semtypes"]), round(r["similarity"], 9))
        for r in df.collect()
    }


def make_notes():
    rng = random.Random(11)
    vocabulary = "heart hart failure failures renal lung lungs acute injury of the chest haha ha ab abc vitamin b. pt. no".split()
    notes = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(25)]
    notes.append((100, None))
    notes.append((101, "!!! 123"))
    # a long note, so that spans cross the borders of the blocks it is cut into
    notes.append((102, " ".join(rng.choice(["heart", "failure", "lung", "x", "."]) for _ in range(1200))))
    # many copies of one note
    notes += [(200 + i, "acute renal failure. Heart-failure; lungs") for i in range(20)]
    return notes


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(make_notes(), "note long, text string").repartition(2).cache()


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "term string, cui string, semtypes array<string>").coalesce(1).cache()


BROADCAST, SHUFFLED = 10**6, 0


@pytest.mark.parametrize(
    "kind,threshold,granularity,bound",
    [
        ("jaccard", 0.7, "N", BROADCAST), ("jaccard", 0.7, "N", SHUFFLED), ("jaccard", 0.7, "S", SHUFFLED),
        ("jaccard", 0.7, "W", BROADCAST), ("jaccard", 1.0, "N", BROADCAST), ("jaccard", 0.3, "S", BROADCAST),
        ("dice", 0.8, "N", BROADCAST), ("cosine", 0.75, "S", BROADCAST), ("overlap", 0.9, "N", BROADCAST),
        ("overlap", 0.9, "S", SHUFFLED),
    ],
)
def test_matches_equal_brute_force(notes, dictionary, kind, threshold, granularity, bound):
    found = annotate.match_spans(
        notes, ["note"], dictionary, granularity=granularity, kind=kind, threshold=threshold,
        index_bytes_to_broadcast=bound, hot_rows=5,
    )
    rows = found.collect()
    expected = brute(make_notes(), DICTIONARY, kind, threshold, granularity)
    assert collected(found) == expected
    assert len(rows) == len(expected)  # every pair once


def test_random_words(spark):
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))

    terms = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(40)})
    dictionary = [(t, f"C{i}", [f"T{i % 3}"]) for i, t in enumerate(terms)]
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(texts, "note long, text string")
    terms_df = spark.createDataFrame(dictionary, "term string, cui string, semtypes array<string>")
    for kind, threshold in [("jaccard", 0.5), ("dice", 0.6), ("cosine", 0.6), ("overlap", 0.8)]:
        got = annotate.match_spans(df, ["note"], terms_df, kind=kind, threshold=threshold)
        assert collected(got) == brute(texts, dictionary, kind, threshold)


def test_best_concept_breaks_ties_by_cui(notes, dictionary):
    best = annotate.best_concepts(annotate.match_spans(notes, ["note"], dictionary), ["note"])
    rows = best.filter("span = 'heart failure'").select("cui", "similarity").distinct().collect()
    assert [(r["cui"], r["similarity"]) for r in rows] == [("C01", 1.0)]
    key = ["note", "unit", "word_pos", "n_words"]
    assert best.groupBy(*key).count().filter("count > 1").count() == 0


def test_excluded_types(spark, notes, dictionary):
    matches = annotate.match_spans(notes, ["note"], dictionary)
    kept = {r["cui"] for r in annotate.drop_excluded(matches, ["T0", "T3"]).select("cui").distinct().collect()}
    assert kept and not kept & {"C03", "C05", "C06", "C07"}  # C03 has no types at all
    table = spark.createDataFrame([("T0",), ("T3",)], "semtype string")
    again = {r["cui"] for r in annotate.drop_excluded(matches, table).select("cui").distinct().collect()}
    assert again == kept


def test_annotation_strings(spark, dictionary):
    df = spark.createDataFrame([(1, "Lung and heart failure"), (2, "nothing"), (3, None)], "note long, text string")
    rows = {
        r["note"]: r for r in annotate.annotate(df, ["note"], dictionary, keep_similarity=True, threshold=1.0).collect()
    }
    assert rows[1]["term"] == "lung heart failure " and rows[1]["cui"] == "C06 C01 "
    assert rows[1]["semtypes"] == "T0 T1 " and rows[1]["sim_score"] == [1.0, 1.0]
    assert rows[2]["term"] == rows[3]["cui"] == "" and rows[3]["sim_score"] == []
    only = annotate.annotate(df, ["note"], dictionary, attribute="cui", threshold=1.0)
    assert only.columns == ["note", "cui"]


def test_parameters_are_checked(notes, dictionary):
    for bad in ({"granularity": "X"}, {"kind": "edit"}, {"threshold": 0.0}, {"attribute": "name"},
                {"attribute": "cui", "excluded": ["T0"]}):
        with pytest.raises(ValueError):
            annotate.annotate(notes, ["note"], dictionary, **bad)


def test_empty_dictionary(spark, notes):
    empty = spark.createDataFrame([], "term string, cui string, semtypes array<string>")
    assert annotate.match_spans(notes, ["note"], empty).count() == 0
    assert annotate.annotate(notes, ["note"], empty).filter(F.col("term") != "").count() == 0


SYLLABLES = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le".split()


def large_dictionary(spark, n):
    """``n`` distinct two-word terms of syllables chosen by the digits of their numbers."""
    listed = F.array(*(F.lit(x) for x in SYLLABLES))

    def syllable(base):
        return F.element_at(listed, (F.floor(F.col("id") / F.lit(base)) % len(SYLLABLES) + 1).cast("int"))

    term = F.concat(syllable(1), syllable(30), F.lit(" "), syllable(900), syllable(27_000), syllable(7))
    return spark.range(n).select(term.alias("term"), F.format_string("C%06d", "id").alias("cui"), F.array(F.lit("T1")).alias("semtypes"))


def test_large_dictionary_through_the_shuffle(spark):
    rng = random.Random(8)
    texts = [(k, " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(40))) for k in range(10)]
    stored = annotate.store_dictionary(large_dictionary(spark, 100_000))
    assert stored.concepts.select("term").distinct().count() == 100_000
    known = [r.term for r in stored.concepts.filter("crc32(term) % 700 = 0").select("term").collect()]
    texts += [(100 + k, " ".join(known[k::12])) for k in range(12)]
    df = spark.createDataFrame(texts, "note long, text string")
    key = ["note", "word_pos", "n_words", "span", "term", "cui"]
    near, far = ({tuple(r) for r in annotate.match_spans(df, ["note"], stored, index_bytes_to_broadcast=bound).select(*key, F.round("similarity", 9)).collect()} for bound in (1 << 40, 0))
    assert near == far and len(near) > 100


def test_grid_balances_keys_that_are_hot_on_both_sides(spark):
    def side(n, name):  # the first key holds a third of the rows, the second a fifth
        share = F.col("id") % 15
        key = F.when(share < 5, 0).when(share < 8, 1).otherwise(F.col("id") % 997)
        return spark.range(n).select(key.alias("key"), F.col("id").alias(name))

    left, right = side(30_000, "l"), side(6_000, "r")
    grid = skew.join_grid(left, right, ["key"], cells=512)
    cell = ["key", "_rows_part", "_columns_part"]
    one, other = (skew.deal(s, grid, ["key"], [name], *dims).groupBy(*cell).agg(F.count("*").alias(name))
                  for s, name, dims in ((left, "l", ("_rows", "_columns")), (right, "r", ("_columns", "_rows"))))
    tasks = [r.work for r in one.join(other, cell).groupBy(F.pmod(F.hash(*cell), F.lit(16))).agg(F.sum(F.col("l") * F.col("r")).alias("work")).collect()]
    assert max(tasks) <= 2 * sorted(tasks)[8] and len(tasks) == 16
    joined = skew.grid_join(left, right, ["key"], left_spread=["l"], right_spread=["r"], cells=512)
    want = left.groupBy("key").count().join(right.groupBy("key").count().withColumnRenamed("count", "n"), "key").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert joined.count() == joined.select("l", "r").distinct().count() == want
    nulls = spark.createDataFrame([(None, 1), (1, 2)], "key long, l long")
    assert [tuple(r) for r in skew.grid_join(nulls, nulls.withColumnRenamed("l", "r"), ["key"], left_spread=["l"], right_spread=["r"]).collect()] == [(1, 2, 2)]


@pytest.mark.parametrize("kind,threshold", [("jaccard", 0.7), ("jaccard", 0.05), ("dice", 0.8), ("cosine", 0.75), ("cosine", 1.0), ("overlap", 0.5)])
def test_size_classes_miss_no_size(spark, kind, threshold):
    sizes = spark.range(1, 60).select(F.col("id").cast("int").alias("a"))
    low, high = sim.class_range(kind, threshold, F.col("a"))
    rows = sizes.select("a", low.alias("low"), high.alias("high"), sim.size_class(kind, threshold, F.col("a")).alias("own")).collect()
    own = {r.a: r.own for r in rows}
    for r in rows:
        for b in own:
            best = FORMULA[kind](min(r.a, b), r.a, b)
            assert best < threshold - 1e-9 or r.low <= own[b] <= r.high
            shared = int(least_shared(kind, threshold, r.a, b))
            assert shared > min(r.a, b) or FORMULA[kind](shared, r.a, b) >= threshold - 1e-9
            assert shared == 1 or FORMULA[kind](shared - 1, r.a, b) < threshold


def test_distinct_words_give_the_pairs_of_all_words(spark):
    """Each word once, with split words, stop words, periods and null texts; its matches are those of every place where it stands."""
    texts = ["Cannot tell. The fever, fever and chills.", "gonna lemme see FEVERS a.b chill's", None, "", "the of"]
    notes = spark.createDataFrame(list(enumerate(texts)), "note int, text string")
    terms = spark.createDataFrame([(w, f"C{i}", ["T0"]) for i, w in enumerate(["fever", "chills", "telling", "lemon"])], "term string, cui string, semtypes array<string>")
    words = annotate.distinct_words(notes)
    listed = [r["word"] for r in words.collect()]
    assert len(listed) == len(set(listed)) and {"fever", "fevers", "chills", "tell"} <= set(listed) and "the" not in listed
    options = {"granularity": "W", "kind": "overlap", "threshold": 1e-6}
    once, every = (
        {(r["span"], r["term"]) for r in annotate.match_spans(df, key, terms, text, **options).collect()}
        for df, key, text in ((words, ["word"], "word"), (notes, ["note"], "text"))
    )
    assert once == every and len(once) > 4
