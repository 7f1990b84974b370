from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chartloom.functions import text as tx

SAMPLES = [
    None, "", "   ", "123 %%% 456", "BP 120/80. Pt can't breathe...", "She cannot go. We gonna wait.",
    "wanna-be gimme lemme gotta", "Éléphant à côté. Fin", "a. . b.. c.d e.", "tab\tnew\nline  end ", "the and of to", "cannotx xcannot",
]


def normalize(t):
    return re.sub(r"\s+", " ", re.sub("[^a-zA-Z.]", " ", (t or "").lower()))


def words(t):
    for pair in tx.SPLIT_WORDS:
        head, tail = pair.split()
        t = re.sub(rf"\b({head})({tail})\b", r"\1 \2", t)
    t = re.sub(r"(\.+)(\s|$)", r" \1 \2", t)
    return [w for w in t.split(" ") if w]


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, t string")


def column(spark, values, expr):
    return [r[0] for r in rows(spark, values).orderBy("id").select(expr).collect()]


def test_normalize(spark):
    assert column(spark, SAMPLES, tx.normalize(F.col("t"))) == [normalize(t) for t in SAMPLES]


def test_words_and_clean(spark):
    expected = [words(normalize(t)) for t in SAMPLES]
    assert column(spark, SAMPLES, tx.word_tokens(tx.normalize(F.col("t")))) == expected
    cleaned = [" ".join(w for w in ws if w not in tx.STOP_WORDS) for ws in expected]
    assert column(spark, SAMPLES, tx.clean(F.col("t"))) == cleaned


def test_periods_stay_tokens_only_at_word_end(spark):
    got = column(spark, ["a. . b.. c.d e."], tx.word_tokens(F.col("t")))
    assert got == [["a", ".", ".", "b", "..", "c.d", "e", "."]]


def test_stop_list_has_no_apostrophes_or_duplicates():
    assert len(tx.STOP_WORDS) == len(set(tx.STOP_WORDS)) == 153
    assert all(re.fullmatch("[a-z]+", w) for w in tx.STOP_WORDS)


def test_sentences(spark):
    got = column(spark, ["one two. three. four.five", " lead. ", "", "x. . y"], tx.sentences(F.col("t")))
    assert got == [["one two.", "three.", "four.five"], ["lead."], [], ["x.", ".", "y"]]


def test_sentence_words(spark):
    assert column(spark, ["The cat. A dog cannot run."], tx.sentence_words(F.col("t"))) == [[["cat"], ["dog", "run"]]]


def test_append_semtypes(spark):
    df = spark.createDataFrame(
        [("a b", "T1"), ("a b ", "T1"), ("", "T1"), (None, "T1"), ("a", None), ("a", "")], "t string, s string"
    )
    got = [r[0] for r in df.select(tx.append_semtypes(F.col("t"), F.col("s"))).collect()]
    assert got == ["a b T1", "a b T1", "T1", "T1", "a", "a"]


def test_spaced_string(spark):
    df = spark.createDataFrame([(["x", "y"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(tx.spaced_string(F.col("a"))).collect()] == ["x y ", ""]


def test_space_tokens_keep_empty_tokens_and_case(spark):
    assert column(spark, ["A  b ", ""], tx.space_tokens(F.col("t"))) == [["A", "", "b", ""], [""]]


def test_term_counts_match_a_counter(spark):
    rng = random.Random(3)
    values = [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    got = column(spark, values, tx.term_counts(tx.space_tokens(F.col("t"))))
    assert [{r["term"]: r["tf"] for r in g} for g in got] == [dict(Counter(v.split(" "))) for v in values]


def test_term_counts_of_no_tokens(spark):
    df = spark.createDataFrame([([],)], "a array<string>")
    assert df.select(F.inline(tx.term_counts(F.col("a")))).count() == 0


def test_term_positions_match_plain_lists(spark):
    rng = random.Random(4)
    values = [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = column(spark, values, tx.term_positions(tx.space_tokens(F.col("t"))))
    for value, runs in zip(values, got):
        words = value.split(" ")
        assert {r["term"]: r["places"] for r in runs} == {w: [k for k, v in enumerate(words) if v == w] for w in words}
    empty = spark.createDataFrame([([],), (None,)], "a array<string>")
    assert [r[0] for r in empty.select(tx.term_positions(F.col("a"))).collect()] == [None, None]


def test_letters_are_lower_cased_before_one_range_is_kept(spark):
    """One range of letters is all that lower-cased text needs; two take several times as long."""
    rows = ["ABCİd Kelvin Été. A-Zß\n\t..", "\U0001f600x", " ", "", None]
    got = [r["n"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(tx.normalize(F.col("t")).alias("n")).collect()]
    assert got == [re.sub("[^a-zA-Z.]+", " ", (r or "").lower()) for r in rows]
    assert "A-Z" not in tx.NON_LETTERS
