"""Text normalization, tokenizing and string assembly as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# English stop words (those with apostrophes cannot occur in normalized text).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some
such no nor not only own same so than too very s t can will just don should now d ll m o re
ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
weren won wouldn
""".split()

# Words a treebank-style tokenizer cuts in two, as "head tail".
SPLIT_WORDS = ("can not", "gim me", "gon na", "got ta", "lem me", "wan na")

NON_LETTERS = "[^a-z.]+"  # of a lower-cased text; a class of two ranges takes several times as long
WORD_FINAL_PERIODS = r"(\.+)(\s|$)"


def fill_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Lower-case, turn everything but letters and periods into blanks, collapse blanks.

    Blanks are non-letters themselves, so one pass over runs does both replacements.
    """
    return F.regexp_replace(F.lower(fill_null(c)), NON_LETTERS, " ")


def drop_periods(c: Column) -> Column:
    return F.translate(c, ".", "")


def word_tokens(normalized: Column) -> Column:
    """Words of a normalized text; a run of periods ending a word is a token of its own."""
    heads = "|".join(rf"{head}(?={tail}\b)" for head, tail in (w.split() for w in SPLIT_WORDS))
    text = F.regexp_replace(normalized, rf"\b({heads})", "$1 ")
    text = F.regexp_replace(text, WORD_FINAL_PERIODS, " $1 $2")
    return F.filter(F.split(text, " "), lambda w: w != "")


def space_tokens(c: Column) -> Column:
    """Split on every single blank; empty tokens and letter case are kept."""
    return F.split(c, " ")


def sentences(normalized: Column) -> Column:
    """Sentences of a normalized text: a period followed by a blank ends one."""
    parts = F.split(F.replace(normalized, F.lit(". "), F.lit(".\n")), "\n")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def remove_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    stop = list(stop_words)
    return F.filter(tokens, lambda w: ~w.isin(stop))


def clean(c: Column) -> Column:
    """Normalized words without stop words, joined by one blank."""
    return F.array_join(remove_stop_words(word_tokens(normalize(c))), " ")


def sentence_words(c: Column) -> Column:
    """Word granularity: per sentence, period-free words without stop words."""
    return F.transform(
        sentences(normalize(c)),
        lambda s: remove_stop_words(word_tokens(drop_periods(s))),
    )


def append_semtypes(c: Column, semtypes: Column) -> Column:
    """Text followed by its semantic types, with exactly one blank between the two."""
    text, types = fill_null(c), fill_null(semtypes)
    glue = F.when((text == "") | (types == "") | F.endswith(text, F.lit(" ")), "").otherwise(" ")
    return F.concat(text, glue, types)


def spaced_string(items: Column) -> Column:
    """Every element followed by one blank; an empty array gives an empty string."""
    return F.when(F.size(items) > 0, F.concat(F.array_join(items, " "), F.lit(" "))).otherwise("")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, lambdas included.

    A plain reference inside a lambda would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one token array, without leaving the row.

    Sorting brings equal tokens together, so a run's length is its count: linear after the
    sort, no shuffle and no per-note key needed.
    """

    def run_starts(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

    def runs(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda start, k: F.struct(
                F.get(ordered, start).alias("term"),
                (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - start).cast("bigint").alias("tf"),
            ),
        )

    return bind(
        F.sort_array(tokens),
        lambda ordered: F.when(
            F.size(ordered) > 0, bind(run_starts(ordered), lambda starts: runs(ordered, starts))
        ),
    )


def runs(values: Column, starts_run: Callable[[Column, Column], Column], make: Callable[[Column], Column]) -> Column:
    """``make`` applied to every maximal run of an array, in one pass; null for an empty or null array.

    ``starts_run(element, element before)`` says where a new run begins.
    """

    def starts(items: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | starts_run(F.get(items, i), F.get(items, i - 1))
        )

    def slices(items: Column, at: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(at, k + 1), F.size(items))
        return F.transform(at, lambda start, k: make(F.slice(items, start + 1, stop(k) - start)))

    return bind(values, lambda items: F.when(F.size(items) > 0, bind(starts(items), lambda at: slices(items, at))))


def term_positions(tokens: Column) -> Column:
    """``array<struct<term, places>>`` of one token array: the 0-based positions of each distinct token, ascending."""
    placed = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    return runs(
        placed,
        lambda here, before: here["term"] != before["term"],
        lambda run: F.struct(F.get(run, F.lit(0))["term"].alias("term"), F.transform(run, lambda x: x["pos"]).alias("places")),
    )
