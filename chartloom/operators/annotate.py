"""Approximate dictionary annotation of notes as a set-similarity join.

Every run of up to five words of a note is compared with every dictionary term by the
overlap of their character trigrams. Candidates come from a prefix filter: trigrams get one
global order (absent from the dictionary first, then rare to frequent), and two sets that
reach the threshold must share a trigram among the first few of each. The filter is exact for
all four measures, so no candidate is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chartloom.functions import similarity as sim
from chartloom.functions.text import (
    bind,
    drop_periods,
    normalize,
    remove_stop_words,
    sentences,
    spaced_string,
    word_tokens,
)
from chartloom.operators.span_filter import KeyBounds, key_bounds, span_filter
from chartloom.operators.skew import HOT_ROWS, grid_join, skewed_join
from chartloom.session import cut_lineage

GRANULARITIES = ("N", "S", "W")
ATTRIBUTES = ("term", "cui", "semtypes", "all")
MAX_WORDS = 5
TRIGRAM = 3
BLOCK_WORDS = 256
INDEX_BYTES_TO_BROADCAST = 64 << 20

# A normalized text has 28 symbols. Moving blank and period next to the letters makes the code
# of a symbol its distance from the character before "a", and a trigram 15 bits.
_BITS = 5
_CODES = 1 << (TRIGRAM * _BITS)
_FOREIGN = "[^a-z. ]"


def _symbol_codes(text: Column) -> Column:
    return F.transform(F.split(F.translate(text, " .", "`{"), ""), lambda ch: F.ascii(ch) - 96)


def _trigram_codes(codes: Column) -> Column:
    """Packed trigrams at every position of an array of symbol codes."""
    n = F.size(codes) - (TRIGRAM - 1)
    return F.when(
        n > 0,
        F.transform(
            F.slice(codes, F.lit(1), F.greatest(n, F.lit(0))),
            lambda c, i: F.shiftleft(c, 2 * _BITS) + F.shiftleft(F.get(codes, i + 1), _BITS) + F.get(codes, i + 2),
        ),
    ).otherwise(F.array().cast("array<int>"))


# --- dictionary side -------------------------------------------------------------------------


def dictionary_terms(dictionary: DataFrame) -> DataFrame:
    """``(term, size, foreign, codes)`` per distinct term.

    ``size`` counts all distinct trigrams. Those with a symbol a normalized text cannot hold
    never match anything: they are only counted (``foreign``).
    """
    terms = dictionary.select(F.lower("term").alias("term")).distinct()
    grams = F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length("term") - 2), lambda i: F.substring("term", i, TRIGRAM))
    )
    own = F.filter(F.col("grams"), lambda g: ~F.rlike(g, F.lit(_FOREIGN)))
    return (
        terms.filter(F.length("term") >= TRIGRAM)
        .withColumn("grams", grams)
        .withColumn("own", own)
        .select(
            "term",
            F.size("grams").alias("size"),
            (F.size("grams") - F.size("own")).alias("foreign"),
            F.transform("own", lambda g: F.get(_trigram_codes(_symbol_codes(g)), F.lit(0))).alias("codes"),
        )
    )


def trigram_order(terms: DataFrame) -> list[int]:
    """For each of the 32,768 trigram codes its place in the global order.

    Codes in the dictionary get 1, 2, ... from rare to frequent; the others get distinct
    negative numbers, so they come first in a sorted set and can be told apart. The driver
    sees one count per code, a number fixed by the alphabet.
    """
    counts = terms.select(F.explode("codes").alias("code")).groupBy("code").count()
    place = [-code - 1 for code in range(_CODES)]
    for rank, row in enumerate(sorted(counts.collect(), key=lambda r: (r["count"], r["code"])), start=1):
        place[row["code"]] = rank
    return place


def _lookup(order: Sequence[int]) -> Column:
    """The order as one array literal (folded when the plan is optimized)."""
    return F.split(F.lit(",".join(map(str, order))), ",").cast("array<int>")


def dictionary_index(terms: DataFrame, order: Sequence[int], kind: str, threshold: float) -> DataFrame:
    """``(key, rest, term, size, term_places)``: one row per prefix trigram of each term.

    ``rest`` counts the key and the term's trigrams after it in the order.
    """
    places = _lookup(order)
    ranked = terms.select(
        "term",
        "size",
        "foreign",
        F.sort_array(F.transform("codes", lambda c: F.get(places, c))).alias("term_places"),
    )
    # foreign trigrams come first in the order and take up places of the prefix
    length = F.greatest(sim.prefix_length(kind, threshold, F.col("size")) - F.col("foreign"), F.lit(0))
    return ranked.select(
        F.posexplode(F.slice("term_places", F.lit(1), length)).alias("at", "key"), "term", "size", "term_places"
    ).select("key", (F.size("term_places") - F.col("at")).alias("rest"), "term", "size", "term_places")


@dataclass
class StoredDictionary:
    """A dictionary prepared for one measure and threshold; its tables lie in the shared folder.

    ``concepts`` holds ``(term, cui, semtypes)``, ``index`` the prefix index with the size class of each term, ``order`` the global order of
    trigrams, ``bounds`` what each place of it allows. ``index_bytes`` is the size of the larger table.
    """

    kind: str
    threshold: float
    concepts: DataFrame
    index: DataFrame
    order: list[int]
    bounds: KeyBounds
    index_bytes: int


def store_dictionary(dictionary: DataFrame, kind: str = "jaccard", threshold: float = 0.7) -> StoredDictionary:
    """Derive the dictionary's tables once, for any number of notes tables.

    The driver sees one count per trigram of the alphabet and one row per (trigram, size of terms), sizes above the filter's limit put together.
    """
    sim.check_measure(kind, threshold)
    concepts = cut_lineage(dictionary.select(F.lower("term").alias("term"), "cui", F.sort_array("semtypes").alias("semtypes")))
    terms = dictionary_terms(concepts)
    order = trigram_order(terms)
    index = cut_lineage(dictionary_index(terms, order, kind, threshold).withColumn("size_class", sim.size_class(kind, threshold, F.col("size"))))
    row_bytes = F.octet_length("term") + 4 * F.size("term_places") + 64
    found = index.groupBy("key", "size").agg(F.max("rest").alias("rest"), F.sum(row_bytes).alias("bytes")).toArrow()
    concept_bytes = F.octet_length("term") + F.octet_length("cui") + 16 * F.size("semtypes") + 64
    total = concepts.agg(F.sum(concept_bytes)).first()[0] or 0
    bounds = key_bounds(kind, threshold, *(found[c].to_pylist() for c in ("key", "size", "rest")))
    return StoredDictionary(kind, threshold, concepts, index, order, bounds, max(sum(found["bytes"].to_pylist()), total))


# --- note side -------------------------------------------------------------------------------


def note_units(notes: DataFrame, note_key: Sequence[str], text: str, granularity: str) -> DataFrame:
    """``(*note_key, unit, words)``: the word lists inside which spans are formed.

    N: the whole note; S: each sentence; W: each single word of a sentence, without periods
    and stop words.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, got {granularity!r}")
    clean = normalize(F.col(text))
    if granularity == "N":
        return notes.select(*note_key, F.lit(0).alias("unit"), word_tokens(clean).alias("words"))
    parts = notes.select(*note_key, F.posexplode(sentences(clean)).alias("unit", "sentence"))
    if granularity == "S":
        return parts.select(*note_key, "unit", word_tokens(F.col("sentence")).alias("words"))
    return parts.select(*note_key, "unit", remove_stop_words(word_tokens(drop_periods(F.col("sentence")))).alias("words"))


def distinct_words(notes: DataFrame, text: str = "text") -> DataFrame:
    """``(word)``: each word of granularity W once, dealt evenly.

    Such a word is its own only unit, so that for pairs of words and terms ``match_spans`` may take these rows as notes: the work follows the vocabulary, not the text.
    """
    words = note_units(notes, [], text, "W").select(F.explode("words").alias("word")).distinct()
    return words.repartition(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks(units: DataFrame, note_key: Sequence[str], max_words: int = MAX_WORDS) -> DataFrame:
    """``(*note_key, unit, first, block)``: overlapping runs of words, small whatever the note's size."""

    def cut(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 1, F.lit(BLOCK_WORDS)),
            lambda first: F.struct(
                first.alias("first"),
                F.array_join(F.slice(words, first + 1, BLOCK_WORDS + max_words - 1), " ").alias("block"),
            ),
        )

    pieces = bind(F.col("words"), lambda words: F.when(F.size(words) > 0, cut(words)))
    return units.select(*note_key, "unit", F.inline(pieces))


def spans(
    units: DataFrame,
    note_key: Sequence[str],
    stored: StoredDictionary,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(*note_key, unit, word_pos, n_words, span, places, keys)`` for every span that could match.

    A span is a run of 1..max_words words that starts and ends with a letter.
    """
    rows = blocks(units, note_key, max_words)
    share = sim.required_share(stored.kind, stored.threshold)
    min_grams = max(1, math.ceil(int(stored.bounds.low.min(initial=1 << 30)) * share - 1e-9))
    kept = span_filter(stored.order, stored.bounds, share, min_grams, max_words, BLOCK_WORDS, len(note_key) + 1)
    schema = T.StructType(
        [
            *(rows.schema[c] for c in (*note_key, "unit")),
            T.StructField("word_pos", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
            T.StructField("span", T.StringType()),
            T.StructField("places", T.ArrayType(T.IntegerType(), False)),
            T.StructField("keys", T.ArrayType(T.IntegerType(), False)),
        ]
    )
    return rows.mapInArrow(kept, schema)


# --- join ------------------------------------------------------------------------------------


def _similar_terms(rows: DataFrame, stored: StoredDictionary, broadcast: bool, cells: int | None = None) -> DataFrame:
    """Rows with each similar term once: a pair counts at its first common trigram only.

    Without ``broadcast`` rows and index meet on (trigram, size class): a row goes to the classes of the sizes it can match, and pairs of
    a trigram and class that both sides hold often are cut into a grid on both sides.
    """
    kind, threshold = stored.kind, stored.threshold
    columns = [c for c in rows.columns if c not in ("places", "keys")]
    own = F.size("places")
    keyed = rows.select(*columns, "places", own.alias("_own"), F.explode("keys").alias("key")).withColumn(
        "_rest", F.col("_own") - F.array_position("places", F.col("key")) + 1
    )
    if broadcast:
        met = keyed.join(F.broadcast(stored.index), "key")
    else:
        low, high = sim.class_range(kind, threshold, F.col("_own"))
        classes = stored.index.select("key", "size_class").distinct()
        largest = F.greatest(F.coalesce(F.lit(stored.index.agg(F.max("size_class")).first()[0]), F.lit(0)), low)
        keyed = keyed.withColumn("size_class", F.explode(F.sequence(low, F.least(high, largest))))
        met = grid_join(
            keyed.join(F.broadcast(classes), ["key", "size_class"], "left_semi"), stored.index, ["key", "size_class"],
            left_spread=["span"], right_spread=["term"], cells=cells,
        )
    common = F.array_intersect("places", "term_places")
    value = sim.similarity(kind, F.size(common), F.col("_own"), F.col("size"))
    # at the first common trigram, nothing before it on either side can be shared
    reach = sim.similarity(kind, F.least("_rest", "rest"), F.col("_own"), F.col("size"))
    # one conjunction, cheapest first: sets are intersected only where the bound allows a match
    pairs = met.filter((reach >= threshold) & (value >= threshold) & (F.col("key") == F.array_min(common)))
    return pairs.select(*columns, "term", value.alias("similarity"))


def match_spans(
    notes: DataFrame,
    note_key: Sequence[str],
    dictionary: DataFrame | StoredDictionary,
    text: str = "text",
    granularity: str = "N",
    threshold: float = 0.7,
    kind: str = "jaccard",
    index_bytes_to_broadcast: int = INDEX_BYTES_TO_BROADCAST,
    hot_rows: int = HOT_ROWS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``(*note_key, unit, word_pos, n_words, span, term, cui, semtypes, similarity)``.

    All concepts of every span at or above the threshold; overlapping spans are all kept.
    Spans have up to ``max_words`` words. A match has three characters at least, so shorter
    terms never match (``dictionary_terms`` leaves them out).
    ``dictionary`` is a table, prepared here once, or one stored before, whose measure and threshold then hold.
    An index of checked size is broadcast, and spans never leave their task. Beyond
    that size the distinct spans are matched in a shuffled join instead, with frequent trigrams cut on both sides, and their matches
    are joined back with frequent spans cut into parts.
    """
    stored = dictionary if isinstance(dictionary, StoredDictionary) else store_dictionary(dictionary, kind, threshold)
    units = note_units(notes, note_key, text, granularity)
    found = spans(units, note_key, stored, 1 if granularity == "W" else max_words)
    columns = [*note_key, "unit", "word_pos", "n_words", "span", "term", "cui", "semtypes", "similarity"]
    if stored.index_bytes <= index_bytes_to_broadcast:
        return _similar_terms(found, stored, broadcast=True).join(F.broadcast(stored.concepts), "term").select(*columns)
    distinct = cut_lineage(found.groupBy("span").agg(F.first("places").alias("places"), F.first("keys").alias("keys")))
    similar = _similar_terms(distinct, stored, broadcast=False).join(stored.concepts, "term")
    return skewed_join(
        found.drop("places", "keys"), similar, ["span"], spread_by=[*note_key, "unit", "word_pos"], hot_rows=hot_rows
    ).select(*columns)


def best_concepts(matches: DataFrame, note_key: Sequence[str]) -> DataFrame:
    """The most similar concept of each span; the smaller cui, then term, wins a tie."""
    span_key = [*note_key, "unit", "word_pos", "n_words", "span"]
    best = F.min_by(
        F.struct("term", "cui", "semtypes", "similarity"), F.struct(-F.col("similarity"), "cui", "term")
    )
    return matches.groupBy(*span_key).agg(best.alias("_b")).select(*span_key, "_b.*")


def drop_excluded(matches: DataFrame, excluded: Sequence[str] | DataFrame) -> DataFrame:
    """Drop matches whose semantic types are all excluded (having none counts as all).

    ``excluded`` is a list or a one-column table; either way a handful of type ids.
    """
    if isinstance(excluded, DataFrame):
        types = excluded.agg(F.collect_set(excluded.columns[0])).scalar()
    else:
        types = F.array(*(F.lit(t) for t in excluded)).cast("array<string>")
    return matches.filter(F.size(F.array_except("semtypes", types)) > 0)


def concept_arrays(notes: DataFrame, matches: DataFrame, note_key: Sequence[str]) -> DataFrame:
    """Per note the matched terms, cuis, semantic types and similarities in span order.

    Only the key columns of the notes take part; notes without a match get empty arrays.
    """
    item = F.struct("unit", "word_pos", "n_words", "term", "cui", "semtypes", "similarity")
    listed = matches.groupBy(*note_key).agg(F.sort_array(F.collect_list(item)).alias("_m"))
    m = F.coalesce("_m", F.array().cast(listed.schema["_m"].dataType))
    return notes.select(*note_key).join(listed, list(note_key), "left").select(
        *note_key,
        m.getField("term").alias("terms"),
        m.getField("cui").alias("cuis"),
        F.flatten(m.getField("semtypes")).alias("semtypes"),
        m.getField("similarity").alias("sim_score"),
    )


def concept_strings(arrays: DataFrame, note_key: Sequence[str]) -> DataFrame:
    """The corpus variants: every term, cui or type followed by one blank."""
    return arrays.select(
        *note_key,
        spaced_string(F.col("terms")).alias("term"),
        spaced_string(F.col("cuis")).alias("cui"),
        spaced_string(F.col("semtypes")).alias("semtypes"),
        "sim_score",
    )


def annotate(
    notes: DataFrame,
    note_key: Sequence[str],
    dictionary: DataFrame | StoredDictionary,
    text: str = "text",
    granularity: str = "N",
    threshold: float = 0.7,
    kind: str = "jaccard",
    attribute: str = "all",
    keep_similarity: bool = False,
    excluded: Sequence[str] | DataFrame | None = None,
    **join_options: int,
) -> DataFrame:
    """Note keys with the annotation strings asked for; ``excluded`` needs ``attribute='all'``."""
    if attribute not in ATTRIBUTES:
        raise ValueError(f"attribute must be one of {ATTRIBUTES}, got {attribute!r}")
    if excluded is not None and attribute != "all":
        raise ValueError("excluded semantic types need attribute='all'")
    matches = match_spans(notes, note_key, dictionary, text, granularity, threshold, kind, **join_options)
    best = best_concepts(matches, note_key)
    if excluded is not None:
        best = drop_excluded(best, excluded)
    strings = concept_strings(concept_arrays(notes, best, note_key), note_key)
    wanted = ["term", "cui", "semtypes"] if attribute == "all" else [attribute]
    return strings.select(*note_key, *wanted, *(["sim_score"] if keep_similarity else []))
