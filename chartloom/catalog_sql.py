"""Plain SQL with the same meaning as the catalog queries, for cross-checking."""

from __future__ import annotations

from chartloom.functions.text import SPLIT_WORDS, STOP_WORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _normalize(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-zA-Z.]', ' ', 'g'), '\\s+', ' ', 'g')"


def _words(c: str) -> str:
    for pair in SPLIT_WORDS:
        head, tail = pair.split()
        c = rf"regexp_replace({c}, '\b({head})({tail})\b', '\1 \2', 'g')"
    c = rf"regexp_replace({c}, '(\.+)(\s|$)', ' \1 \2', 'g')"
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _no_stop(words: str) -> str:
    return f"list_filter({words}, lambda w: NOT list_contains({_STOP}, w))"


def _sentences(c: str) -> str:
    return (
        f"list_filter(list_transform(string_split(replace({c}, '. ', '.' || chr(10)), chr(10)), "
        "lambda s: trim(s)), lambda s: s <> '')"
    )


def _clean(c: str) -> str:
    return f"array_to_string({_no_stop(_words(_normalize(c)))}, ' ')"


_LABELS = """
adm AS (
  SELECT o_custkey, o_orderdate AS t, lead(o_orderdate) OVER w AS p, row_number() OVER w AS nth,
         count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC)
),
lab AS (
  SELECT o_custkey AS subject_id,
         CASE WHEN n > 1 AND epoch_us(t) - epoch_us(p) > 0 AND epoch_us(t) - epoch_us(p) < 15552000000000
              THEN 1 ELSE 0 END AS readm
  FROM adm
  WHERE nth = 1 AND (n = 1 OR t IS NULL OR p IS NULL OR epoch_us(t) - epoch_us(p) > 0)
)"""

_NOTES = "notes AS (SELECT conv_id AS subject_id, turn AS hadm_id, text, role FROM conversations)"


def _holdout(labels: str, seed: int = 18520, frac: float = 0.2) -> str:
    return f"""
size AS (
  SELECT count(*) AS n, floor({frac}::DOUBLE * count(*)) AS h,
         floor(sum(readm)::DOUBLE / count(*) * floor({frac}::DOUBLE * count(*))) AS h1 FROM {labels}
),
chosen AS (
  SELECT subject_id, readm FROM (
    SELECT *, row_number() OVER (PARTITION BY readm ORDER BY md5('{seed}-' || subject_id), subject_id) AS r FROM {labels}
  ), size WHERE r <= CASE WHEN readm = 1 THEN h1 ELSE h - h1 END
)"""


_NOTE_HOLDOUT = f"""{_LABELS}, {_NOTES},
nlab AS (SELECT * FROM lab WHERE subject_id IN (SELECT subject_id FROM notes)),
{_holdout('nlab')}"""


def _tfidf(source: str, key: str) -> str:
    """CTEs from ``source`` (key columns, text) to ``unit`` (key, term, weight)."""
    return f"""
tok AS (SELECT {key}, unnest(string_split(coalesce(text, ''), ' ')) AS term FROM {source}),
tf AS (SELECT {key}, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idfs AS (SELECT term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM {source})) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM dfs),
raw AS (SELECT {key}, term, tf * idf AS w FROM tf JOIN idfs USING (term)),
unit AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM raw)"""


_VOCAB_TOKENS = f"""{_NOTES},
words AS (SELECT subject_id, hadm_id, unnest({_words(_normalize('text'))}) AS term FROM notes),
vecs AS (
  SELECT term, embedding FROM (
    SELECT term, row_number() OVER (ORDER BY md5('0-' || term), term) - 1 AS id FROM (SELECT DISTINCT term FROM words)
  ) JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings) WHERE id % 32 <> 0
),
parts AS (
  SELECT subject_id, hadm_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM words JOIN vecs USING (term)
),
pooled AS (
  SELECT subject_id, hadm_id, pos, avg(v) AS a, max(v) AS b, min(v) AS c FROM parts GROUP BY ALL
),
grid AS (SELECT subject_id, hadm_id, unnest(range(192)) AS pos FROM notes),
vec AS (
  SELECT g.subject_id, g.hadm_id, g.pos,
         coalesce(CASE g.pos // 64 WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 0.0) AS value
  FROM grid g LEFT JOIN pooled p ON g.subject_id = p.subject_id AND g.hadm_id = p.hadm_id AND g.pos % 64 = p.pos
)"""

_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda k: substr({0}, k, 3)))"

_MEASURE = {
    "jaccard": "i::DOUBLE / (a + b - i)",
    "dice": "2.0::DOUBLE * i / (a + b)",
    "cosine": "i::DOUBLE / sqrt((a * b)::DOUBLE)",
    "overlap": "i::DOUBLE / least(a, b)",
}


def _dictionary(first: int, n_words: int) -> str:
    words = _words(f"replace({_normalize('text')}, '.', '')")
    return f"""
dict AS (
  SELECT term, 'C' || lpad(min(item_id)::VARCHAR, 5, '0') AS cui, 'T' || (min(item_id) % 5) AS semtypes
  FROM (SELECT item_id, array_to_string(({words})[{first}:{first + n_words - 1}], ' ') AS term FROM benchmark)
  GROUP BY term
)"""


def _matches(
    source: str = "SELECT doc_id, text FROM documents",
    key: str = "doc_id",
    granularity: str = "N",
    first: int = 11,
    n_words: int = 2,
    kind: str = "jaccard",
    threshold: float = 0.7,
) -> str:
    """CTEs up to ``matches`` (all) and ``best`` (one per span)."""
    clean = _normalize("text")
    if granularity == "N":
        units = f"SELECT {key}, 0 AS unit, {_words(clean)} AS words FROM src"
    else:
        body = _words("s") if granularity == "S" else _no_stop(_words("replace(s, '.', '')"))
        units = f"""SELECT {key}, unit, {body} AS words FROM (
            SELECT {key}, unnest(range(len(ss))) AS unit, unnest(ss) AS s FROM (SELECT {key}, {_sentences(clean)} AS ss FROM src))"""
    longest = 1 if granularity == "W" else 5
    return f"""
src AS ({source}), {_dictionary(first, n_words)},
units AS ({units}),
heads AS (SELECT {key}, unit, words, unnest(range(len(words))) AS word_pos FROM units),
spans AS (
  SELECT {key}, unit, word_pos, n AS n_words, array_to_string(words[word_pos + 1:word_pos + n], ' ') AS span
  FROM heads, range(1, {longest + 1}) r(n) WHERE word_pos + n <= len(words)
),
texts AS (
  SELECT DISTINCT span FROM spans WHERE regexp_full_match(span, '[a-z](.*[a-z])?') AND length(span) >= 3
),
sg AS (SELECT span, len(g) AS a, unnest(g) AS gram FROM (SELECT span, {_GRAMS.format('span')} AS g FROM texts)),
dg AS (SELECT term, len(g) AS b, unnest(g) AS gram FROM (
  SELECT term, {_GRAMS.format('term')} AS g FROM (SELECT DISTINCT term FROM dict WHERE length(term) >= 3))),
pairs AS (SELECT span, term, any_value(a) AS a, any_value(b) AS b, count(*) AS i FROM sg JOIN dg USING (gram) GROUP BY span, term),
hits AS (SELECT span, term, i, a, b, {_MEASURE[kind]} AS similarity FROM pairs WHERE {_MEASURE[kind]} >= {threshold}::DOUBLE),
matches AS (SELECT {key}, unit, word_pos, n_words, span, term, cui, semtypes, similarity
            FROM spans JOIN hits USING (span) JOIN dict USING (term)),
best AS (SELECT * FROM matches QUALIFY row_number() OVER (
  PARTITION BY {key}, unit, word_pos, n_words ORDER BY similarity DESC, cui, term) = 1)"""


_BEST_COLUMNS = "doc_id, unit::INTEGER AS unit, word_pos::INTEGER AS word_pos, n_words::INTEGER AS n_words, span, term, cui, semtypes, round(similarity, 6) AS similarity"


def _strings(source: str) -> str:
    order = "ORDER BY unit, word_pos, n_words"
    return f"""
lists AS (
  SELECT doc_id, string_agg(term || ' ', '' {order}) AS term, string_agg(cui || ' ', '' {order}) AS cui,
         string_agg(semtypes || ' ', '' {order}) AS semtypes,
         string_agg(printf('%.4f', similarity), ' ' {order}) AS sim_score
  FROM {source} GROUP BY doc_id
),
strings AS (
  SELECT d.doc_id, coalesce(term, '') AS term, coalesce(cui, '') AS cui, coalesce(semtypes, '') AS semtypes,
         coalesce(sim_score, '') AS sim_score
  FROM documents d LEFT JOIN lists USING (doc_id)
)"""


def _append(text: str, types: str) -> str:
    text, types = f"coalesce({text}, '')", f"coalesce({types}, '')"
    return f"{text} || CASE WHEN {text} = '' OR {types} = '' OR {text} LIKE '% ' THEN '' ELSE ' ' END || {types}"


_LOGITS = """
seqs AS (
  SELECT user_id AS subject_id, event_id AS seq_idx, 0.0::DOUBLE AS l0, (value - 10.0::DOUBLE) / 10.0::DOUBLE AS l1,
         (event_type = 'purchase')::INTEGER AS label FROM events
),
pool AS (
  SELECT subject_id, count(*) AS n_sequences, arg_min(label, seq_idx) AS label,
         (max(l0) + avg(l0) * (count(*) / 2.0::DOUBLE)) / (1 + count(*) / 2.0::DOUBLE) AS l0,
         (max(l1) + avg(l1) * (count(*) / 2.0::DOUBLE)) / (1 + count(*) / 2.0::DOUBLE) AS l1
  FROM seqs GROUP BY subject_id
)"""

_LOSS = "greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) - CASE WHEN label = 1 THEN l1 ELSE l0 END"


def _rates(source: str) -> str:
    """``rates`` columns of a (label, prediction) relation."""
    return f"""
SELECT n, hits / n AS accuracy, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1
FROM (SELECT n, hits, CASE WHEN fl > 0 THEN tp / fl ELSE 0.0 END AS p, CASE WHEN po > 0 THEN tp / po ELSE 0.0 END AS r FROM (
  SELECT count(*) AS n, count(*) FILTER (label = prediction)::DOUBLE AS hits,
         count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (prediction = 1) AS fl,
         count(*) FILTER (label = 1) AS po FROM {source}))"""


def _auroc(source: str) -> str:
    return f"""
SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {source} GROUP BY score))"""


def _report(source: str, loss: str, extra: str = "") -> str:
    view = f"(SELECT label, (l1 > l0)::INTEGER AS prediction, l1 - l0 AS score FROM {source})"
    return f"""SELECT n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, round(auroc, 6) AS auroc, round(loss, 6) AS loss{extra}
    FROM ({_rates(view)}), ({_auroc(view)}), (SELECT avg({_LOSS}) AS loss FROM {loss})"""


_SCORES = """
scores AS (SELECT quality AS label, ln(n_chars::DOUBLE) AS score, (n_chars > 600)::INTEGER AS prediction
           FROM documents JOIN labels USING (doc_id))"""

_ROUNDED_RATES = (
    "n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
)

_VOCAB = f"""
cleaned AS (SELECT subject_id, hadm_id, {_clean('text')} AS text FROM notes),
toks AS (SELECT subject_id, hadm_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM cleaned),
vocab AS (
  SELECT term, n AS "count", (102 + row_number() OVER (ORDER BY md5('0-' || term), term))::INTEGER AS token_id
  FROM (SELECT term, count(*) AS n FROM (SELECT unnest(words) AS term FROM toks) GROUP BY term HAVING count(*) >= 2)
)"""

_SEQ = 64

SQL: dict[str, str] = {
    "scan_notes": "SELECT conv_id AS subject_id, turn AS hadm_id, coalesce(text, '') AS text FROM conversations",
    "scan_admissions": "SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, epoch_us(o_orderdate) AS admit_us FROM orders",
    "skip_ranges": """SELECT doc_id, source, n_chars FROM documents
        WHERE NOT (doc_id >= 10 AND doc_id < 60) AND NOT (doc_id >= 200 AND doc_id < 450)""",
    "preview_limit": """SELECT conv_id AS subject_id, turn AS hadm_id, text FROM conversations
        ORDER BY conv_id, turn LIMIT 128""",
    "normalize_text": f"SELECT doc_id, {_normalize('text')} AS text FROM documents",
    "tokenize_words": f"""SELECT doc_id, len(w)::BIGINT AS n_words, array_to_string(w, '|') AS words
        FROM (SELECT doc_id, {_words(_normalize('text'))} AS w FROM documents)""",
    "tokenize_sentences": f"""SELECT doc_id, unnest(range(len(s)))::INTEGER AS sentence_no, unnest(s) AS sentence
        FROM (SELECT doc_id, {_sentences(_normalize('text'))} AS s FROM documents)""",
    "word_granularity": f"""SELECT doc_id, sentence_no, array_to_string({_no_stop(_words("replace(s, '.', '')"))}, ' ') AS words
        FROM (SELECT doc_id, unnest(range(len(ss)))::INTEGER AS sentence_no, unnest(ss) AS s
              FROM (SELECT doc_id, {_sentences(_normalize('text'))} AS ss FROM documents))""",
    "remove_stopwords": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "augment_semtypes": f"""SELECT conv_id AS subject_id, turn AS hadm_id,
        {_append('text', "nullif(role, 'assistant')")} AS text FROM conversations""",
    "readmission_labels": f"WITH {_LABELS} SELECT subject_id, readm FROM lab",
    "admissions_per_patient": "SELECT o_custkey AS subject_id, count(*) AS n_admissions FROM orders GROUP BY o_custkey",
    "readmission_prevalence": f"""WITH {_LABELS} SELECT count(*) AS n_patients, sum(readm)::BIGINT AS n_readmitted,
        round(avg(readm), 6) AS prevalence, round(sum(readm)::DOUBLE / count(*) * 100, 6) AS prevalence_pct FROM lab""",
    "corpus_summary": f"""WITH {_LABELS}, {_NOTES}
        SELECT 'notes' AS source, 'rows' AS measure, count(*) AS value FROM notes
        UNION ALL SELECT 'notes', 'admissions', count(DISTINCT hadm_id) FROM notes
        UNION ALL SELECT 'notes', 'patients', count(DISTINCT subject_id) FROM notes
        UNION ALL SELECT 'labels', 'rows', count(*) FROM lab
        UNION ALL SELECT 'labels', 'patients', count(DISTINCT subject_id) FROM lab""",
    "distinct_patients": "SELECT DISTINCT o_custkey AS subject_id FROM orders",
    "notes_left_labels": f"WITH {_LABELS}, {_NOTES} SELECT subject_id, hadm_id, readm::DOUBLE AS readm FROM notes LEFT JOIN lab USING (subject_id)",
    "labels_with_notes": f"WITH {_LABELS} SELECT * FROM lab WHERE subject_id IN (SELECT conv_id FROM conversations)",
    "label_alignment": f"WITH {_LABELS}, {_NOTES} SELECT subject_id, hadm_id, readm FROM notes JOIN lab USING (subject_id)",
    "patient_label_alignment": f"""WITH {_LABELS}, {_NOTES}
        SELECT subject_id, readm FROM (SELECT DISTINCT subject_id FROM notes) JOIN lab USING (subject_id)""",
    "stratified_holdout": f"WITH {_LABELS}, {_holdout('lab')} SELECT subject_id, readm FROM chosen",
    "holdout_audit": f"""WITH {_LABELS}, {_holdout('lab')}
        SELECT CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'test' ELSE 'train' END AS split, readm,
               count(*) AS n, (SELECT h FROM size)::BIGINT AS holdout_expected FROM lab GROUP BY ALL""",
    "holdout_of_noted_patients": f"WITH {_NOTE_HOLDOUT} SELECT subject_id, readm FROM chosen",
    "audit_of_noted_patients": f"""WITH {_NOTE_HOLDOUT}
        SELECT CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'test' ELSE 'train' END AS split, readm,
               count(*) AS n, (SELECT h FROM size)::BIGINT AS holdout_expected FROM nlab GROUP BY ALL""",
    "split_anti": f"""WITH {_NOTE_HOLDOUT} SELECT subject_id, hadm_id FROM notes
        WHERE subject_id NOT IN (SELECT subject_id FROM chosen)""",
    "split_semi": f"""WITH {_NOTE_HOLDOUT} SELECT subject_id, hadm_id FROM notes
        WHERE subject_id IN (SELECT subject_id FROM chosen)""",
    "union_corpus": f"""WITH {_NOTE_HOLDOUT} SELECT subject_id, hadm_id, text,
        CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'test' ELSE 'train' END AS split FROM notes""",
    "grouped_split": f"""WITH {_NOTES}, ids AS (SELECT DISTINCT subject_id FROM notes),
        val AS (SELECT subject_id FROM (
          SELECT subject_id, row_number() OVER (ORDER BY md5('1-' || subject_id), subject_id) AS r FROM ids)
          WHERE r <= floor(0.2::DOUBLE * (SELECT count(*) FROM ids)))
        SELECT subject_id, hadm_id,
               CASE WHEN subject_id IN (SELECT subject_id FROM val) THEN 'validation' ELSE 'train' END AS split FROM notes""",
    "stratified_folds": f"""WITH {_LABELS} SELECT subject_id, readm,
        ((row_number() OVER (PARTITION BY readm ORDER BY md5('1-' || subject_id), subject_id) - 1) % 5)::INTEGER AS fold FROM lab""",
    "class_weights": f"""WITH {_LABELS}, {_NOTES}, c AS (
          SELECT readm, count(*) AS n FROM notes JOIN lab USING (subject_id) GROUP BY readm)
        SELECT readm, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS class_weight FROM c""",
    "term_frequency": f"WITH {_tfidf('documents', 'doc_id')} SELECT doc_id, term, tf FROM tf",
    "idf": f"WITH {_tfidf('documents', 'doc_id')} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "tfidf": f"WITH {_tfidf('documents', 'doc_id')} SELECT doc_id, term, round(weight, 6) AS weight FROM unit",
    "patient_tfidf": f"""WITH {_LABELS}, cleaned AS (
          SELECT conv_id AS subject_id, turn AS hadm_id, {_clean('text')} AS text FROM conversations),
        {_tfidf('cleaned', 'subject_id, hadm_id')}
        SELECT subject_id, term, round(sum(weight), 6) AS weight, readm
        FROM unit JOIN lab USING (subject_id) GROUP BY subject_id, term, readm""",
    "vector_pool": f"WITH {_VOCAB_TOKENS} SELECT subject_id, hadm_id, pos::INTEGER AS pos, round(value, 6) AS value FROM vec",
    "patient_mean_vector": f"""WITH {_VOCAB_TOKENS}
        SELECT subject_id, pos::INTEGER AS pos, round(avg(value), 6) AS value FROM vec GROUP BY subject_id, pos""",
    "embedding_group_mean": """SELECT subject_id, pos::INTEGER AS pos, round(avg(v), 6) AS value FROM (
          SELECT label AS subject_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
        GROUP BY subject_id, pos""",
    "best_concept": f"WITH {_matches()} SELECT {_BEST_COLUMNS} FROM best",
    "annotate_sentences": f"WITH {_matches(granularity='S')} SELECT {_BEST_COLUMNS} FROM best",
    "annotate_words": f"WITH {_matches(granularity='W', n_words=1)} SELECT {_BEST_COLUMNS} FROM best",
    "filter_semtypes": f"WITH {_matches()} SELECT {_BEST_COLUMNS} FROM best WHERE semtypes NOT IN ('T0', 'T3')",
    "annotate_concepts": f"""WITH {_matches()}, kept AS (SELECT * FROM best WHERE semtypes NOT IN ('T0', 'T3')),
        {_strings('kept')} SELECT * FROM strings""",
    "filter_listed_semtypes": f"WITH {_matches()} SELECT {_BEST_COLUMNS} FROM best WHERE semtypes NOT IN ('T0', 'T3')",
    "annotate_sentence_cuis": f"WITH {_matches(granularity='S')}, {_strings('best')} SELECT doc_id, cui FROM strings",
    "annotate_word_terms": f"WITH {_matches(granularity='W', n_words=1)}, {_strings('best')} SELECT doc_id, term FROM strings",
    "similarity_of_candidates": f"""WITH {_matches(granularity='W', n_words=1)}
        SELECT span, term, {', '.join(f'round({f}, 6) AS {k}' for k, f in _MEASURE.items())} FROM pairs""",
    "csv_notes": "SELECT doc_id AS subject_id, doc_id::VARCHAR AS hadm_id, coalesce(text, '') AS text FROM documents",
    "concept_strings": f"WITH {_matches()}, {_strings('best')} SELECT doc_id, term, cui, semtypes FROM strings",
    "corpus_variants": f"""WITH {_matches()}, {_strings('best')}
        SELECT doc_id, 'text' AS variant, coalesce(text, '') AS text FROM documents
        UNION ALL SELECT doc_id, 'term', term FROM strings
        UNION ALL SELECT doc_id, 'term_st', {_append('term', 'semtypes')} FROM strings
        UNION ALL SELECT doc_id, 'cui', cui FROM strings
        UNION ALL SELECT doc_id, 'cui_st', {_append('cui', 'semtypes')} FROM strings""",
    "similarity_measures": f"""WITH {_matches(n_words=1)}
        SELECT span, term, {', '.join(f'round({f}, 6) AS {k}' for k, f in _MEASURE.items())}
        FROM hits JOIN (SELECT DISTINCT span, term FROM best) USING (span, term)""",
    **{
        f"matches_{kind}": f"""WITH {_matches('SELECT conv_id AS subject_id, turn AS hadm_id, text FROM conversations',
                                   'subject_id, hadm_id', kind=kind, threshold=t)}
        SELECT subject_id, hadm_id, word_pos::INTEGER AS word_pos, n_words::INTEGER AS n_words, span, term, cui, round(similarity, 6) AS similarity FROM matches"""
        for kind, t in (("dice", 0.8), ("cosine", 0.8), ("overlap", 0.9))
    },
    "corpus_vocabulary": f'WITH {_NOTES}, {_VOCAB} SELECT term, "count", token_id FROM vocab',
    "sequence_windows": f"""WITH {_LABELS}, {_NOTES}, {_VOCAB},
        items AS (SELECT subject_id, hadm_id, unnest(range(len(words))) AS pos, unnest(words) AS term FROM toks),
        coded AS (SELECT subject_id, hadm_id, pos, coalesce(token_id, 100) AS id FROM items LEFT JOIN vocab USING (term)),
        blocks AS (
          SELECT subject_id, hadm_id, CASE WHEN pos < {_SEQ - 2} THEN 0 ELSE (pos - {_SEQ - 2}) // {_SEQ} + 1 END AS seq_idx,
                 list(id ORDER BY pos) AS ids FROM coded GROUP BY ALL
          UNION ALL SELECT subject_id, hadm_id, 0, [] FROM toks WHERE len(words) = 0),
        real AS (SELECT subject_id, hadm_id, seq_idx, CASE WHEN seq_idx = 0 THEN [101] || ids || [102] ELSE ids END AS ids FROM blocks)
        SELECT r.subject_id, hadm_id, readm::DOUBLE AS readm, seq_idx::INTEGER AS seq_idx,
               array_to_string(ids || list_transform(range({_SEQ} - len(ids)), lambda x: 0), ' ') AS input_ids,
               array_to_string(list_transform(ids, lambda x: 1) || list_transform(range({_SEQ} - len(ids)), lambda x: 0), ' ') AS attn_mask
        FROM real r LEFT JOIN lab ON r.subject_id = lab.subject_id""",
    "sequence_prepare": f"""WITH {_LABELS}, {_NOTES}, {_VOCAB},
        ids AS (SELECT DISTINCT subject_id FROM notes),
        val AS (SELECT subject_id FROM (
          SELECT subject_id, row_number() OVER (ORDER BY md5('1-' || subject_id), subject_id) AS r FROM ids)
          WHERE r <= floor(0.2::DOUBLE * (SELECT count(*) FROM ids))),
        seqs AS (SELECT subject_id, hadm_id, unnest(range(1 + ceil(greatest(len(words) - {_SEQ - 2}, 0) / {_SEQ})::BIGINT)) AS seq_idx FROM toks),
        rows AS (SELECT s.subject_id, hadm_id, seq_idx, readm FROM seqs s LEFT JOIN lab ON s.subject_id = lab.subject_id),
        c AS (SELECT readm, count(*) AS n FROM rows WHERE readm IS NOT NULL GROUP BY readm)
        SELECT r.subject_id, hadm_id, seq_idx::INTEGER AS seq_idx, r.readm::DOUBLE AS readm,
               CASE WHEN r.subject_id IN (SELECT subject_id FROM val) THEN 'validation' ELSE 'train' END AS split,
               round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * c.n), 6) AS class_weight
        FROM rows r LEFT JOIN c ON r.readm = c.readm""",
    "predicted_classes": f"WITH {_LOGITS} SELECT subject_id, seq_idx, (l1 > l0)::INTEGER AS prediction FROM seqs",
    "pool_scores": f"""WITH {_LOGITS} SELECT subject_id, n_sequences, label, round(l0, 6) AS logit0, round(l1, 6) AS logit1,
        (l1 > l0)::INTEGER AS prediction FROM pool""",
    "binary_metrics": f"WITH {_SCORES} SELECT {_ROUNDED_RATES} FROM ({_rates('scores')})",
    "weighted_metrics": f"""WITH {_SCORES}, classes AS (SELECT DISTINCT label AS c FROM scores),
        per AS (SELECT c, count(*) FILTER (label = c) AS s, count(*) FILTER (prediction = c) AS f,
                       count(*) FILTER (label = c AND prediction = c)::DOUBLE AS tp FROM scores, classes GROUP BY c),
        pr AS (SELECT s, CASE WHEN f > 0 THEN tp / f ELSE 0.0 END AS p, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS r FROM per)
        SELECT sum(s)::BIGINT AS n, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall,
               round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END * s) / sum(s), 6) AS f1 FROM pr""",
    "auroc": f"WITH {_SCORES} SELECT round(auroc, 6) AS auroc FROM ({_auroc('scores')})",
    "cross_entropy": f"WITH {_LOGITS} SELECT round(avg({_LOSS}), 6) AS loss FROM seqs",
    "metrics_guard": f"""WITH {_SCORES} SELECT 'both' AS labels, {_ROUNDED_RATES} FROM ({_rates('scores')})
        UNION ALL SELECT 'positive', count(*), NULL, NULL, NULL, NULL FROM scores WHERE label = 1""",
    "evaluation_report": f"WITH {_LOGITS} {_report('seqs', 'seqs')}",
    "report_sink": f"WITH {_LOGITS} {_report('seqs', 'seqs')}",
    "metrics_by_level": f"""WITH {_LOGITS} {_report('seqs', 'seqs', ", 'sequence' AS level")}
        UNION ALL {_report('pool', 'seqs', ", 'patient' AS level")}""",
    "svm_scores": f"WITH {_NOTE_HOLDOUT} SELECT subject_id, readm, true AS scored, true AS agrees FROM chosen",
    "elastic_net_scores": f"WITH {_NOTE_HOLDOUT} SELECT subject_id, readm, true AS scored, true AS agrees FROM chosen",
    "model_reload": f"WITH {_NOTE_HOLDOUT} SELECT penalty, subject_id, true AS equal FROM chosen, (VALUES ('l2'), ('elasticnet')) p(penalty)",
    "bow_report": f"WITH {_NOTE_HOLDOUT} SELECT count(*) AS n, true AS valid FROM chosen",
    "embedding_report": f"""WITH {_NOTE_HOLDOUT} SELECT count(*) AS n, true AS valid, 'test' AS report FROM chosen
        UNION ALL SELECT count(*), true, 'train' FROM nlab WHERE subject_id NOT IN (SELECT subject_id FROM chosen)""",
    "grid_search": """SELECT penalty, alpha::DOUBLE AS alpha, true AS valid
        FROM (VALUES ('l2'), ('elasticnet')) p(penalty), (VALUES (1e-4), (1e-3), (1e-2), (1e-1), (1.0)) a(alpha)""",
    "w2v_note_vectors": f"""WITH {_NOTES},
        words AS (SELECT subject_id, hadm_id, unnest({_words(_normalize('text'))}) AS term FROM notes),
        vocab AS (SELECT term FROM words GROUP BY term HAVING count(*) >= 5),
        hit AS (SELECT DISTINCT subject_id, hadm_id FROM words JOIN vocab USING (term))
        SELECT n.subject_id, n.hadm_id, h.subject_id IS NOT NULL AS known, true AS ordered
        FROM notes n LEFT JOIN hit h ON n.subject_id = h.subject_id AND n.hadm_id = h.hadm_id""",
    "w2v_refit": f"""WITH {_NOTES}, words AS (SELECT unnest({_words(_normalize('text'))}) AS term FROM notes)
        SELECT term AS word, 100 AS size FROM words GROUP BY term HAVING count(*) >= 5""",
    "w2v_search": """SELECT size, "window", rate::DOUBLE AS rate, alpha::DOUBLE AS alpha, true AS valid
        FROM (VALUES (100), (200)) s(size), (VALUES (5), (7), (9)) w("window"),
            (VALUES (1e-4), (1e-3), (1e-2)) r(rate), (VALUES (1e-4), (1e-3), (1e-2)) a(alpha)""",
    "patient_alpha_search": """SELECT 'l2' AS penalty, alpha::DOUBLE AS alpha, true AS valid
        FROM (VALUES (0.005), (0.01), (0.02)) a(alpha)""",
    "holdout_tables": f"""WITH {_NOTE_HOLDOUT},
        n AS (SELECT *, CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'test' ELSE 'train' END AS split FROM notes),
        l AS (SELECT *, CASE WHEN subject_id IN (SELECT subject_id FROM chosen) THEN 'test' ELSE 'train' END AS split FROM nlab)
        SELECT split, count(*) AS n_rows, count(DISTINCT subject_id) AS n_patients, 'notes' AS "table" FROM n GROUP BY split
        UNION ALL SELECT split, count(*), count(DISTINCT subject_id), 'labels' FROM l GROUP BY split""",
}
