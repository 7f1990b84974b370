"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[0-9a-z\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

SQL = {"op5_benchmark_decontamination": OP5}

OP10 = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS s
    FROM w
),
sorted AS (SELECT doc_id, list_sort(s) AS l FROM s),
classes AS (SELECT min(doc_id) AS rep, l, len(l) AS n FROM sorted WHERE len(l) > 0 GROUP BY l),
x AS (SELECT rep, n, unnest(l) AS h FROM classes),
pairs AS (
    SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT rep, rep FROM classes),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.l) AS BIGINT) AS n_shingles, coalesce(comp.component_id, d.doc_id) AS component_id,
    d.doc_id = coalesce(comp.component_id, d.doc_id) AS kept
FROM sorted d LEFT JOIN classes ON d.l = classes.l LEFT JOIN comp ON comp.rep = classes.rep
"""

SQL["op10_minhash_near_dedup"] = OP10

OP7 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

SQL["op7_exact_top_k"] = OP7

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM f
"""

SQL["op4_warc"] = OP4

OP13 = """
WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (
    SELECT row_number() OVER () AS row, page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
)
SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
QUALIFY row_number() OVER (PARTITION BY u.row ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1
"""

SQL["op13_url_filters"] = OP13

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
own AS (SELECT row, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM own),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
x AS (SELECT row, unnest(t) AS term FROM own),
tf AS (SELECT row, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT N_docs FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
m AS (SELECT row, doc_id, 10 + (90 * n * N_docs) // L AS m FROM own, s),
score AS (
    SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

SQL["op11_ranked_search"] = OP11

OP12 = """
WITH v AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
    SELECT anchor_id, row, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW o AS (PARTITION BY p.anchor_id, p.row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 5
"""

SQL["op12_hard_negatives"] = OP12
