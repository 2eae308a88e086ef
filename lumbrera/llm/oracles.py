"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words as [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.
WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = """
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, list_filter(string_split_regex(lower(line), '[ \\t\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM l),
k AS (SELECT doc_id, i, w, array_to_string(w, ' ') AS s FROM w WHERE len(w) >= 5),
first AS (SELECT s, any_value(w) AS w, min({'d': doc_id, 'i': i}) AS f FROM k GROUP BY s),
v AS (SELECT s, w, f, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS t FROM (SELECT s, w, f, unnest(range(1, len(w) + 1)) AS p FROM first)),
near AS (
  SELECT DISTINCT a.s FROM v a JOIN v b ON a.t = b.t AND a.p = b.p AND len(a.w) = len(b.w) AND b.f < a.f
  UNION SELECT a.s FROM v a JOIN first b ON a.t = b.s AND b.f < a.f
  UNION SELECT a.s FROM first a JOIN v b ON b.t = a.s AND b.f < a.f),
gone AS (SELECT k.doc_id, k.i FROM k JOIN first USING (s) WHERE s IN (SELECT s FROM near) OR {'d': k.doc_id, 'i': k.i} <> f)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_gone, coalesce(gone, '') AS gone, sha256(coalesce(kept, '')) AS text_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n, count(gone.i) AS g, string_agg(CAST(gone.i AS VARCHAR), ',' ORDER BY gone.i) AS gone,
    string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id) x ON d.doc_id = x.doc_id
"""

#: Words as [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+, A-Z lower-cased.
TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {TERMS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L_ FROM d),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * N_) // L_)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

OP13 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLES: dict[str, str] = {"op7_decontaminate": OP7, "op9_line_dedup": OP9, "op11_ranked_search": OP11, "op13_exact_dedup": OP13}
