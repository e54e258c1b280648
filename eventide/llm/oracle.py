"""DuckDB SQL of the registered text queries, where it can express an operator over whole tables."""

from __future__ import annotations

from .licences import BASE, INDEXED, MISSING, NOTICES, SLACK, Template

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of items and of documents as joined words; a window is 13 words of an item, or all of a shorter one.
DECONTAMINATION = f"""
WITH items AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS MATERIALIZED (SELECT r, n, i, item FROM places JOIN windows USING (n, s)),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""



def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def licence_sql(base: tuple[Template, ...], notices: tuple[Template, ...]) -> str:
    """Every place of every word, joined with every template's words: no index decides what is looked at."""
    templates, phrases = [*base, *notices], []
    for t, own in enumerate(templates):
        whole = len(own.words) <= INDEXED
        for k, m in enumerate([own.text] if whole else own.mandatory):
            first = own.words.index(m.split()[0]) if whole else next(i for i in range(len(own.words)) if own.words[i : i + len(m.split())] == m.split())
            phrases += [(t, k, first + j, w, 0 if whole else SLACK) for j, w in enumerate(m.split())]
    return f"""
WITH names(t, base, label, short) AS ({_values([(t, t < len(base), x.label, len(x.words) <= INDEXED) for t, x in enumerate(templates)])}),
tw(t, q, w) AS ({_values([(t, x.words.index(w), w) for t, x in enumerate(templates) for w in dict.fromkeys(x.words)])}),
phrase(t, k, q, w, slack) AS ({_values(phrases)}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
places AS MATERIALIZED (SELECT r, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM docs),
known AS MATERIALIZED (SELECT * FROM places WHERE w IN (SELECT w FROM tw)),
df AS (SELECT w, count(DISTINCT r) AS n FROM known GROUP BY w),
idf AS (SELECT t, q, w, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1 AS v FROM tw LEFT JOIN df USING (w)),
entries AS MATERIALIZED (SELECT *, v / sum(v) OVER (PARTITION BY t) AS share, count(*) OVER (PARTITION BY t) - CASE WHEN short THEN 0 ELSE {MISSING} END AS needed
  FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, w) AS rank FROM idf JOIN names USING (t)) WHERE short OR rank <= {INDEXED}),
agreed AS (SELECT r, t, i - q AS s, sum(share) AS share FROM known JOIN entries USING (w) GROUP BY r, t, i - q HAVING count(*) >= any_value(needed)),
shifted AS (SELECT a.r, a.t, a.s, p.k, d.range AS d, count(*) AS n FROM agreed a JOIN phrase p ON p.t = a.t JOIN range({-SLACK}, {SLACK + 1}) d ON abs(d.range) <= p.slack JOIN known w ON w.r = a.r AND w.i = a.s + d.range + p.q AND w.w = p.w GROUP BY ALL),
held AS (SELECT DISTINCT r, t, s, k FROM shifted JOIN (SELECT t, k, count(*) AS size FROM phrase GROUP BY t, k) USING (t, k) WHERE n = size),
sure AS MATERIALIZED (SELECT r, t, s, base, label, CASE WHEN base THEN 1.0 ELSE least(share, 1.0) END AS share FROM agreed JOIN names USING (t) WHERE (SELECT count(*) FROM held h WHERE h.r = agreed.r AND h.t = agreed.t AND h.s = agreed.s) = (SELECT count(DISTINCT k) FROM phrase p WHERE p.t = agreed.t)),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM sure GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (r)"""


#: Every phrase of up to five words, spelt out and counted.
COLLOCATIONS = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(text, '{UPPER}', '{LOWER}') AS t FROM documents WHERE text IS NOT NULL),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+')), '[^\\x20\\x09]+') AS w FROM docs),
phrases AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM phrases GROUP BY ALL),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT * FROM f WHERE m >= 2 AND a >= 100),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS p, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scores AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p JOIN f y ON y.lang = c.lang AND y.phrase = q JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op5_decontamination": DECONTAMINATION, "op12_licences": licence_sql(BASE, NOTICES), "op13_collocations": COLLOCATIONS}
