"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import spotsigs

_ANCHORS = ", ".join(f"'{a}'" for a in spotsigs.ANCHORS)

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following FROM d),
e AS (SELECT doc_id, t, following, length(t) AS n_chars, left(t, length(t) - length(t) // 2) || left(following, length(t) // 2) AS edited FROM n),
texts AS (SELECT t FROM d UNION SELECT edited FROM e),
split AS (SELECT t, trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w FROM texts),
words AS (SELECT t, unnest(string_split(w, ' ')) AS x, generate_subscripts(string_split(w, ' '), 1) AS i FROM split WHERE w <> ''),
marked AS (SELECT *, x IN ({_ANCHORS}) AS anchor FROM words),
ranked AS (SELECT *, count(*) FILTER (WHERE NOT anchor) OVER (PARTITION BY t ORDER BY i) AS c FROM marked),
content AS (SELECT t, x, c FROM ranked WHERE NOT anchor),
spots AS (SELECT DISTINCT a.t, a.x || ' ' || p.x || ' ' || q.x AS s FROM ranked a
          JOIN content p ON p.t = a.t AND p.c = a.c + 1 JOIN content q ON q.t = a.t AND q.c = a.c + 2 WHERE a.anchor),
sets AS (SELECT t, list_sort(list(s)) AS s FROM spots GROUP BY t),
sigs AS (SELECT split.t, CASE WHEN sets.s IS NOT NULL THEN sets.s WHEN w <> '' THEN [w] ELSE []::VARCHAR[] END AS s
         FROM split LEFT JOIN sets ON sets.t = split.t),
likely AS (SELECT e.doc_id, e.n_chars, e.edited, o.s AS own, c.s AS changed, f.s AS following FROM e
           JOIN sigs o ON o.t = e.t JOIN sigs c ON c.t = e.edited JOIN sigs f ON f.t = e.following),
sizes AS (SELECT *, len(list_intersect(own, changed)) AS ie, len(list_intersect(own, following)) AS ix FROM likely)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '|') AS fingerprint, array_to_string(changed, '|') AS edited_fingerprint,
       CASE WHEN len(own) + len(changed) = 0 THEN 1.0::DOUBLE ELSE ie::DOUBLE / (len(own) + len(changed) - ie) END AS near_edited,
       CASE WHEN len(own) + len(following) = 0 THEN 1.0::DOUBLE ELSE ix::DOUBLE / (len(own) + len(following) - ix) END AS near_next
FROM sizes
"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN unnest(generate_series(1, len(w) - 2)) ELSE 1 END AS i, w FROM w WHERE len(w) >= 3
         UNION ALL SELECT doc_id, 1, w FROM w WHERE len(w) BETWEEN 1 AND 2),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8 = r"""
SELECT page_id, url, 'b' AS damaged, sha256(html) AS sha256_a, sha256(CASE WHEN html LIKE 'X%' THEN 'Y' ELSE 'X' END || substr(html, 2)) AS sha256_b
FROM pages WHERE ((page_id % 97) + 97) % 97 = 13 AND regexp_matches(html, '^[\x00-\x7F]')
"""

OP11 = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS o,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT first(level ORDER BY cap / weight, number) AS level FROM f WHERE level * weight <= cap),
g AS (SELECT source, source_size, number, weight, least(CAST(cap AS DOUBLE), coalesce(l.level * weight, CAST(cap AS DOUBLE))) AS target FROM w, l),
p AS (SELECT d.*, g.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
u AS (SELECT *, greatest(0, least(size, floor(target) - before)) AS one, greatest(0, least(size, floor(target) - before - source_size)) AS two,
        before / target * weight AS a, (before + source_size) / target * weight AS b,
        CASE number % 3 WHEN 0 THEN 7.5 WHEN 1 THEN 2.0 ELSE 0.5 END AS w0, CASE number % 3 WHEN 0 THEN -5.0 WHEN 1 THEN 0.0 ELSE 1.0 END AS slope FROM p)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN 2 * a / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * a, 0))) END AS first_at,
  CASE WHEN two > 0 THEN 2 * b / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * b, 0))) END AS second_at FROM u
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
asked AS (SELECT i, x, count(*) AS times FROM (SELECT i, unnest(t) AS x FROM q) GROUP BY ALL),
tf AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(t) AS x FROM d) WHERE x IN (SELECT x FROM asked) GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
w AS (SELECT x, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY x, n_docs),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(t) * n_docs) // n_terms AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT i, m.r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM asked JOIN tf USING (x) JOIN w USING (x) JOIN m USING (r) GROUP BY i, m.r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN q USING (i) WHERE rank <= 20
"""

ORACLE_SQL = {"op2_spotsigs": OP2, "op8_warc_audit": OP8, "op9_ngram_join": OP9, "op11_curriculum": OP11, "op13_lexical_search": OP13}
