"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d,
         octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 100 AND p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f ON p.d = f.d
"""

DECONTAMINATION = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM w),
hit AS (
  SELECT doc_id, s, win.n, item_id
  FROM (SELECT doc_id, s, l.n, array_to_string(w[s:s + l.n - 1], ' ') AS k
        FROM pos, (SELECT DISTINCT n FROM win) l WHERE s + l.n - 1 <= len(w)) g
  JOIN win ON g.n = win.n AND g.k = win.k),
n_hit AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
wt AS (
  SELECT wid, item_id, unnest(list_distinct(w)) AS term, len(list_distinct(w)) AS need
  FROM (SELECT row_number() OVER () AS wid, item_id, string_split(k, ' ') AS w FROM win)),
vocab AS (SELECT DISTINCT term FROM wt),
post AS (SELECT doc_id, s, w[s] AS term FROM pos WHERE w[s] IN (SELECT term FROM vocab)),
pair AS (
  SELECT p.doc_id, wt.wid FROM (SELECT DISTINCT doc_id, term FROM post) p JOIN wt USING (term)
  GROUP BY p.doc_id, wt.wid, wt.need HAVING count(*) = wt.need),
own AS (SELECT pair.doc_id, wt.wid, wt.item_id, wt.need, wt.term, post.s FROM pair JOIN wt USING (wid) JOIN post ON post.doc_id = pair.doc_id AND post.term = wt.term),
close AS (
  SELECT a.doc_id, a.item_id FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.wid = b.wid AND b.s >= a.s AND b.s < a.s + 26
  GROUP BY a.doc_id, a.wid, a.item_id, a.need, a.s HAVING count(DISTINCT b.term) = a.need),
nears AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_near FROM close GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_near, 0)::BIGINT AS n_near, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN n_hit ON w.doc_id = n_hit.doc_id LEFT JOIN its ON w.doc_id = its.doc_id LEFT JOIN nears ON w.doc_id = nears.doc_id
"""

MIXING = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)
           ::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT source, ss, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
c AS (
  SELECT *, (sum(ss) OVER () - coalesce(sum(3 * ss) OVER o, 0))::BIGINT AS l,
         (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS wl
  FROM r WINDOW o AS (ORDER BY (3 * ss)::DOUBLE / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT source, ss, w, w * l >= 3 * ss * wl AS capped FROM c),
f AS (
  SELECT *, (sum(ss) OVER () - sum(CASE WHEN capped THEN 3 * ss ELSE 0 END) OVER ())::BIGINT AS lf,
         (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT AS wf FROM k),
t AS (SELECT source, ss, CASE WHEN capped THEN (3 * ss)::DOUBLE ELSE (w * lf)::DOUBLE / wf END AS target FROM f),
q AS (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, ss AS source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
y AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, min(doc_id) AS first_id, max(doc_id) AS last_id FROM y WHERE length(key) >= 10 GROUP BY key),
z AS (SELECT y.*, coalesce(y.doc_id <> g.first_id, false) AS gone FROM y LEFT JOIN g ON y.key = g.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM z GROUP BY doc_id
"""

SUBSTRING_DEDUP = r"""
WITH l0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
l AS (
  SELECT doc_id, line, k, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM l0),
m AS (SELECT doc_id, k, a, regexp_extract_all(line, '[^.!?\n]*[.!?]+["'')\]]*\s*|[^.!?\n]+') AS parts FROM l WHERE line <> ''),
s0 AS (SELECT doc_id, k, a, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM m),
s AS (
  SELECT doc_id, part, a + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM s0),
u1 AS (SELECT *, list_filter(regexp_split_to_array(part, '\s+'), lambda w: w <> '') AS w FROM s),
u AS (
  SELECT doc_id, a, a + length(part) AS b, len(w) AS words, lower(array_to_string(w, ' ')) AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i
  FROM u1 WHERE len(w) > 0),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY unit) AS first_id, row_number() OVER (PARTITION BY doc_id, unit ORDER BY a) AS nth FROM u),
gone AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM r WHERE nth > 1 OR doc_id <> first_id),
span AS (SELECT doc_id, isle, min(a)::BIGINT AS a, max(b)::BIGINT AS b, count(*) AS n FROM gone GROUP BY doc_id, isle HAVING sum(words) >= 20),
cut AS (
  SELECT s.doc_id, s.a, s.b, d.text,
         s.b + CASE WHEN (s.a = 0 OR substr(d.text, s.a, 1) = chr(10)) AND substr(d.text, s.b + 1, 1) = chr(10) THEN 1 ELSE 0 END AS onward
  FROM span s JOIN documents d USING (doc_id)),
piece AS (SELECT *, coalesce(lag(onward) OVER (PARTITION BY doc_id ORDER BY a), 0) AS done FROM cut),
own AS (
  SELECT doc_id, string_agg(substr(text, done + 1, a - done), '' ORDER BY a) || substr(any_value(text), max(onward) + 1) AS kept,
         string_agg(a || '-' || b, ',' ORDER BY a) AS spans, sum(b - a)::BIGINT AS n_chars FROM piece GROUP BY doc_id),
n AS (SELECT doc_id, sum(n)::BIGINT AS n FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_removed, coalesce(own.n_chars, 0) AS n_chars_removed, coalesce(spans, '') AS removed_spans,
       length(coalesce(kept, d.text, ''))::BIGINT AS n_chars_kept, sha256(coalesce(kept, d.text, '')) AS kept_sha256
FROM documents d LEFT JOIN own USING (doc_id) LEFT JOIN n USING (doc_id)
"""

URL_FILTER = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_replace(substr(url, position('://' IN url) + 3), '[?#](.|\\n)*', '') ELSE '' END AS a FROM pages),
p AS (SELECT page_id, translate(split_part(coalesce(a, ''), '/', 1), '{UPPER}', '{LOWER}') AS host, substr(coalesce(a, ''), length(split_part(coalesce(a, ''), '/', 1)) + 1) AS path FROM u),
r(h, b, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT page_id, h || b AS rule, v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || b) DESC) = 1)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
"""

# CRC-32 by its table of 256 entries, over the UTF-8 of code points below 256
SPELLING = f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\u00c0-\u00ff]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (
  SELECT doc_id, w, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END)) AS b FROM each),
hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, t),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS o, b.n AS o_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, first(o ORDER BY o_n DESC, o) AS o, max(o_n) AS o_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN o_n >= 2 * w.n THEN o END AS form, CASE WHEN o_n >= 2 * w.n THEN o_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
