"""DuckDB SQL for the rows of the operators that SQL can express on whole tables."""

PHRASES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, win.i + j AS i FROM win JOIN firsts USING (k), unnest(range(0, 13)) AS r(j) WHERE f < win.doc_id),
pos AS (SELECT w.doc_id, p.i, ws[p.i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS p(i)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.i) AS t, count(*) AS n FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.i = pos.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS k FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
here AS (SELECT d.doc_id, s.n, t.i, array_to_string(ws[t.i:t.i + s.n - 1], ' ') AS k FROM d, sizes s, unnest(range(1, len(ws) - s.n + 2)) AS t(i)),
found AS (SELECT here.doc_id, here.n, here.i, win.item FROM here JOIN win ON here.k = win.k AND here.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM found) f, unnest(range(0, n)) AS r(j) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM found GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS t(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS r FROM (SELECT DISTINCT a FROM edge) UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

#: Of pages whose article is an element of that name, and whose other texts are all chrome: the article's text, the tokens
#: outside, and those of them that lie in a run of eight that another page of the host has too.
PAGES = r"""
WITH raw AS (SELECT row_number() OVER () AS id, page_id, url, coalesce(html, '') AS html, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
cut AS (SELECT *, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS inside, regexp_replace(regexp_replace(html, '(?s)<article>.*?(?:</article>|$)', ' '), '(?s)^.*?</head>|<!--.*?-->', ' ', 'g') AS outside FROM raw),
plain AS (SELECT *, regexp_replace(regexp_replace(inside, '</?b>|<[^>]*$', '', 'g'), '<[^>]*>', ' ', 'g') AS a, regexp_replace(regexp_replace(outside, '</?(?:b|a)(?: [^>]*)?>|<[^>]*$', '', 'g'), '<[^>]*>', ' ', 'g') AS o FROM cut),
texts AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(a, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text, regexp_extract_all(o, '\S+') AS ws FROM plain),
win AS (SELECT host, id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM texts, unnest(range(1, len(ws) - 6)) AS t(i)),
runs AS (SELECT host, k FROM win GROUP BY 1, 2 HAVING count(DISTINCT id) > 1),
hit AS (SELECT id, count(DISTINCT i + j) AS n FROM win JOIN runs USING (host, k), unnest(range(0, 8)) AS r(j) GROUP BY 1)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_outside, coalesce(n, 0) AS n_repeated FROM texts LEFT JOIN hit USING (id)
"""
