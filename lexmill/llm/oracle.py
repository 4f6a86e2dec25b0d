"""SQL twins of the training-data queries that SQL can express; tests/llm holds the others against brute force, the library, round trips or held-out rows."""

#: CRC-32 of a decimal id, as DuckDB has no such function: the table of byte steps is made from the polynomial.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"""
_CRC_VALUE = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"""
_CRC = _CRC_TABLE + """,
held AS (SELECT doc_id, row_number() OVER () AS rid, text, """ + _CRC_VALUE + """ % {by} = {rest} AS held_out FROM documents, crc)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    # Multisets by counting, all pairs that share a shingle, and the closure of the links.
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS inter FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t a ON a.doc_id = x JOIN t b ON b.doc_id = y WHERE inter / (a.total + b.total - inter) >= 0.8),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id""",
    "op7_language_model": "WITH " + _CRC.format(by=7, rest=2) + r""",
tok AS (SELECT rid, doc_id, held_out, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, doc_id, held_out, list_append(list_filter(string_split_regex(""" + _LOWER + r""", '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> ''), chr(2)) AS ws FROM held)),
pre AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY rid ORDER BY i), chr(1)) AS h, CASE WHEN i = 2 THEN chr(1) ELSE lag(w, 2) OVER (PARTITION BY rid ORDER BY i) END AS g FROM tok),
uni AS (SELECT w, count(*) AS c FROM pre WHERE NOT held_out GROUP BY w), bi AS (SELECT h, w, count(*) AS c FROM pre WHERE NOT held_out GROUP BY ALL),
tri AS (SELECT g, h, w, count(*) AS c FROM pre WHERE NOT held_out AND g IS NOT NULL GROUP BY ALL),
st AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v, count(*) FILTER (c = 1) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) AS d FROM uni),
ctx AS (SELECT w AS h, c FROM uni UNION ALL SELECT chr(1), count(*) FROM held WHERE NOT held_out),
q AS (SELECT p.*, coalesce(u.c, 0) AS cw, coalesce(t.c, 0) AS ct, coalesce(y.c, 0) AS cgh, n, v,
  (coalesce(b.c, 0) + 50 * CASE WHEN u.c IS NULL THEN d * v / n ELSE (u.c - d) / n END) / (coalesce(x.c, 0) + 50) AS p2
  FROM pre p CROSS JOIN st LEFT JOIN uni u ON u.w = p.w LEFT JOIN bi b ON b.h = p.h AND b.w = p.w LEFT JOIN ctx x ON x.h = p.h
  LEFT JOIN tri t ON t.g = p.g AND t.h = p.h AND t.w = p.w LEFT JOIN bi y ON y.h = p.g AND y.w = p.h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (cw > 0) AS n_known, any_value(n) AS train_tokens,
  round(sum(log10((cw + 1) / (n + 1 * (v + 1)))), 6) AS base_score, round(sum(log10(CASE WHEN g IS NULL THEN p2 ELSE (ct + 5 * p2) / (cgh + 5) END)), 6) AS score FROM q GROUP BY rid, doc_id, held_out""",
    # What is left of the pages of the tables: the blocks of each article.
    "op8_html_extraction": r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ') AS h FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(h, '</?(p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g'))), lambda x: x <> '') AS bs FROM a)
SELECT page_id, url, array_to_string(bs, chr(10)) AS text, CAST(length(array_to_string(bs, chr(10))) AS BIGINT) AS n_chars FROM b""",
    "op10_decontamination": r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(""" + _LOWER + r""", '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (
  SELECT item_id, list_filter(string_split_regex(""" + _LOWER + r""", '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens WHERE len(ws) >= n)),
hit AS (SELECT p.rid, p.i, p.n, win.item_id FROM place p JOIN win ON p.n = win.n AND p.w = win.w),
cover AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (rid) LEFT JOIN its USING (rid)""",
    # Equal words q apart, islands of such places, and of equal stretches the smallest period.
    "op11_periodic_runs": "WITH " + _CRC_TABLE + r""",
named AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '') AS ws, """ + _CRC_VALUE + r""" AS h FROM documents, crc),
place AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) END AS a, h // 10 % 8 AS g8 FROM named),
tok AS (SELECT rid, i, ws[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g8)) ELSE i END + 1] AS w, n FROM (SELECT *, unnest(range(n)) AS i FROM place)),
same AS (SELECT x.rid, x.i, y.i - x.i AS q FROM tok x JOIN tok y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
isle AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM same) GROUP BY rid, q, k),
run AS (SELECT rid, s, len, min(q) AS q FROM isle WHERE len >= greatest(24, 3 * q) GROUP BY rid, s, len),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY rid ORDER BY len::DOUBLE / q DESC, s, q) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM named LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)""",
    "op12_substring_dedup": r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(ws[i : i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT rid, i FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING count(*) > 1) USING (s) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS i FROM hit), tok AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM tok ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)""",
}
