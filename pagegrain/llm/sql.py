"""DuckDB SQL for the operators that SQL can express, written from their definitions and not from their plans."""

WORD = r"[^\x20\x09-\x0D]+"

RULES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
runs AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
seen AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM runs),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS at FROM seen, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(dup.n_lines, 0) AS n_lines, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]|[^\x00-\x7F]'))) AS n_upper
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT + 8 * (word_chars > 15 * n_words)::INT
  + 16 * (word_chars < 2 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT + 64 * (100 * n_upper > 60 * n_words)::INT)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

NGRAM_JOIN_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid JOIN n p ON p.rid = a.rid JOIN n q ON q.rid = b.rid
  GROUP BY a.rid, b.rid, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach(x, y) AS (SELECT rid, rid FROM w UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach r ON r.x = w.rid JOIN w o ON o.rid = r.y LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id
"""

SHARDING_SQL = """
WITH k AS (SELECT doc_id, strlen(coalesce(text, '')) + 16 AS bytes, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT k.*, d, h >> (60 - d) AS p FROM k, (SELECT unnest(range(0, 61)) AS d)),
fits AS (SELECT d, p FROM lv GROUP BY d, p HAVING sum(bytes) <= 1048576 OR count(*) = 1),
leaf AS (SELECT doc_id, bytes::BIGINT AS bytes, h, min(d)::INT AS depth FROM lv JOIN fits USING (d, p) GROUP BY doc_id, bytes, h)
SELECT doc_id, bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END AS shard FROM leaf
"""

DECONTAMINATION_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM benchmark),
ds AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 5)),
bs AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM b WHERE len(ws) >= 5)) GROUP BY ALL),
pairs AS (SELECT DISTINCT rid, item_id FROM ds JOIN bs USING (g)),
win AS (SELECT rid, doc_id, item_id, len(b.ws) - 4 AS k, unnest(range(1, len(d.ws) - len(b.ws) + 2)) AS s FROM pairs JOIN d USING (rid) JOIN b USING (item_id) WHERE len(d.ws) >= len(b.ws)),
held AS (SELECT win.rid, doc_id, item_id, k, s, g, count(*) AS c FROM win JOIN ds ON ds.rid = win.rid AND ds.p BETWEEN s AND s + k - 1 GROUP BY ALL),
sim AS (SELECT rid, doc_id, item_id, s, k, sum(least(held.c, bs.c)) AS i FROM held JOIN bs USING (item_id, g) GROUP BY ALL),
ok AS (SELECT DISTINCT doc_id, item_id, s - 1 AS start, i / (2 * k - i) AS similarity, rid FROM sim WHERE 100 * i >= 75 * (2 * k - i))
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_min(start, (-similarity, start))::INT AS start, count(*) AS n_windows FROM ok GROUP BY doc_id, item_id
"""
