"""DuckDB SQL of the queries that SQL can express, for the comparison on the given tables."""

SUBSTRINGS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h),
c AS (SELECT DISTINCT g.doc_id, g.i + k AS pos FROM g JOIN m USING (h), range(0, 13) t(k) WHERE m.d < g.doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

QUOTES = r"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS raw FROM conversations),
s AS (SELECT *, string_split(raw, chr(10)) AS ls FROM m),
l AS (SELECT rid, conv_id, turn, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM s),
v AS (SELECT *, length(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level, regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', '') AS content FROM l),
b AS (SELECT *, trim(content, ' ') = '' AS blank FROM v),
f AS (SELECT *, NOT blank AND (i = 1 OR lag(level) OVER o <> level OR lag(blank) OVER o) AS starts,
  level = 0 AND NOT (regexp_matches(content, '(?i)\bwrote:[ \t]*$') AND (coalesce(lead(level) OVER o, 0) > 0 OR (coalesce(lead(blank) OVER o, false) AND coalesce(lead(level, 2) OVER o, 0) > 0))) AS own FROM b WINDOW o AS (PARTITION BY rid ORDER BY i)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY rid ORDER BY i) AS block FROM f),
k AS (SELECT rid, conv_id, turn, block, arg_min(level, i) AS level, string_agg(content, ' ' ORDER BY i) AS whole, list(content) AS parts FROM n WHERE block > 0 GROUP BY rid, conv_id, turn, block),
u AS (SELECT DISTINCT rid, conv_id, turn, block, level, unit FROM (SELECT *, trim(regexp_replace(lower(unnest(list_append(parts, whole))), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS unit FROM k) WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, unit, min(turn) AS origin FROM u WHERE level = 0 GROUP BY conv_id, unit),
q AS (SELECT conv_id, turn, block, min(level) AS level, max(origin) AS origin FROM u JOIN o USING (conv_id, unit) WHERE level > 0 AND origin < turn GROUP BY conv_id, turn, block),
r AS (SELECT conv_id, turn, count(*) AS n_linked, max({'a': -level, 'b': origin}).b AS reply_to FROM q GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM r UNION ALL SELECT a.conv_id, a.turn, r.reply_to, a.depth + 1 FROM a JOIN r ON r.conv_id = a.conv_id AND r.turn = a.root),
d AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM a GROUP BY conv_id, turn),
t AS (SELECT rid, regexp_replace(regexp_replace(string_agg(content, chr(10) ORDER BY i), '^\n+', ''), '\n+$', '') AS text FROM n WHERE own GROUP BY rid),
c AS (SELECT rid, count(*) AS n_quoted FROM k WHERE level > 0 GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, coalesce(t.text, '') AS text, coalesce(c.n_quoted, 0)::BIGINT AS n_quoted, coalesce(r.n_linked, 0)::BIGINT AS n_linked, r.reply_to, coalesce(d.root, m.turn) AS thread_root, coalesce(d.depth, 0)::BIGINT AS depth, '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(t.text, '') || chr(10) AS chat
FROM m LEFT JOIN t USING (rid) LEFT JOIN c USING (rid) LEFT JOIN r ON r.conv_id = m.conv_id AND r.turn = m.turn LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn"""

FILTER_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(x, bit)),
o AS (SELECT [p.x, q.x, r.x, s.x, t.x] AS xs, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT array_to_string(xs, '') AS filter_order, k::INT AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) t(k)),
a AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM a"""

#: Numbers by doc_id, the keyed rounds by md5, and CRC-32 by its table, folded over a text's bytes.
SHARDS = r"""WITH z AS (SELECT count(*) AS n FROM documents), g AS (SELECT n, ceil(sqrt(n))::BIGINT AS a FROM z), h AS (SELECT n, a, (n + a - 1) // a AS b FROM g),
r AS (SELECT *, strlen(coalesce(text, ''))::BIGINT + 1 AS size, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS x FROM documents),
w AS (WITH RECURSIVE v AS (SELECT x AS x0, 0 AS i, x // b AS l, x % b AS r, n, a, b FROM r, h
  UNION ALL SELECT x0, CASE WHEN i = 6 THEN 1 ELSE i + 1 END,
    CASE WHEN i IN (0, 2, 4, 6) THEN (l + ('0x' || substr(md5(concat_ws('|', 'shuffle-1', i % 6, r)), 1, 12))::BIGINT) % a ELSE l END,
    CASE WHEN i IN (1, 3, 5) THEN (r + ('0x' || substr(md5(concat_ws('|', 'shuffle-1', i, l)), 1, 12))::BIGINT) % b ELSE r END, n, a, b FROM v WHERE i < 6 OR l * b + r >= n)
  SELECT x0, l * b + r AS place FROM v WHERE i = 6 AND l * b + r < n),
t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
k AS (SELECT text, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295)::BIGINT AS crc FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), t)
SELECT r.doc_id, size, coalesce(k.crc, 0)::BIGINT AS text_crc32, 'rows' AS law, (place % 8)::INT AS shard, (place // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM r JOIN w ON w.x0 = r.x LEFT JOIN k ON k.text = r.text"""
