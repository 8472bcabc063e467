"""DuckDB SQL that the registered queries are checked against."""

OP7_QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
win AS (SELECT r, i, hash_key, count(*) OVER (PARTITION BY r, hash_key) AS n FROM (
  SELECT r, i, word || chr(10) || lead(word) OVER x || chr(10) || lead(word, 2) OVER x AS hash_key
  FROM pos WINDOW x AS (PARTITION BY r ORDER BY i)) WHERE hash_key IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, (VALUES (0), (1), (2)) AS o(k) WHERE win.n > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 40 * n_lines OR 100 * n_upper > 50 * n_letters
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

# The order of sources with equal finish times inside the budget's last slice follows Spark's source hash; it
# decides nothing unless two entries finish at exactly the same time there.
OP2_SOURCE_MIX = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
        CAST(source_size AS DOUBLE) * 2 AS lim, CAST(sum(source_size) OVER () AS DOUBLE) * 150.0::DOUBLE / 100.0::DOUBLE AS budget FROM per),
l AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, budget, least(lim, w * max(level) OVER ()) AS target FROM l),
e AS (SELECT source, doc_id, size, epoch, md5('mix:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || size) AS rank, n
      FROM (SELECT source, doc_id, size, count(*) AS n FROM s WHERE size > 0 GROUP BY ALL), (VALUES (0), (1)) AS o(epoch)),
q AS (SELECT e.*, sum(size * n) OVER (PARTITION BY e.source ORDER BY epoch, rank ROWS UNBOUNDED PRECEDING) / t.target AS finish, budget
      FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, sum(size * n) OVER (ORDER BY finish, source, epoch, rank ROWS UNBOUNDED PRECEDING) AS total FROM q),
k AS (SELECT source, doc_id, size, count(*) AS times FROM g WHERE total <= budget GROUP BY ALL)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(s.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON s.source IS NOT DISTINCT FROM k.source AND s.doc_id IS NOT DISTINCT FROM k.doc_id AND s.size = k.size
"""

# A run of three (the last may be shorter) becomes one node per step; a group stops when one node remains. Witnesses are
# the other members of each run on the way up. DuckDB has no CRC-32: crc() feeds a byte, then eight shifts.
OP11_MERKLE_MANIFEST = r"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS r, list_reduce(
      list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS crc
  FROM documents),
t AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bent FROM d),
l AS (SELECT r, doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bent) || ':' || bent, '-')) AS bent FROM t),
tree(g, level, pos, n, digest, part) AS (
  SELECT g, 0, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1, count(*) OVER (PARTITION BY g), leaf, [r]
  FROM l
  UNION ALL
  SELECT g, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)), flatten(list(part ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY g, level, pos // 3),
top(level, pos, n, digest, part) AS (
  SELECT 0, row_number() OVER (ORDER BY g) - 1, count(*) OVER (), digest, part FROM tree WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos)), flatten(list(part ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 3),
nodes AS (SELECT g, level, pos, n, digest, part FROM tree WHERE n > 1 UNION ALL SELECT NULL, 1000 + level, pos, n, digest, part FROM top WHERE n > 1),
runs AS (SELECT g, level, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM nodes GROUP BY ALL),
step AS (SELECT unnest(part) AS r, nodes.level, pos % 3 AS place, members
         FROM nodes JOIN runs ON runs.level = nodes.level AND runs.run = pos // 3 AND runs.g IS NOT DISTINCT FROM nodes.g),
proof AS (
  SELECT r, sha256(coalesce(string_agg(list_aggregate(list_filter(members, lambda m, i: i <> place + 1), 'string_agg', ''), '' ORDER BY level), '')) AS proof_sha256,
    list({'place': place, 'members': members} ORDER BY level) AS steps FROM step GROUP BY r),
walk(r, i, now, steps) AS (
  SELECT l.r, 1, l.bent, coalesce(steps, []) FROM l LEFT JOIN proof USING (r)
  UNION ALL
  SELECT r, i + 1, sha256(list_aggregate(list_transform(steps[i].members, lambda m, j: CASE WHEN j = steps[i].place + 1 THEN now ELSE m END), 'string_agg', '')), steps
  FROM walk WHERE i <= len(steps)),
root AS (SELECT digest FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, tree.digest AS subroot, root.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  now AS folded_root, now = root.digest AS verified
FROM l JOIN tree ON tree.n = 1 AND tree.g = l.g JOIN walk ON walk.r = l.r AND i = len(steps) + 1 LEFT JOIN proof ON proof.r = l.r, root
"""


# Matches of a pattern and the gaps between them alternate, so running lengths give the intervals.
OP12_SECRET_LINKS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
pat(name, p) AS (VALUES
  ('assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 'AKIA[A-Z0-9]+'), ('hex', '[0-9a-f]+'),
  ('user', '([uU][sS][eE][rR][nN][aA][mM][eE]|[uU][sS][eE][rR]_?[iI][dD]|[uU][sS][eE][rR]|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT]|[cC][lL][iI][eE][nN][tT]_?[iI][dD])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{3,}'),
  ('endpoint', '([hH][tT][tT][pP][sS]?|[fF][tT][pP]|[sS][sS][hH]|[pP][oO][sS][tT][gG][rR][eE][sS][qQ][lL]|[pP][oO][sS][tT][gG][rR][eE][sS]|[mM][yY][sS][qQ][lL]|[mM][oO][nN][gG][oO][dD][bB]|[rR][eE][dD][iI][sS]|[aA][mM][qQ][pP]|[sS]3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|([hH][oO][sS][tT][nN][aA][mM][eE]|[hH][oO][sS][tT]|[eE][nN][dD][pP][oO][iI][nN][tT]|[sS][eE][rR][vV][eE][rR])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9.-]{4,}'),
  ('blob', '[A-Za-z0-9+/_-]{20,}')),
m AS (SELECT r, text, name, unnest(regexp_extract_all(text, p)) AS word, unnest(string_split_regex(text, p)) AS gap,
        generate_subscripts(string_split_regex(text, p), 1) AS i FROM d, pat),
spot AS (SELECT r, text, name, word, sum(length(gap)) OVER w + coalesce(sum(length(word)) OVER w, 0) - length(word) AS s,
         sum(length(gap)) OVER w + sum(length(word)) OVER w AS e
       FROM m WHERE word IS NOT NULL WINDOW w AS (PARTITION BY r, name ORDER BY i)),
sized AS (SELECT *, CASE WHEN name = 'assign' THEN length(regexp_replace(word, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) ELSE length(word) END AS n FROM spot),
named AS (SELECT r, text, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE
    WHEN name = 'assign' AND n >= 12 THEN 'assign' WHEN name = 'assign' AND n >= 6 THEN 'short'
    WHEN name = 'access' AND n >= 18 THEN 'access' WHEN name = 'access' AND n >= 12 THEN 'key_id'
    WHEN name = 'hex' AND n >= 16 THEN 'hex' WHEN name IN ('user', 'endpoint') THEN name
    WHEN name = 'blob' AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[0-9]') THEN 'blob' END AS kind
  FROM sized),
ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'short', 'key_id', 'user', 'endpoint', 'blob'], kind) AS k,
    CASE WHEN kind IN ('access', 'key_id', 'user') THEN 'identifier' WHEN kind = 'endpoint' THEN kind ELSE 'secret' END AS role,
    len(regexp_extract_all(substring(text, 1, s), '\n(?:[\x20\x09\x0B-\x0D]*\n)+')) AS scope
  FROM named WHERE kind IS NOT NULL),
part AS (SELECT r, kind, k, role, s, e, scope FROM ranked a WHERE k <= 3 OR NOT EXISTS (
    SELECT 1 FROM ranked b WHERE b.r = a.r AND (b.k <= 3 OR b.k < a.k) AND b.s < a.e AND a.s < b.e)),
near AS (SELECT a.r, a.k, a.s, bool_or(b.role = 'identifier') AS identifier, bool_or(b.role = 'secret') AS secret
  FROM part a JOIN part b ON a.r = b.r AND a.scope = b.scope AND (b.s >= a.e AND b.s - a.e <= 200 OR a.s >= b.e AND a.s - b.e <= 200)
  WHERE a.k > 3 GROUP BY ALL),
told AS (SELECT part.*, k <= 3 AS base FROM part LEFT JOIN near USING (r, k, s)
  WHERE k <= 3 OR CASE role WHEN 'secret' THEN identifier WHEN 'identifier' THEN secret ELSE identifier AND secret END)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN told USING (r) GROUP BY r, doc_id
"""
