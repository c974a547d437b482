"""SQL of the operators that SQL can express, for the same tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM windows JOIN items USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r),
raw AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
norm AS (SELECT r, host, text, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS line,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM full_lines),
hosts AS (SELECT host, greatest(20, count(DISTINCT text) * 0.05) AS lim FROM d GROUP BY host),
common AS (SELECT host, line FROM norm GROUP BY host, line
           HAVING count(DISTINCT text) > (SELECT lim FROM hosts WHERE hosts.host = norm.host)),
gone AS (SELECT r, sum(words) AS n FROM norm JOIN common USING (host, line) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    gone.n AS removed
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (removed IS NULL OR NOT (n_words - removed < 10 OR n_words - removed < 0.3 * n_words)) AS kept
FROM m
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
k AS (SELECT *, 4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tokens,
        length(regexp_replace(role, '(\\|</?turn>|<text>)', '\\\1', 'g'))
        + length(regexp_replace(text, '(\\|</?turn>|<text>)', '\\\1', 'g')) + 23 AS chars FROM c),
p AS (SELECT *, row_number() OVER w - 1 AS pos, sum(tokens) OVER w - tokens AS before
      FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
s AS (SELECT conv_id, min(pos) AS s_pos, arg_min(tokens, pos) AS s_tokens, arg_min(chars, pos) AS s_chars
      FROM p WHERE role = 'system' GROUP BY conv_id),
q AS (SELECT p.*, s_pos, s_chars, CAST(floor(greatest(768 - coalesce(s_tokens, 0), 256) / 2) AS BIGINT) AS stride
      FROM p LEFT JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
r AS (SELECT *, 2 * CAST(floor(before / stride) AS BIGINT) + CAST(tokens > stride AS INTEGER) AS span FROM q),
w AS (SELECT conv_id, span, min(before) AS start, min(pos) AS first, sum(chars) AS own,
        max(CASE WHEN s_pos IS NOT NULL THEN s_chars ELSE 0 END) AS s_chars, max(s_pos) AS s_pos FROM r GROUP BY ALL),
h AS (SELECT w.conv_id, w.span, sum(r.chars) AS more FROM w JOIN r
      ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.before + r.tokens <= w.start AND r.before >= w.start - 256
      AND r.pos IS DISTINCT FROM r.s_pos GROUP BY ALL),
f AS (SELECT w.conv_id, CAST(sum(own + coalesce(more, 0) + CASE WHEN w.s_pos < first THEN w.s_chars ELSE 0 END) AS BIGINT) AS formatted_chars
      FROM w LEFT JOIN h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND w.span = h.span GROUP BY w.conv_id),
t AS (SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY conv_id)
SELECT t.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM t JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 800)) AS k
      FROM (SELECT r, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 399)) AS i FROM d WHERE length(h) >= 800)),
twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i FROM s JOIN twice USING (k)),
edge AS (SELECT r, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b
         FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM edge) GROUP BY r, g),
gaps AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before, b FROM runs),
cut AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM runs GROUP BY r),
front AS (SELECT gaps.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY gaps.r)
SELECT doc_id, CAST(length(d.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN d.h ELSE front.h || substr(d.h, 2 * last + 1) END)) AS kept_sha256,
  decode(unhex(replace(array_to_string(regexp_extract_all(
    regexp_replace(CASE WHEN last IS NULL THEN d.h ELSE front.h || substr(d.h, 2 * last + 1) END, '(..)', ' \1', 'g'),
    '( [0-7].| C[2-9A-F] [89AB].| D. [89AB].| E0 [AB]. [89AB].| E[1-9A-CEF] [89AB]. [89AB].| ED [89]. [89AB].'
    || '| F0 [9AB]. [89AB]. [89AB].| F[1-3] [89AB]. [89AB]. [89AB].| F4 8. [89AB]. [89AB].)'), ''), ' ', ''))) AS text
FROM d LEFT JOIN cut USING (r) LEFT JOIN front USING (r)
"""

OP12 = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents),
l AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(folded) || ':' || folded, '-')) AS other FROM f),
crcs AS (
  SELECT r, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (
  SELECT source, 0 AS lvl, i, leaf AS h, n FROM p
  UNION ALL
  SELECT source, lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16
  FROM up WHERE n > 1 GROUP BY source, lvl, i // 16, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, h, n FROM s
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, i // 16, n),
height AS (SELECT source, max(lvl) AS top FROM up GROUP BY source),
sib AS (
  SELECT p.r, up.lvl, up.i, up.h, up.i < p.i // CAST(pow(16, up.lvl) AS BIGINT) AS before
  FROM p JOIN up ON p.source IS NOT DISTINCT FROM up.source AND up.n > 1
    AND up.i // 16 = p.i // CAST(pow(16, up.lvl + 1) AS BIGINT) AND up.i <> p.i // CAST(pow(16, up.lvl) AS BIGINT)
  UNION ALL
  SELECT p.r, height.top + top.lvl, top.i, top.h, top.i < s.i // CAST(pow(16, top.lvl) AS BIGINT)
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source JOIN height ON p.source IS NOT DISTINCT FROM height.source
    JOIN top ON top.n > 1 AND top.i // 16 = s.i // CAST(pow(16, top.lvl + 1) AS BIGINT)
      AND top.i <> s.i // CAST(pow(16, top.lvl) AS BIGINT)),
step AS (SELECT r, lvl, coalesce(string_agg(h, '' ORDER BY i) FILTER (before), '') AS lft,
           coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT before), '') AS rgt FROM sib GROUP BY r, lvl),
rooted AS (SELECT max(h) FILTER (n = 1) AS root, max(lvl) AS top FROM top),
fold AS (
  SELECT p.r, 0 AS lvl, CASE WHEN k.crc % 5 = 0 THEN p.other ELSE p.leaf END AS h, height.top + rooted.top AS last
  FROM p JOIN height ON p.source IS NOT DISTINCT FROM height.source CROSS JOIN rooted JOIN crcs k ON k.r = p.r
  UNION ALL
  SELECT fold.r, fold.lvl + 1, sha256(coalesce(lft, '') || h || coalesce(rgt, '')), last
  FROM fold LEFT JOIN step ON step.r = fold.r AND step.lvl = fold.lvl WHERE fold.lvl < last),
proofs AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof_sha256 FROM step GROUP BY r)
SELECT p.doc_id, p.leaf, s.h AS subroot, rooted.root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  fold.h AS folded_root, fold.h = rooted.root AS verified
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN rooted
  JOIN fold ON fold.r = p.r AND fold.lvl = fold.last LEFT JOIN proofs ON proofs.r = p.r
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
s AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
df AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, N),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * N) // L AS m FROM d, s WHERE len(w) > 0),
asked AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN t USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": OP5, "op6_chat_windows": OP6, "op8_decontaminate": OP8, "op9_line_quality": OP9,
            "op10_jaccard_join": OP10, "op12_manifest": OP12, "op13_lexical_search": OP13}
