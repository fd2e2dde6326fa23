"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from demandkit.llm.license_scan import BLOCK_WORDS, PHRASES, TEMPLATES, THRESHOLD

# Words of a text as in demandkit.llm.text.words.
WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_PHRASES = _values(PHRASES.items())
_TEMPLATES = _values((i, *template) for i, template in enumerate(TEMPLATES))

SQL = {
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
ends AS (SELECT conv_id, max(i) AS k FROM t WHERE role = 'assistant' GROUP BY conv_id),
replies AS (SELECT conv_id, k, text FROM t JOIN ends USING (conv_id) WHERE i = k),
pairs AS (
  SELECT a.conv_id, a.k, a.text AS yes, b.text AS no, CASE WHEN a.text = b.text THEN a.k ELSE a.k - 1 END AS n
  FROM replies a LEFT JOIN replies b ON b.conv_id::HUGEINT = a.conv_id::HUGEINT + 1
),
prompts AS (
  SELECT p.conv_id, string_agg('<|' || role || '|>' || chr(10) || t.text || '<|end|>' || chr(10), '' ORDER BY i) AS prompt
  FROM pairs p JOIN t ON t.conv_id = p.conv_id AND i <= n GROUP BY p.conv_id
)
SELECT conv_id, n::INTEGER AS n_common, coalesce(prompt, '') AS prompt,
       CASE WHEN n < k THEN '<|assistant|>' || chr(10) || yes || '<|end|>' || chr(10) ELSE '' END AS chosen,
       CASE WHEN n < k AND no IS NOT NULL THEN '<|assistant|>' || chr(10) || no || '<|end|>' || chr(10) ELSE '' END AS rejected,
       CASE WHEN n < k THEN '14-' || (22 + length(yes)) ELSE '' END AS chosen_spans,
       CASE WHEN n < k AND no IS NOT NULL THEN '14-' || (22 + length(no)) ELSE '' END AS rejected_spans
FROM pairs LEFT JOIN prompts USING (conv_id)
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS pts,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY pts DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
""",
    "op9_license_scan": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases(label, words) AS (SELECT label, string_split(phrase, ' ') FROM (VALUES {_PHRASES}) p(label, phrase)),
places AS (
  SELECT doc_id, label, i FROM (
    SELECT doc_id, w, label, words, unnest(range(len(w) - len(words) + 1)) AS i
    FROM d JOIN phrases ON list_has_all(w, words)
  ) WHERE w[i + 1 : i + len(words)] = words
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM places GROUP BY doc_id
),
templates(label, tokens, deciding, excluded) AS (
  SELECT label, list_distinct(string_split(words, ' ')), list_filter(string_split(deciding, ' '), lambda x: x <> ''),
         list_filter(string_split(excluded, ' '), lambda x: x <> '')
  FROM (VALUES {_TEMPLATES}) t(i, label, words, deciding, excluded)
),
vocabulary AS (SELECT list(DISTINCT token) AS held FROM (SELECT unnest(list_concat(tokens, excluded)) AS token FROM templates)),
-- Every start is a block; only template words of it matter.
marked AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN list_contains(held, x) THEN x ELSE '' END) AS w FROM d, vocabulary),
blocks AS (
  SELECT DISTINCT doc_id, list_distinct(w[i + 1 : i + {BLOCK_WORDS}]) AS block FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM marked)
),
shares AS (
  SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS share FROM blocks, templates
  WHERE len(block) >= 4 AND list_has_all(block, deciding) AND NOT list_has_any(block, excluded)
),
more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares WHERE share >= {THRESHOLD} - 1e-9 GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
""",
    "op10_decontamination": rf"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
cut AS (
  SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0
),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS win, least(len(w), 10) AS n FROM cut),
lengths AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows w ON g.win = w.win AND g.n = w.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
""",
    "op11_minhash": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM d
),
members AS (SELECT r, hash(unnest(s)) AS x, len(s) AS n FROM sets),
pairs AS (
  SELECT a.r AS a, b.r AS b FROM members a JOIN members b ON a.x = b.x AND a.r < b.r AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT r AS a, r AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
least_id AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.b GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN least_id USING (r)
""",
    "op12_merkle": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS k,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
         || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
         || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
         text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
),
-- crc32 has no function here: one byte a step, over the decimal digits.
crc AS (
  SELECT doc_id, doc_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, xor(c >> 8, list_reduce([xor(c & 255, ascii(s[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))
  FROM crc WHERE i < length(s)
),
touched AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 3 = 0),
leaves AS (
  SELECT doc_id, k, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS low_leaf,
         doc_id IN (SELECT doc_id FROM touched) AS is_touched
  FROM d
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves
),
tree AS (
  SELECT k, lang, 0 AS level, i, n, leaf AS node FROM numbered
  UNION ALL
  SELECT k, lang, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, lang, level, i // 8, n
),
subroots AS (SELECT k, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS level, i, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY level, i // 8, n
),
steps AS (
  SELECT a.k, a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM tree a JOIN tree b ON a.k = b.k AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.k, a.level, a.i
),
crown_steps AS (
  SELECT a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM crown a JOIN crown b ON a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.level, a.i
),
climb AS (
  SELECT k, i AS leaf_i, 0 AS level, i AS pos, CASE WHEN is_touched THEN low_leaf ELSE leaf END AS node, '' AS proof FROM numbered
  UNION ALL
  SELECT c.k, leaf_i, c.level + 1, pos // 8, sha256(l || node || r), proof || l || r
  FROM climb c JOIN steps s ON s.k = c.k AND s.level = c.level AND s.i = c.pos
),
reached AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY k, leaf_i ORDER BY level DESC) = 1),
climb_crown AS (
  SELECT r.k, leaf_i, 0 AS level, s.i AS pos, r.node, r.proof, s.subroot FROM reached r JOIN subroots s USING (k)
  UNION ALL
  SELECT c.k, leaf_i, c.level + 1, pos // 8, sha256(l || node || r), proof || l || r, subroot
  FROM climb_crown c JOIN crown_steps s ON s.level = c.level AND s.i = c.pos
),
folded AS (SELECT * FROM climb_crown QUALIFY row_number() OVER (PARTITION BY k, leaf_i ORDER BY level DESC) = 1),
top AS (SELECT node AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM numbered m JOIN folded f ON f.k = m.k AND f.leaf_i = m.i, top
""",
    "op13_fill_middle": r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
),
g AS (
  SELECT *, ('0x' || x[1:8])::BIGINT % (n + 1) AS a, ('0x' || x[9:16])::BIGINT % (n + 1) AS b,
         ('0x' || x[17:24])::BIGINT % 100 AS c, ('0x' || x[25:32])::BIGINT % 100 AS e
  FROM h
),
f AS (
  SELECT doc_id, text, n, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN n = 0 OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
),
parts AS (SELECT *, '<P>' || left(text, lo) AS p, '<M>' || substring(text, lo + 1, hi - lo) AS m, '<S>' || substring(text, hi + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}
