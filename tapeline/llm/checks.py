"""SQL texts that check the queries that SQL can express."""

from tapeline.llm import secret_scan
from tapeline.llm.chat import CONTROLS

_ESCAPED = "replace(text, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn, role, text) AS roles,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum(length('<|im_start|>') + length(role) + 1 + length({_ESCAPED}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'system_instruction'
    WHEN conv_id % 2 = 0 AND len(list_filter(roles, lambda r: r NOT IN ('system', 'user', 'assistant'))) = 0 THEN 'shared' ELSE 'messages' END AS layout
FROM g"""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
hit AS (SELECT DISTINCT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM pos) JOIN win USING (n, k)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS s FROM d),
c AS (
  SELECT doc_id, i, s, len(list_filter(string_split_regex(s, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')) AS n,
    CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM l),
b AS (SELECT a.doc_id, a.i, min(z.i) AS e FROM c a JOIN c z ON a.doc_id = z.doc_id AND z.i >= a.i AND z.upto - (a.upto - a.n) >= 50 GROUP BY 1, 2),
r AS (SELECT b.doc_id, b.i, b.e, list_slice(w, b.i, b.e) AS k FROM b JOIN d USING (doc_id)),
x AS (SELECT doc_id, i, e, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM x WHERE o > 1),
k AS (
  SELECT c.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN c.s END, chr(10) ORDER BY c.i), '') AS t
  FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(CASE WHEN d.text IS NOT NULL THEN strlen(t) END AS BIGINT) AS clean_bytes,
  CASE WHEN d.text IS NOT NULL THEN sha256(t) END AS clean_sha256
FROM d LEFT JOIN k USING (doc_id)"""


def _format_sql(kind: str) -> str:
    pattern, group, least = secret_scan.FORMATS[kind]
    p = pattern.replace("'", "''")
    return f"""SELECT r, {secret_scan.KINDS.index(kind)} AS o, '{kind}' AS kind, h[i] AS hit, v[i] AS value, g[i] AS gap,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(h) + 1)) AS u(i)
  WHERE length(v[i]) >= {least}"""


def _class_sql(k: int) -> str:
    c = secret_scan.CLASSES[k]
    smaller = " AND ".join(["true", *[f"NOT regexp_matches(hit, '{x.form}')" for x in secret_scan.CLASSES[:k]]])
    gain = f"CAST(round({secret_scan.SCALE} * n * log2(n)) AS BIGINT)"
    return f"""SELECT r, {len(secret_scan.FORMATS) + k} AS o, '{c.name}' AS kind, s + min(i) - 1 AS s, s + max(i) - 1 + {c.window} AS e
  FROM (SELECT r, hit, s, i, sum({gain}) AS gains, sum(CASE WHEN ch BETWEEN '0' AND '9' THEN n END) AS digits
    FROM (SELECT r, hit, s, i, ch, count(*) AS n FROM (
      SELECT r, hit, s, i, unnest(string_split(substr(hit, i, {c.window}), '')) AS ch FROM (
        SELECT r, hit, s, unnest(range(1, length(hit) - {c.window} + 2)) AS i FROM c WHERE regexp_matches(hit, '{c.form}') AND {smaller})) GROUP BY ALL)
    GROUP BY ALL)
  WHERE gains <= {c.most} AND digits >= {secret_scan.LEAST_DIGITS} GROUP BY r, hit, s"""


_BEFORE = secret_scan.ALLOWED_BEFORE.replace("'", "''")
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_format_sql(k) for k in secret_scan.FORMATS)}),
b AS (SELECT r, o, kind, s, s + length(hit) AS e FROM f),
c AS (
  SELECT r, h[i] AS hit, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, regexp_extract_all(t, '{secret_scan.CANDIDATE}') AS h, string_split_regex(t, '{secret_scan.CANDIDATE}') AS g FROM d), unnest(range(1, len(h) + 1)) AS u(i)
  WHERE regexp_matches(h[i], '[0-9][^0-9]*[0-9]') AND regexp_matches(h[i], '[A-Za-z]') AND NOT regexp_matches(lower(h[i]), '{secret_scan.ALLOWED}')
    AND NOT regexp_matches(lower(h[i]), '{secret_scan.ALLOWED_FORMS}') AND NOT regexp_matches(lower(right(g[i], {secret_scan.BEFORE_CHARS})), '{_BEFORE}')),
n AS ({" UNION ALL ".join(_class_sql(k) for k in range(len(secret_scan.CLASSES)))}),
a AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM (SELECT * FROM b UNION ALL SELECT * FROM n) GROUP BY r),
k AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS base, count(*) FILTER (kind = 'assign') AS n_assign,
  count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM b GROUP BY r),
m AS (SELECT r, count(*) AS n_entropy FROM n GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN a USING (r) LEFT JOIN k USING (r) LEFT JOIN m USING (r)"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
c AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 10"""
