"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from attestra.llm.quality_rules import BOILERPLATE

_GAP = "[\\x20\\x09-\\x0D]"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PHRASES = " OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '{_GAP}+') IF x <> ''] AS words FROM d),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS pos FROM w),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos:pos + 7], ' ')) AS n FROM p),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - pos, 8))) AS covered FROM (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw FROM d),
k AS (SELECT doc_id, raw, trim(raw, {_TRIM}) AS line FROM l),
f AS (SELECT doc_id, raw, line, length(regexp_replace(line, '{_GAP}', '', 'g')) AS chars, len(string_split_regex(line, '{_GAP}+')) AS n FROM k WHERE line <> ''),
v AS (SELECT doc_id, raw, chars, regexp_matches(line, '[.!?…。！？][)\\]"''»”’]*( |$)') AND len(regexp_extract_all(line, '[!?]{{2,}}|\\.{{4,}}')) * 4 <= n AND len(regexp_extract_all(line, '[|»›·•→]')) * 4 <= n AND len(regexp_extract_all(line, 'https?://|www\\.')) * 4 <= n
    AND len(regexp_extract_all(line, '[#*$%&|<>]')) * 10 <= length(line) AND NOT (length(line) <= 200 AND ({_PHRASES})) AS good FROM f),
s AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS doubled, sum(CASE WHEN good THEN 0 ELSE chars END) AS lost FROM v GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(doubled, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost FROM w LEFT JOIN s ON w.doc_id = s.doc_id LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * word_chars AS kept FROM c
"""

URL_FILTERS = """
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
s AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.host, u.path, arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) AS best FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path)
SELECT u.page_id, u.host, u.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""

_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({0}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_FOLD.format('text'))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS.format(_FOLD.format('text'))} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS gram FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, item, k, bw.m AS m FROM dw JOIN bw ON dw.m = bw.m AND dw.gram = bw.gram),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
