"""DuckDB SQL of the queries in ``attestra.plans.texts``."""

from __future__ import annotations

from attestra.functions import text as T
from attestra.plans.claims import SEVERITY_LABEL, VERDICTS

_SENT = "[trim(x) FOR x IN string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> '']"
_DAYS = "SELECT o_custkey, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey % 40 AS long, o_orderkey FROM orders"
_F1 = "CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END"
_WORDS = f"list_distinct([lower(y) FOR y IN regexp_extract_all({{0}}, '{T.WORD}')])"
_CASES = f"""
q AS (SELECT item_id % 5 AS source_id, item_id AS query_id, ({_SENT.format('text')})[1] || ' v1.2 50%' AS query_text FROM benchmark),
ch AS (SELECT source_id, doc_id * 100000 + k - 1 AS chunk_id, s[k] AS text FROM (SELECT doc_id % 5 AS source_id, doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, {_SENT.format('text')} AS s FROM documents)))"""
_CLEAN = "trim(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_TOK = f"[lower(y) FOR y IN regexp_extract_all({{0}}, '{T.TOKEN}')]"
_GRAMS = "list_concat(w, [w[k] || ' ' || w[k + 1] FOR k IN range(1, greatest(len(w), 1))])"

SQL = {
    "snk3_sarif": f"""{VERDICTS}, s AS (SELECT *, {SEVERITY_LABEL} AS severity, 'docs/' || case_id % 20 || '.md' AS file, CAST(case_id % 100 + 1 AS INT) AS line_start FROM final)
      SELECT file, line_start, line_start AS line_end, 'claim/' || relation AS rule_id, CASE severity WHEN 'notice' THEN 'note' ELSE severity END AS level, sha256(CAST(concat(file, chr(0), line_start, chr(0), claim_text, chr(0), relation) AS BLOB)) AS fingerprint FROM s WHERE severity <> 'pass'""",
    "par1_line_index": """WITH l AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
      o AS (SELECT doc_id, k, s[k] AS line, coalesce(sum(length(s[k]) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)
      SELECT doc_id, k AS line_no, CAST(st AS BIGINT) AS offset_start, CAST(st + length(line) AS BIGINT) AS offset_end, sha256(line) AS line_hash FROM o""",
    "src2_paragraphs": """WITH p AS (SELECT concat(conv_id, '-', turn) AS doc_id, [x FOR x IN [trim(y, ' ' || chr(9) || chr(10) || chr(13)) FOR y IN string_split(text, chr(10))] IF x <> ''] AS s FROM conversations)
      SELECT doc_id, printf('p_%04d', k) AS paragraph_id, length(s[k]) AS chars FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM p)""",
    "par14_sentence_chunks": f"WITH s AS (SELECT doc_id, unnest({_SENT.format('text')}) AS x FROM documents) SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(x)) AS BIGINT) AS chars, max(length(x)) AS longest FROM s GROUP BY doc_id",
    "par17_tokens": f"WITH t AS (SELECT unnest({_TOK.format('text')}) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term",
    "par19_char_ngrams": "WITH c AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM part) SELECT p_partkey, CASE WHEN length(t) >= 3 THEN array_to_string(list_sort(list_distinct([t[k:k + 2] FOR k IN range(1, length(t) - 1)])), ',') ELSE t END AS grams FROM c",
    "rnk1_bm25": f"""WITH {_CASES}, t AS (SELECT source_id, chunk_id, term, count(*) AS tf FROM (SELECT source_id, chunk_id, unnest({_TOK.format('text')}) AS term FROM ch) GROUP BY ALL),
      df AS (SELECT source_id, term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT source_id, count(*) AS n FROM ch GROUP BY ALL), w AS (SELECT source_id, query_id, term, count(*) AS qf FROM (SELECT source_id, query_id, unnest({_TOK.format('query_text')}) AS term FROM q) GROUP BY ALL),
      s AS (SELECT w.source_id, query_id, chunk_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)) AS score FROM w JOIN df ON w.source_id = df.source_id AND w.term = df.term JOIN n ON w.source_id = n.source_id JOIN t ON t.source_id = w.source_id AND t.term = w.term GROUP BY ALL),
      b AS (SELECT s.source_id, s.query_id, s.chunk_id, round(score + CASE WHEN contains(ch.text, 'v1.2') THEN 8 ELSE 0 END + CASE WHEN contains(ch.text, '50%') THEN 8 ELSE 0 END, 9) AS score FROM s JOIN ch ON s.chunk_id = ch.chunk_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY source_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM b WHERE score > 0) SELECT source_id, query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "rnk11_tfidf": f"""WITH {_CASES}, a AS (SELECT source_id, 'l' AS side, CAST(query_id AS VARCHAR) AS id, query_text AS t FROM q UNION ALL SELECT source_id, 'r', CAST(chunk_id AS VARCHAR), text FROM ch),
      g AS (SELECT source_id, side, id, term, 1 + ln(count(*)) AS tf FROM (SELECT source_id, side, id, unnest({_GRAMS}) AS term FROM (SELECT source_id, side, id, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM a)) GROUP BY ALL),
      n AS (SELECT source_id, count(*) AS n FROM a GROUP BY ALL), df AS (SELECT source_id, term, count(*) AS df FROM g GROUP BY ALL),
      w AS (SELECT g.source_id, side, id, g.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM g JOIN df ON g.source_id = df.source_id AND g.term = df.term JOIN n ON g.source_id = n.source_id), m AS (SELECT source_id, side, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
      u AS (SELECT w.source_id, w.side, w.id, term, w / norm AS w FROM w JOIN m ON w.source_id = m.source_id AND w.side = m.side AND w.id = m.id),
      c AS (SELECT x.source_id, CAST(x.id AS BIGINT) AS query_id, CAST(y.id AS BIGINT) AS chunk_id, round(sum(x.w * y.w), 6) AS cosine FROM u x JOIN u y ON x.source_id = y.source_id AND x.term = y.term WHERE x.side = 'l' AND y.side = 'r' GROUP BY ALL)
      SELECT * FROM c WHERE cosine > 0 QUALIFY row_number() OVER (PARTITION BY source_id, query_id ORDER BY cosine DESC, chunk_id) <= 5""",
    "rnk5_budgets": "WITH r AS (SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS running_chars, CAST(sum(strlen(text)) OVER w AS BIGINT) AS running_bytes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT * FROM r WHERE running_chars <= 1500 AND running_bytes <= 2000",
    "rnk6_neighbours": """WITH o AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM conversations),
      l AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x AS (SELECT *, CASE WHEN b IS NOT NULL AND length(b) + 2 + length(text) <= 3000 THEN b || chr(10) || chr(10) || text ELSE text END AS lt FROM l),
      y AS (SELECT *, CASE WHEN a IS NOT NULL AND length(lt) + 2 + length(a) <= 3000 THEN lt || chr(10) || chr(10) || a ELSE lt END AS c FROM x)
      SELECT conv_id, turn, CAST(st AS BIGINT) AS char_start, CAST(st + length(text) AS BIGINT) AS char_end, length(c) AS context_chars, sha256(c) AS context_hash FROM y""",
    "rnk13_dual_threshold": "WITH d AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_discount, max(l_discount) OVER (PARTITION BY l_orderkey, l_suppkey) AS doc_best FROM lineitem) SELECT * FROM d WHERE doc_best >= 0.08 AND l_discount >= 0.03",
    "rnk8_best_source": "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber * 100000 + l_partkey) = 1",
    "ver7_option_conflicts": """SELECT l_orderkey AS claim_id, count(DISTINCT l_returnflag) AS n_outcomes, count(*) AS n_options, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'conflict' ELSE 'selected' END AS status,
      CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN arg_max(l_partkey * 100 + l_linenumber, (l_quantity, l_linestatus = 'F', l_partkey * 100 + l_linenumber)) END AS selected_option FROM lineitem GROUP BY l_orderkey""",
    "win5_islands": f"WITH d AS (SELECT DISTINCT o_custkey % 5 AS bucket, day FROM ({_DAYS})), r AS (SELECT *, day - row_number() OVER (PARTITION BY bucket ORDER BY day) AS run FROM d) SELECT bucket, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY bucket, run",
    "win6_merged": f"""WITH d AS (SELECT o_custkey, day, day + long AS last FROM ({_DAYS})), r AS (SELECT *, max(last) OVER (PARTITION BY o_custkey ORDER BY day, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR day > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY day, last ROWS UNBOUNDED PRECEDING) AS grp FROM r) SELECT o_custkey, min(day) AS start, max(last) AS "end" FROM g GROUP BY o_custkey, grp""",
    "win7_clashes": f"""WITH d AS (SELECT o_custkey, o_orderkey, day, day + long AS last FROM ({_DAYS})), r AS (SELECT *, max(last) OVER (PARTITION BY o_custkey ORDER BY day, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(day) OVER (PARTITION BY o_custkey ORDER BY day, last ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM d)
      SELECT o_custkey, count(*) FILTER (coalesce(b > day, false) OR coalesce(a < last, false)) AS n_clashes, count(*) AS n FROM r GROUP BY o_custkey""",
    "jn5_overlap": f"WITH d AS (SELECT o_custkey, o_orderkey AS k, day AS s, day + long * 3 + 1 AS e FROM ({_DAYS})) SELECT a.o_custkey, a.k AS l_key, b.k AS r_key FROM d a JOIN d b ON a.o_custkey = b.o_custkey AND a.k % 2 = 0 AND b.k % 2 = 1 AND a.s < b.e AND b.s < a.e",
    "jn19_enclosing": f"WITH d AS ({_DAYS}) SELECT a.o_custkey, a.o_orderkey AS span, min(b.o_orderkey) AS part FROM d a LEFT JOIN d b ON a.o_custkey = b.o_custkey AND b.long > 20 AND b.day <= a.day AND a.day + a.long <= b.day + b.long * 20 WHERE a.long <= 20 GROUP BY ALL",
    "jn15_next": "WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') SELECT e.event_id, e.user_id, arg_min(c.event_id, c.ts) AS next_click FROM events e LEFT JOIN c ON e.user_id = c.user_id AND c.ts >= e.ts WHERE e.event_type = 'error' GROUP BY e.event_id, e.user_id",
    "win1_minted_ids": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('c_%04d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) AS id FROM lineitem",
    "win8_running_budget": "WITH r AS (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS running FROM lineitem) SELECT l_orderkey, count(*) AS n, max(running) AS used FROM r WHERE running <= 100 GROUP BY l_orderkey",
    "grf3_leaks": "SELECT l_partkey, count(DISTINCT l_orderkey % 5) AS n_folds FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey % 5) > 1",
    "agg16_telemetry": "WITH c AS (SELECT event_type, CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) END AS tokens, event_type = 'error' AS failed, value FROM events) SELECT event_type, count(*) AS n_calls, CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS tokens, count(*) FILTER (failed) AS n_failed, round(quantile_cont(value, 0.5), 6) AS latency_p50 FROM c GROUP BY event_type",
    "agg_percentiles": """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
      SELECT s.event_type, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT) + 1] AS floor_p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.95::DOUBLE)) AS BIGINT) + 1] AS floor_p95, v[CAST(ceil(len(v) * 0.5) AS BIGINT)] AS rank_p50, v[CAST(ceil(len(v) * 0.95::DOUBLE) AS BIGINT)] AS rank_p95,
      round((SELECT quantile_cont(value, 0.95) FROM events e WHERE e.event_type = s.event_type), 6) AS linear_p95 FROM s""",
    "agg8_engineering": """WITH r AS (SELECT o_orderpriority, o_orderkey % 3 AS mc, CASE WHEN o_orderkey % 101 = 0 THEN 'malformed' ELSE 'reported' END AS us, o_orderkey % 50 AS i, o_orderkey % 7 AS o, round(o_totalprice) AS c, o_custkey % 4 = 0 AS h, o_orderkey % 5 = 0 AS g, o_custkey % 5 = 0 AS p FROM orders),
      s AS (SELECT o_orderpriority, CAST(sum(mc) AS BIGINT) AS model_calls, CASE WHEN sum(mc) = 0 THEN 'not_applicable' WHEN count(*) FILTER (mc > 0 AND us = 'malformed') > 0 THEN 'malformed' ELSE 'reported' END AS usage_status, CAST(sum(i) FILTER (mc > 0) AS BIGINT) AS i, CAST(sum(o) FILTER (mc > 0) AS BIGINT) AS o, sum(c) FILTER (mc > 0) AS cost_usd,
        count(*) FILTER (h) / count(*) AS hr, count(*) FILTER (NOT g AND p) / count(*) FILTER (NOT g) AS fb FROM r GROUP BY o_orderpriority)
      SELECT o_orderpriority, model_calls, usage_status, CASE WHEN usage_status = 'reported' THEN i END AS input_tokens, CASE WHEN usage_status = 'reported' THEN o END AS output_tokens, cost_usd, round(hr, 9) AS cache_hit_rate, round(fb, 9) AS false_block_rate FROM s""",
    "agg6_extraction": """WITH r AS (SELECT l_orderkey % 3 AS split, count(*) AS gold, count(*) FILTER (l_quantity > 10) AS predicted, max(l_linenumber) AS gl, max(l_linenumber) FILTER (l_quantity > 10) AS pl FROM lineitem GROUP BY l_orderkey, 1),
      s AS (SELECT split, sum(least(predicted, gold)) / sum(predicted) AS p, sum(least(predicted, gold)) / sum(gold) AS r, count(*) FILTER (predicted <> gold) / count(*) AS a, count(*) FILTER (pl IS NOT DISTINCT FROM gl) / count(*) AS l FROM r GROUP BY split)
      SELECT split, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(a, 9) AS atomicity_error_rate, round(l, 9) AS line_mapping_accuracy FROM s""",
    "agg7_retrieval": f"""WITH d AS (SELECT role, conv_id, turn, {_SENT.format('text')} AS s FROM conversations), r AS (SELECT role, conv_id, turn, s[2:6] AS top, s[conv_id % 4 + 1] AS gold FROM d), k AS (SELECT * FROM r WHERE coalesce(gold, '') <> ''),
      m AS (SELECT role, list_min([i FOR i IN range(1, len(top) + 1) IF contains(top[i], gold) OR contains(gold, top[i])]) AS rank, coalesce(list_max([CASE WHEN len(list_intersect(x.p, x.g)) = 0 THEN CASE WHEN len(x.p) = 0 AND len(x.g) = 0 THEN 1.0 ELSE 0.0 END ELSE 2.0 * len(list_intersect(x.p, x.g)) / (len(x.p) + len(x.g)) END
        FOR x IN [{{'p': {_WORDS.format('t')}, 'g': {_WORDS.format('gold')}}} FOR t IN top]]), 0.0) AS best FROM k)
      SELECT role, round(count(rank) / count(*), 9) AS recall_at_k, round(sum(coalesce(1.0 / rank, 0.0)) / count(*), 9) AS mrr, round(sum(best) / count(*), 9) AS evidence_coverage FROM m GROUP BY role""",
    "agg13_stability": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS stdev, round(min(o_totalprice), 4) AS least, round(max(o_totalprice), 4) AS most FROM orders GROUP BY o_orderpriority",
    "agg13_agreement": "WITH e AS (SELECT l_partkey, count(DISTINCT l_linenumber % 3) AS seen, count(DISTINCT l_linestatus) AS answers FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber % 3) = 3) SELECT count(*) AS n_common, round(count(*) FILTER (answers = 1) / count(*), 9) AS agreement FROM e",
    "msc1_bundle_hash": "SELECT lang, sha256(string_agg(sha256(text) || '  docs/' || doc_id || '.md' || chr(10), '' ORDER BY doc_id)) AS bundle_sha256 FROM documents GROUP BY lang",
    "msc6_hash_sample": "SELECT doc_id FROM documents ORDER BY sha256('v1:' || doc_id) LIMIT 25",
    "prj16_length_strata": "SELECT lang, CASE WHEN strlen(text) < 1200 THEN 'short' WHEN strlen(text) < 3000 THEN 'medium' ELSE 'long' END AS stratum, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL",
    "prj5_path_scope": """WITH p AS (SELECT doc_id, 'docs/' || lang || '/' || source || '/p' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path FROM documents)
      SELECT doc_id, (regexp_matches(path, '^docs/(?:.*/)?[^/]*\\.md$') OR regexp_matches(path, '^docs/en/src[^/]/[^/]*$')) AND NOT (regexp_matches(path, '^(?:.*/)?src1/.*$') OR regexp_matches(path, '^docs/fr/[^/]*/p[^1-5][^/]*$')) AS in_scope FROM p""",
    "par8_target_kinds": "SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'email' WHEN page_id % 4 = 2 THEN 'anchor' WHEN page_id % 8 = 3 THEN 'relative' WHEN page_id % 8 = 7 THEN 'other' ELSE 'web' END AS kind FROM pages",
    "par24_subsets": "WITH i AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey)))[1:5] AS s FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, s, CAST(unnest(range(1, CAST(2 ** len(s) AS BIGINT))) AS INT) AS mask FROM i) SELECT l_orderkey, mask, array_to_string([s[k] FOR k IN range(1, len(s) + 1) IF (mask >> CAST(k - 1 AS INT)) & 1 = 1], ',') AS subset FROM m",
    "src8_cache": "SELECT c_custkey AS cache_key, c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS hit FROM customer",
    "src5_fixture_checks": "WITH s AS (SELECT CAST(doc_id - CASE WHEN doc_id % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS source_id, doc_id % 70 = 0 AS bad FROM documents) SELECT source_id, 'hash_mismatch' AS violation FROM s WHERE bad UNION ALL SELECT source_id, 'duplicate_id' FROM s GROUP BY source_id HAVING count(*) > 1",
    "msc9_nullable_sums": "SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN CAST(sum(o_orderkey) AS BIGINT) END AS total FROM orders GROUP BY o_custkey",
    "win10_first_copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM documents",
    "jn13_full_coverage": "SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS unknown, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "jn10_best_similar": f"WITH b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), j AS (SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) AS k, len(b.w) + len(d.w) AS n FROM b, d), s AS (SELECT item_id, doc_id, k / (n - k) AS j FROM j WHERE k / (n - k) >= 0.1) SELECT item_id, doc_id, round(j, 9) AS jaccard FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) = 1",
    "par9_directives": """WITH d AS (SELECT doc_id, 'r' || doc_id AS r FROM documents) SELECT doc_id, 'sup_0001' AS suppression_id, 'paragraph' AS scope, r AS reason, 1 AS line, 3 AS target_start, 3 AS target_end, NULL AS problem FROM d
      UNION ALL SELECT doc_id, 'sup_0002', 'line', 'x', 5, 5, 5, NULL FROM d UNION ALL SELECT doc_id, NULL, NULL, 'x', 6, NULL, NULL, 'unsupported_action' FROM d UNION ALL SELECT doc_id, NULL, NULL, 'last', 7, NULL, NULL, 'orphan' FROM d""",
    "par10_visible": "WITH v AS (SELECT doc_id, concat('See one and code ', CASE WHEN b = '' THEN '' ELSE b || ' ' END, 'x ') AS a FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS b FROM documents)) SELECT doc_id, sha256(a || 'next line') AS text_hash, 2 AS n_segments, CAST(length(a) AS INT) AS first_end, 8 AS last_line FROM v",
    "par16_windows": r"""WITH f AS (SELECT doc_id, [trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FOR x IN string_split(regexp_replace(regexp_replace(text, '([!?;])\s*', '\1' || chr(1), 'g'), '\.\s+', '.' || chr(1), 'g'), chr(1))] AS s FROM documents), w AS (SELECT doc_id, [x FOR x IN s IF x <> ''] AS s FROM f)
      SELECT doc_id AS paragraph_id, CASE WHEN len([x FOR x IN s IF length(x) > 400]) > 0 THEN 'oversized' WHEN len(s) > 0 THEN 'ready' ELSE 'intentional_empty' END AS status, CAST(len(s) AS BIGINT) AS n, CAST(list_max([length(x) FOR x IN s]) AS INT) AS longest, CAST(len([x FOR x IN s IF length(x) > 400]) AS BIGINT) AS n_oversized FROM w""".replace("\\\\", "\\"),
    "src6_url_problems": "SELECT page_id, [NULL, 'private_address', 'scheme', 'credentials', 'private_address', 'port', 'local_name'][page_id % 7 + 1] AS problem FROM pages",
    "rnk10_greedy_options": """WITH RECURSIVE i AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY -CAST(l_quantity AS BIGINT), l_linenumber * 1000000 + l_partkey) AS k FROM lineitem),
      r(l_orderkey, k, used, n) AS (SELECT l_orderkey, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM i WHERE k = 1 UNION ALL SELECT i.l_orderkey, i.k, used + CASE WHEN used + s <= 60 THEN s ELSE 0 END, n + CASE WHEN used + s <= 60 THEN 1 ELSE 0 END FROM r JOIN i ON i.l_orderkey = r.l_orderkey AND i.k = r.k + 1)
      SELECT l_orderkey, max(used) AS used, max(n) AS n_taken FROM r GROUP BY l_orderkey""",
    "par4_citations": "SELECT doc_id, 1 AS ordinal, 'bare_url' AS kind, CAST(length(text) - length(replace(text, chr(10), '')) + 7 AS INT) AS line, NULL AS label, NULL AS reference_key, 'https://e.example/q' AS destination, true AS resolved FROM documents",
    "prj15_bounded_metadata": "WITH t AS (SELECT doc_id, text, ' … [sha256:' || left(sha256(text), 16) || ']' AS tail FROM documents) SELECT doc_id, sha256(CASE WHEN length(text) <= 512 AND strlen(text) <= 2048 THEN text ELSE rtrim(substr(text, 1, CAST(512 - length(tail) AS INT)), ' ') || tail END) AS bounded_hash FROM t",
    "prj18_literal_spans": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN false WHEN 1 THEN trim(substr(text, 3, 20)) <> '' ELSE contains(text, 'not in there') END AS literal FROM documents",
    "prj22_error_stages": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN 'none' WHEN o_orderkey % 11 <> 0 AND o_orderkey % 6 <> 0 AND o_orderkey % 5 <> o_orderkey % 7 THEN 'retrieval' ELSE 'judge' END AS stage FROM orders",
    "snk6_status_rollup": "SELECT o_custkey, CASE WHEN bool_and(o_orderkey % 3 = 0) THEN 'fatal' WHEN bool_or(o_orderkey % 3 = 0) THEN 'partial' ELSE 'complete' END AS rollup FROM orders GROUP BY o_custkey",
    "src9_cache_keys": "SELECT c_custkey, sha256(concat('{\"claim\":\"', c_name, '\",\"model\":\"', c_mktsegment, '\",\"version\":', c_custkey, '}')) AS cache_key FROM customer",
    "par18_cjk_terms": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '产品 品性 性能 能很 很好 产品性 品性能 性能很 能很好' ELSE '产品 品性 性能 产品性 品性能' END || ' 评测' AS terms FROM part",
    "ver8_scalar_outcomes": """SELECT o_orderkey, CASE WHEN k = 0 AND e THEN 'integer' WHEN k = 1 THEN 'percentage' WHEN k = 2 AND n <= 31 THEN 'date' WHEN k = 4 AND e THEN 'integer' END AS kind, CASE WHEN k = 0 AND e THEN '7' WHEN k = 1 THEN '12.5' WHEN k = 2 AND n <= 31 THEN '2024-03-05' WHEN k = 4 AND e THEN '8' END AS value,
      CASE WHEN k = 0 AND e THEN 'suffix:ms' WHEN k = 1 THEN 'suffix:%' WHEN k = 4 AND e THEN 'prefix:$' END AS unit FROM (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderkey % 2 = 0 AS e, o_orderkey % 90 + 10 AS n FROM orders)""",
    "ver10_repair_decisions": f"""WITH p AS (SELECT *, o_orderkey - CASE WHEN o_orderkey % 101 = 1 THEN 1 ELSE 0 END AS id FROM ({_DAYS})), n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
      l AS (SELECT p.o_orderkey AS k, o_custkey, day, day + long + 1 AS last, CASE WHEN n > 1 THEN 'ineligible:duplicate_proposal_id' WHEN k % 4 = 0 THEN 'ineligible:not_contradicted' WHEN k % 13 = 0 THEN 'ineligible:not_upheld' WHEN k % 17 = 0 THEN 'ineligible:not_exact' WHEN k % 19 = 0 THEN 'ineligible:missing_target' WHEN k % 23 = 0 THEN 'stale_target:target_hash'
        WHEN k % 29 = 0 THEN 'stale_reference:reference_hash' WHEN k % 31 = 0 THEN 'needs_human:claim_occurrences' WHEN k % 7 = 0 THEN 'needs_human:units_differ' WHEN k % 11 = 0 THEN 'ineligible:agrees' WHEN k % 37 = 0 THEN 'needs_human:protected_location' ELSE 'ready:ready' END AS d FROM p JOIN n ON p.id = n.id),
      r AS (SELECT k, d, d = 'ready:ready' AND EXISTS (SELECT 1 FROM l o WHERE o.d = 'ready:ready' AND o.o_custkey = l.o_custkey AND o.k <> l.k AND o.day < l.last AND l.day < o.last) AS lost FROM l)
      SELECT k AS row, CASE WHEN lost THEN 'needs_human' ELSE split_part(d, ':', 1) END AS status, CASE WHEN lost THEN 'overlap' ELSE split_part(d, ':', 2) END AS reason FROM r""",
    "src2_plain_text": """WITH d AS (SELECT doc_id, chr(10) || '  ' || chr(10) || text || chr(10) || chr(9) || chr(10) || 'See https://e.example/a_(b).' || chr(10) || 'and https://e.example/x) too' || chr(10) || chr(10) AS t FROM documents),
      s AS (SELECT doc_id, t, string_split(t, chr(10)) AS s FROM d), l AS (SELECT doc_id, t, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS k FROM s), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
      b AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o WHERE regexp_matches(line, '[^\\s]')), g AS (SELECT doc_id, any_value(t) AS t, min(k) AS f, max(k) AS e, min(a) AS a, max(a + length(line)) AS z FROM b GROUP BY doc_id, run)
      SELECT doc_id, printf('p_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY f)) AS paragraph_id, CAST(f AS INT) AS line_start, CAST(e AS INT) AS line_end, CAST(a AS INT) AS char_start, CAST(z AS INT) AS char_end, sha256(t[CAST(a + 1 AS BIGINT):CAST(z AS BIGINT)]) AS text_hash, CASE WHEN e = max(e) OVER (PARTITION BY doc_id) THEN 'https://e.example/a_(b) https://e.example/x' ELSE '' END AS urls FROM g""",
    "jn14_greedy_match": f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {_SENT.format('text')} AS s FROM conversations), e AS (SELECT conv_id, turn, CAST(unnest(range(0, len(s))) AS INT) AS k, unnest([{_WORDS.format('x')} FOR x IN s]) AS w FROM t),
      f AS (SELECT a.conv_id AS conv, a.turn, a.k AS l, b.k AS r, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 WHEN len(list_intersect(a.w, b.w)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) END, 9) AS score FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
      c AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY score DESC, l, r) AS k FROM f WHERE score > 0),
      g(conv, turn, k, ls, rs, ok) AS (SELECT conv, turn, k, [l], [r], true FROM c WHERE k = 1 UNION ALL SELECT c.conv, c.turn, c.k, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END, NOT (list_contains(ls, l) OR list_contains(rs, r)) FROM g JOIN c ON c.conv = g.conv AND c.turn = g.turn AND c.k = g.k + 1)
      SELECT c.conv, c.turn, l, r, round(score, 6) AS score FROM c JOIN g ON c.conv = g.conv AND c.turn = g.turn AND c.k = g.k WHERE ok""",
    "par12_bounded_chunks": r"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents), c(doc_id, a, e, nxt) AS (
      SELECT doc_id, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM d
      UNION ALL SELECT doc_id, a, a + length(regexp_replace(substr(t, a + 1, CAST(z - a AS INT)), '\s+$', '')), z FROM (
        SELECT doc_id, t, a, CASE WHEN a + 400 < n AND w > 0 THEN a + w ELSE least(a + 400, n) END AS z FROM (
          SELECT doc_id, t, n, a, length(regexp_extract(substr(t, a + 2, 400), '(?s)^(.*)[ \n\t]', 1)) + CASE WHEN regexp_matches(substr(t, a + 2, 400), '[ \n\t]') THEN 1 ELSE 0 END AS w FROM (
            SELECT c.doc_id, t, n, nxt + length(regexp_extract(substr(t, nxt + 1), '^\s*')) AS a FROM c JOIN d ON c.doc_id = d.doc_id WHERE nxt < n) WHERE a < n)))
      SELECT doc_id, count(*) AS n_chunks, CAST(max(e - a) AS INT) AS longest, CAST(max(e) AS INT) AS last_end FROM c WHERE a >= 0 GROUP BY doc_id""",
    "par11_html_paragraphs": f"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<footer>.*', '', 'g') AS h FROM pages),
      p AS (SELECT page_id, {_CLEAN.format("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS title, {_CLEAN.format("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS heading, {_CLEAN.format("regexp_extract(h, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS loose,
        [{_CLEAN.format("split_part(q, '</p>', 1)")} FOR q IN string_split(split_part(h, '</h1>', 2), '<p>')[2:] IF contains(q, '</p>')] AS raw FROM x),
      b AS (SELECT page_id, title, CASE WHEN len([r FOR r IN raw IF r <> '']) > 0 THEN heading ELSE '' END AS heading, CASE WHEN len([r FOR r IN raw IF r <> '']) > 0 THEN [r FOR r IN raw IF r <> ''] WHEN loose <> '' THEN [loose] ELSE [] END AS s FROM p),
      e AS (SELECT page_id, title, heading, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS t FROM b), o AS (SELECT *, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS a FROM e)
      SELECT page_id, title, CAST(k AS INT) AS ordinal, heading, concat(CASE WHEN heading <> '' THEN heading || ' > ' ELSE '' END, 'paragraph ', k, ' [chars ', a, '-', a + length(t), ']') AS locator, sha256(t) AS text_hash, a AS char_start, CAST(a + length(t) AS INT) AS char_end FROM o""",
    "par2_block_spans": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, 1 AS ordinal, 'paragraph' AS kind, 3 AS line_start, CAST(len(l) + 2 AS INT) AS line_end, 'Title' AS heading, sha256(array_to_string([trim(x, ' ' || chr(9)) FOR x IN l], chr(10))) AS raw_hash FROM d
      UNION ALL SELECT doc_id, 2, 'list_item', CAST(len(l) + 6 AS INT), CAST(len(l) + 6 AS INT), 'Title > Part [one](https://e.example/a_(b)) and [two][ref]', sha256('item `[no](x)` https://e.example/q.') FROM d""",
}
