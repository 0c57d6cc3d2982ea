"""Queries over claim and evidence pairs built from orders: slots, signals, verdicts, policy and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import metrics, signals, verdicts
from attestra.sources.shared import spread

#: One claim and one evidence text per order, with planted differences; the same SQL for both engines.
PAIRS = """
SELECT o_orderkey AS case_id, o_custkey AS source_id, o_totalprice AS price, o_orderpriority AS split, o_orderkey % 11 <> 0 AS available, o_orderkey % 13 <> 0 AS checkable,
  concat('Acme Engine v', CAST(o_custkey % 3 AS STRING), '.', CAST(o_orderkey % 4 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN ' does not handle ' ELSE ' handles ' END,
    CASE o_orderkey % 5 WHEN 0 THEN 'only ' WHEN 1 THEN 'at least ' WHEN 2 THEN 'every ' ELSE '' END, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' batch requests',
    CASE WHEN o_orderkey % 6 = 0 THEN ' and rejects stale cursors' ELSE '' END, ' since 20', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3), '.') AS claim_text,
  CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat(CASE WHEN o_orderkey % 9 = 0 THEN 'Zenith' ELSE 'Acme' END, ' Engine v', CAST(o_custkey % 2 AS STRING), '.', CAST(o_orderkey % 4 AS STRING),
    CASE WHEN o_custkey % 8 = 0 THEN ' never handles ' ELSE ' handles ' END, CASE o_custkey % 4 WHEN 0 THEN 'all ' WHEN 1 THEN 'at most ' ELSE '' END,
    CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_custkey % 5 = 0 THEN 10 ELSE 0 END AS STRING), ' batch requests since 20', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3),
    '. Other notes mention tier ', CAST(o_orderkey % 3 AS STRING), ' samples; nothing else applies.') END AS evidence_text
FROM orders
"""

_STOP = ", ".join(f"'{x}'" for x in T.STOPWORDS)
_NON = ", ".join(f"'{x}'" for x in T.NON_ENTITY)
_JUDGE = ", ".join(f"'{x}'" for x in T.JUDGE_STOPWORDS)
_VERSION = r"(?i)\bv?\d+(?:\.\d+){1,3}\b"
_DATE = r"\b20\d{2}[-/]\d{1,2}[-/]\d{1,2}\b"
_NEGATION = T.NEGATION.replace("'", "''")

#: Slots, signals and verdicts in SQL, as CTEs over PAIRS.
SLOTS = rf"""
WITH pairs AS ({PAIRS}),
clauses AS (
  SELECT case_id, claim_text, evidence_text, generate_subscripts(parts, 1) AS place, unnest(parts) AS clause FROM (
    SELECT case_id, claim_text, evidence_text, [trim(x) FOR x IN string_split(regexp_replace(regexp_replace(evidence_text, '([.;!?])\s+', '\1' || chr(1), 'g'), '(?i)\s+(?:and|but)\s+', chr(1), 'g'), chr(1)) IF trim(x) <> ''] AS parts FROM pairs)),
scored AS (SELECT case_id, place, clause, len(list_intersect([x FOR x IN list_distinct([lower(y) FOR y IN regexp_extract_all(claim_text, '{T.WORD}')]) IF x NOT IN ({_STOP})], [lower(y) FOR y IN regexp_extract_all(clause, '{T.WORD}')])) AS shared FROM clauses),
best AS (SELECT case_id, arg_max(clause, shared * 1000 - place) AS clause FROM scored GROUP BY case_id),
texts AS (
  SELECT case_id, 'c' AS role, claim_text AS t FROM pairs
  UNION ALL SELECT p.case_id, 'e', CASE WHEN regexp_matches(claim_text, '{T.CONJUNCTION}') THEN evidence_text ELSE coalesce(b.clause, evidence_text) END FROM pairs p LEFT JOIN best b ON p.case_id = b.case_id
  UNION ALL SELECT case_id, 'f', evidence_text FROM pairs),
raw AS (
  SELECT case_id, role, t, list_distinct([replace(x, '/', '-') FOR x IN regexp_extract_all(t, '{_DATE}')]) AS dates, list_distinct([regexp_replace(lower(x), '^v', '') FOR x IN regexp_extract_all(t, '{_VERSION}')]) AS versions,
    list_distinct([replace(x, ',', '') FOR x IN regexp_extract_all(regexp_replace(regexp_replace(t, '{_VERSION}', ' ', 'g'), '{_DATE}', ' ', 'g'), '(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?%?')]) AS numbers,
    [x FOR x IN list_distinct([lower(y) FOR y IN regexp_extract_all(t, '{T.WORD}')]) IF x NOT IN ({_STOP})] AS words, [x FOR x IN list_distinct([lower(y) FOR y IN regexp_extract_all(t, '{T.WORD}')]) IF x NOT IN ({_JUDGE})] AS judge_words,
    [x FOR x IN list_distinct([lower(y) FOR y IN regexp_extract_all(t, '{T.ENTITY}')]) IF x NOT IN ({_NON})] AS entities, regexp_matches(t, '{_NEGATION}') AS negated,
    list_sort(list_distinct(list_concat(list_concat([regexp_replace(lower(x), '\s+', ' ', 'g') FOR x IN regexp_extract_all(t, '{T.QUALIFIER}')],
      [concat('scope:', CASE WHEN lower(regexp_extract(x, '{T.SCOPE}', 1)) IN ({_STOP}) THEN '' ELSE lower(regexp_extract(x, '{T.SCOPE}', 1)) END, ':', regexp_replace(lower(regexp_extract(x, '{T.SCOPE}', 2)), 's$', '')) FOR x IN regexp_extract_all(t, '{T.SCOPE}')]),
      [concat('denominator:', regexp_replace(lower(x), '\s+', ' ', 'g')) FOR x IN regexp_extract_all(t, '{T.DENOMINATOR}')]))) AS qualifiers
  FROM texts),
slots AS (SELECT *, [x FOR x IN words IF NOT list_contains(entities, x) AND NOT list_contains(versions, x) AND NOT list_contains(numbers, x)] AS context FROM raw)
"""
SIGNALS = rf"""{SLOTS},
joined AS (SELECT p.*, c.dates AS c_dates, e.dates AS e_dates, c.versions AS c_versions, e.versions AS e_versions, c.numbers AS c_numbers, e.numbers AS e_numbers, c.negated AS c_neg, e.negated AS e_neg,
    c.entities AS c_ent, e.entities AS e_ent, f.entities AS f_ent, c.qualifiers AS cq, e.qualifiers AS eq, c.judge_words AS c_jw, f.judge_words AS f_jw, f.words AS f_words,
    len(list_intersect(c.context, e.context)) AS sh, least(len(c.context), len(e.context)) AS sm, len(list_intersect(c.context, f.context)) AS fsh, least(len(c.context), len(f.context)) AS fsm,
    len(list_intersect(c.entities, e.entities)) + len(list_intersect(c.versions, e.versions)) AS same, len(list_intersect(c.entities, f.entities)) + len(list_intersect(c.versions, f.versions)) AS fsame,
    [len(list_intersect(list_distinct(w), f.words)) / len(list_distinct(w)) FOR w IN [[x FOR x IN [lower(y) FOR y IN regexp_extract_all(part, '{T.WORD}')] IF x NOT IN ({_STOP})] FOR part IN string_split(regexp_replace(p.claim_text, '{T.CONJUNCTION}', chr(1), 'g'), chr(1))] IF len(w) > 0] AS cover
  FROM pairs p JOIN slots c ON c.case_id = p.case_id AND c.role = 'c' JOIN slots e ON e.case_id = p.case_id AND e.role = 'e' JOIN slots f ON f.case_id = p.case_id AND f.role = 'f'),
flags AS (SELECT *, (sh >= 2 AND sh * 2 >= sm) OR (sh > 0 AND same > 0) AS aligned, (fsh >= 2 AND fsh * 2 >= fsm) OR (fsh > 0 AND fsame > 0) AS f_aligned,
    (list_has_any(cq, ['only']) AND list_has_any(eq, ['all', 'every'])) OR (list_has_any(eq, ['only']) AND list_has_any(cq, ['all', 'every'])) OR (list_has_any(cq, ['at least']) AND list_has_any(eq, ['at most'])) OR (list_has_any(eq, ['at least']) AND list_has_any(cq, ['at most'])) AS opposed FROM joined),
coded AS (SELECT *, len(c_dates) > 0 AND len(e_dates) > 0 AND len([x FOR x IN c_dates IF NOT list_contains(e_dates, x)]) > 0 AS s_date, len(c_versions) > 0 AND len(e_versions) > 0 AND len([x FOR x IN c_versions IF NOT list_contains(e_versions, x)]) > 0 AS s_version,
    len(c_numbers) > 0 AND len(e_numbers) > 0 AND len([x FOR x IN c_numbers IF NOT list_contains(e_numbers, x)]) > 0 AS s_number, c_neg <> e_neg AND aligned AS s_neg,
    len(c_ent) > 0 AND len(e_ent) > 0 AND NOT list_has_any(c_ent, e_ent) AND NOT list_has_any(c_ent, f_ent) AND aligned AS s_ent, cq <> eq AND aligned AS s_qual,
    f_aligned AND len(cover) >= 2 AND len([x FOR x IN cover IF x >= 0.75]) > 0 AND len([x FOR x IN cover IF x < 0.75]) > 0 AS s_conj, regexp_matches(claim_text, '{T.COMPARISON}') AS s_comp FROM flags)
"""
VERDICTS = f"""{SIGNALS},
shared AS (SELECT *, len(list_intersect(c_jw, f_jw)) / greatest(len(c_jw), 1) AS share FROM coded),
judged AS (SELECT *, CASE WHEN NOT checkable THEN 'not_checkable' WHEN NOT available THEN 'source_unavailable' WHEN evidence_text = '' THEN 'not_in_source'
      WHEN (s_date OR s_version OR s_number) AND share >= 0.4 THEN 'contradicted' WHEN s_ent AND share >= 0.4 THEN 'contradicted' WHEN s_neg AND share >= 0.5 THEN 'contradicted' WHEN s_qual AND opposed AND share >= 0.4 THEN 'contradicted'
      WHEN (s_conj OR s_qual) AND share >= 0.4 THEN 'partially_entailed' WHEN share >= 0.75 THEN 'entailed' WHEN share >= 0.4 THEN 'partially_entailed' ELSE 'not_in_source' END AS relation,
    CASE WHEN NOT available THEN 'source_unavailable' WHEN evidence_text = '' THEN 'not_in_source' WHEN (s_date OR s_version OR s_number OR s_neg) AND share >= 0.25 THEN 'contradicted' WHEN share >= 0.75 THEN 'entailed' WHEN share >= 0.35 THEN 'partially_entailed' ELSE 'not_in_source' END AS lexical_relation,
    least(greatest(price / 50000.0 / 10.0, 0.1), 0.99) AS base_conf FROM shared),
final AS (SELECT *, CASE WHEN relation = 'not_checkable' THEN 0.95 WHEN relation IN ('source_unavailable', 'not_in_source') THEN 0.0 ELSE least(base_conf, CASE WHEN relation = 'entailed' THEN 0.74 ELSE 1 END, CASE WHEN s_comp OR s_qual OR s_conj THEN 0.69 ELSE 1 END) END AS confidence FROM judged)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return spark.sql(PAIRS.replace("FROM orders", "FROM {orders}"), orders=orders)


def _text(items: Column) -> Column:
    return F.array_join(F.array_sort(items), ",")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.with_signals(pairs(spark, sf_dir))
    names = ["dates", "versions", "numbers", "words", "entities", "qualifiers"]
    return made.select("case_id", "aligned_evidence", *(_text(F.col(f"{p}_{n}")).alias(f"{p}_{n}") for p in "ce" for n in names), "c_negated", "e_negated")


def signal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.with_signals(pairs(spark, sf_dir))
    return made.select("case_id", F.array_join(F.transform("signals", lambda s: F.concat(s["code"], F.lit(":"), s["severity"])), ",").alias("signals"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.with_signals(pairs(spark, sf_dir)).withColumn("score", F.col("price") / 50000.0)
    return verdicts.lexical(verdicts.deterministic(made), share="overlap")


def verdict_rows(spark: SparkSession, sf_dir: str, carry: list[str] | None = None) -> DataFrame:
    made = judged(spark, sf_dir)
    return made.select("case_id", *(carry or []), "relation", F.round("confidence", 9).alias("confidence"), "lexical_relation", verdicts.severity(F.col("relation"), F.when(F.col("case_id") % 17 == 0, "disputed").otherwise("cited_only")).alias("severity"), verdicts.challenge(F.col("relation"), F.col("confidence")).alias("challenge"))


def three_label_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = verdicts.lexical(signals.with_signals(pairs(spark, sf_dir)), partial=False)
    return made.select("case_id", "lexical_relation", F.round("lexical_confidence", 9).alias("lexical_confidence"))


def slot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.with_signals(pairs(spark, sf_dir))
    return made.select("case_id", F.array_join(verdicts.changed_slots("c", "e"), ",").alias("changed"))


def high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by relation, and the risky among them; every second claim is given without its version and figures, as wording alone makes many risky."""
    made = judged(spark, sf_dir)
    plain = F.regexp_replace("claim_text", r"v?[0-9]+(?:[.-][0-9]+)*", "some")
    made = made.withColumn("claim_text", F.when(F.col("case_id") % 2 == 0, plain).otherwise(F.col("claim_text")))
    return made.groupBy("relation").agg(F.count_if(verdicts.high_risk(F.col("relation"), F.col("confidence"), F.col("claim_text"), F.col("signals"))).alias("n_high_risk"), F.count(F.lit(1)).alias("n"))


def policy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = verdict_rows(spark, sf_dir)
    return made.groupBy((F.col("case_id") % 50).alias("document")).agg(F.bool_or(F.col("severity") == "error").cast("int").alias("exit_code"), F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.count_if(F.col("severity") == "notice").alias("n_notices"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two judges as gold and prediction."""
    made = judged(spark, sf_dir)
    return made.select("case_id", "split", F.col("relation").alias("gold"), F.col("lexical_relation").alias("predicted"), "confidence", "price", "claim_text", "evidence_text")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(eval_rows(spark, sf_dir))


def per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_label(eval_rows(spark, sf_dir), by=["split"]).select("split", "label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.summary(eval_rows(spark, sf_dir), by=["split"])
    return made.select("split", "n", *(F.round(c, 9).alias(c) for c in made.columns if c not in ("split", "n")))


def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_patterns(eval_rows(spark, sf_dir))


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = metrics.per_label(eval_rows(spark, sf_dir), by=["split"])
    gate = metrics.coverage_gate(each, ["entailed", "partially_entailed", "contradicted"], 100, by=["split"])
    return gate.select("split", "achieved", F.array_join("insufficient_labels", ",").alias("insufficient"))


def subset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("split:"), "split"), F.when(F.col("case_id") % 2 == 0, F.lit("even")), F.when(F.length("claim_text") > 60, F.lit("long"))))
    return metrics.tagged(eval_rows(spark, sf_dir), tags).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 9).alias("accuracy"))


def span_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eval_rows(spark, sf_dir)
    return rows.select("case_id", F.round(T.token_f1(F.col("evidence_text"), F.col("claim_text")), 9).alias("token_f1"))


def claim_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("claim_text")
    return pairs(spark, sf_dir).select("case_id", T.claim_type(t).alias("claim_type"), T.checkability(t).alias("checkability"), T.complete_claim(t).alias("complete"), F.size(T.protected(t)).alias("n_protected"))


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pairs(spark, sf_dir).withColumn("chunks", F.size(T.sentences(F.col("evidence_text"))))
    way = verdicts.route(~F.col("available"), T.subjective(F.col("claim_text")), F.col("chunks") - F.col("case_id") % 2, F.octet_length("evidence_text"), 120)
    return made.select("case_id", way.alias("w")).select("case_id", "w.route", "w.reason")


_PER = """, grid AS (SELECT DISTINCT split, unnest(['entailed','partially_entailed','contradicted','not_in_source','source_unavailable','not_checkable']) AS label FROM final),
cells AS (SELECT g.split, g.label, (SELECT count(*) FROM final f WHERE f.split = g.split AND f.relation = g.label) AS support, (SELECT count(*) FROM final f WHERE f.split = g.split AND f.lexical_relation = g.label) AS np,
  (SELECT count(*) FROM final f WHERE f.split = g.split AND f.relation = g.label AND f.lexical_relation = g.label) AS tp FROM grid g),
pr AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM cells),
per AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""
_LABELS = "unnest(['entailed','partially_entailed','contradicted','not_in_source','source_unavailable','not_checkable'])"
_SEV = "CASE WHEN relation = 'contradicted' THEN 3 WHEN relation IN ('partially_entailed', 'not_in_source') THEN 2 WHEN relation IN ('source_unavailable', 'not_checkable') THEN 1 ELSE 0 END"
SEVERITY_LABEL = f"CASE greatest({_SEV}, CASE WHEN case_id % 17 = 0 THEN 2 ELSE 0 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' WHEN 1 THEN 'notice' ELSE 'pass' END"


def _sorted(column: str) -> str:
    return f"array_to_string(list_sort({column}), ',')"


_SLOT_SQL = ", ".join(f"{_sorted(f'{p}.{n}')} AS {p}_{n}" for p in "ce" for n in ("dates", "versions", "numbers", "words", "entities", "qualifiers"))
_CODES = ", ".join(
    f"CASE WHEN {flag} THEN {code} END"
    for flag, code in [
        ("s_date", "'date_mismatch:error'"), ("s_version", "'version_mismatch:error'"), ("s_number", "'numeric_mismatch:error'"), ("s_neg", "'negation_mismatch:error'"), ("s_ent", "'entity_mismatch:error'"),
        ("s_qual", "CASE WHEN opposed THEN 'qualifier_mismatch:error' ELSE 'qualifier_mismatch:warning' END"), ("s_conj", "'conjunction_mismatch:warning'"), ("s_comp", "'comparison_reminder:notice'"),
    ]
)
_RISKY = r"(?i)\b(?:v?\d+(?:\.\d+){1,3}|20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d+(?:[.,]\d+)?%?|more|less|higher|lower|faster|slower|best|worst|maximum|minimum|before|after|than)\b"
_HARD = f"relation = 'contradicted' OR confidence < 0.65 OR s_date OR s_version OR s_number OR s_neg OR s_ent OR regexp_matches(CASE WHEN case_id % 2 = 0 THEN regexp_replace(claim_text, 'v?[0-9]+(?:[.-][0-9]+)*', 'some', 'g') ELSE claim_text END, '{_RISKY}')"
_PROTECTED = T.PROTECTED.replace("(?<![A-Za-z0-9])", r"\b").replace("'", "''")

QUERIES = {
    "par20_slots": slots, "sig9_signals": signal_codes, "ver1_verdicts": verdict_rows, "prj12_high_risk": high_risk, "ver3_three_labels": three_label_judge, "prj21_changed_slots": slot_changes, "prj9_policy_rollup": policy_rollup, "agg1_confusion": confusion, "agg2_per_label": per_label,
    "agg3_summary": summary, "rnk16_error_patterns": error_patterns, "agg9_coverage_gate": coverage_gate, "agg10_subsets": subset_reports, "agg5_token_f1": span_f1, "prj1_claim_rules": claim_rules, "prj10_router": router, "flagship": verdict_rows,
}
_CHANGED = ", ".join(f"CASE WHEN list_sort(c.{kind}) <> list_sort(e.{kind}) THEN '{name}' END" for kind, name in [("dates", "date"), ("versions", "version"), ("numbers", "number"), ("entities", "entity"), ("qualifiers", "qualifier")])
SQL = {
    "ver3_three_labels": f"{VERDICTS} SELECT case_id, CASE lexical_relation WHEN 'partially_entailed' THEN 'entailed' ELSE lexical_relation END AS lexical_relation, round(CASE WHEN NOT available OR evidence_text = '' THEN 0.0 ELSE least(share, 0.99) END, 9) AS lexical_confidence FROM final",
    "prj21_changed_slots": f"{SLOTS} SELECT c.case_id, concat_ws(',', {_CHANGED}, CASE WHEN c.negated <> e.negated THEN 'negation' END) AS changed FROM slots c JOIN slots e ON c.case_id = e.case_id AND c.role = 'c' AND e.role = 'e'",
    "par20_slots": f"{SLOTS} SELECT c.case_id, e.t AS aligned_evidence, {_SLOT_SQL}, c.negated AS c_negated, e.negated AS e_negated FROM slots c JOIN slots e ON c.case_id = e.case_id AND c.role = 'c' AND e.role = 'e'",
    "sig9_signals": f"{SIGNALS} SELECT case_id, concat_ws(',', {_CODES}) AS signals FROM coded",
    "ver1_verdicts": f"{VERDICTS} SELECT case_id, relation, round(confidence, 9) AS confidence, lexical_relation, {SEVERITY_LABEL} AS severity, CASE WHEN confidence < 0.5 AND relation <> 'contradicted' THEN 'abstain' ELSE 'uphold' END AS challenge FROM final",
    "prj12_high_risk": f"{VERDICTS} SELECT relation, count(*) FILTER ({_HARD}) AS n_high_risk, count(*) AS n FROM final GROUP BY relation",
    "prj9_policy_rollup": f"{VERDICTS}, s AS (SELECT case_id % 50 AS document, {SEVERITY_LABEL} AS severity FROM final) SELECT document, CAST(bool_or(severity = 'error') AS INT) AS exit_code, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'notice') AS n_notices FROM s GROUP BY document",
    "agg1_confusion": f"{VERDICTS}, g AS (SELECT {_LABELS} AS gold), p AS (SELECT {_LABELS} AS predicted) SELECT gold, predicted, (SELECT count(*) FROM final f WHERE f.relation = gold AND f.lexical_relation = predicted) AS n FROM g, p",
    "agg2_per_label": f"{VERDICTS}{_PER} SELECT split, label, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, support FROM per",
    "agg3_summary": f"""{VERDICTS}{_PER}, m AS (SELECT split, avg(CASE WHEN support > 0 THEN f1 END) AS o, avg(f1) AS x, sum(f1 * support) / sum(support) AS w, avg(CASE WHEN support > 0 THEN r END) AS b FROM per GROUP BY split),
      k AS (SELECT split, count(*) AS n, coalesce(count(*) FILTER (confidence >= 0.8 AND relation <> lexical_relation) / nullif(count(*) FILTER (confidence >= 0.8), 0), 0.0) AS h, count(*) FILTER (lexical_relation IN ('not_in_source', 'source_unavailable')) / count(*) AS a FROM final GROUP BY split)
      SELECT k.split, n, round(h, 9) AS high_confidence_error_rate, round(a, 9) AS abstention_rate, round(o, 9) AS observed_macro_f1, round(x, 9) AS fixed_macro_f1, round(w, 9) AS weighted_f1, round(b, 9) AS balanced_accuracy FROM k JOIN m ON k.split = m.split""",
    "rnk16_error_patterns": f"{VERDICTS} SELECT concat(relation, '->', lexical_relation) AS pattern, count(*) AS n FROM final WHERE relation <> lexical_relation GROUP BY 1 ORDER BY n DESC, pattern LIMIT 3",
    "agg9_coverage_gate": f"{VERDICTS}{_PER} SELECT split, count(*) FILTER (support < 100) = 0 AS achieved, coalesce(string_agg(label, ',' ORDER BY label) FILTER (support < 100), '') AS insufficient FROM per WHERE label IN ('entailed', 'partially_entailed', 'contradicted') GROUP BY split",
    "agg10_subsets": f"{VERDICTS}, t AS (SELECT unnest([x FOR x IN ['all', concat('split:', split), CASE WHEN case_id % 2 = 0 THEN 'even' END, CASE WHEN length(claim_text) > 60 THEN 'long' END] IF x IS NOT NULL]) AS subset, relation = lexical_relation AS hit FROM final) SELECT subset, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 9) AS accuracy FROM t GROUP BY subset",
    "agg5_token_f1": f"""WITH pairs AS ({PAIRS}), w AS (SELECT case_id, list_distinct([lower(x) FOR x IN regexp_extract_all(evidence_text, '{T.WORD}')]) AS p, list_distinct([lower(x) FOR x IN regexp_extract_all(claim_text, '{T.WORD}')]) AS g FROM pairs)
      SELECT case_id, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END, 9) AS token_f1 FROM w""",
    "prj1_claim_rules": f"""WITH pairs AS ({PAIRS}) SELECT case_id, CASE WHEN regexp_matches(claim_text, '{_VERSION}') THEN 'versioned_capability' WHEN regexp_matches(claim_text, '{_DATE}') THEN 'dated_event' WHEN regexp_matches(claim_text, '\\d') THEN 'numeric_measurement' ELSE 'factual_statement' END AS claim_type,
      CASE WHEN regexp_matches(claim_text, '{T.OPINION}') THEN 'not_checkable' ELSE 'checkable' END AS checkability, len(list_distinct([lower(x) FOR x IN regexp_extract_all(claim_text, '\\d+(?:[.,]\\d+)?%|[A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*')])) >= 2 AND NOT regexp_matches(claim_text, '{T.INCOMPLETE_END}') AS complete,
      len(regexp_extract_all(claim_text, '{_PROTECTED}')) AS n_protected FROM pairs""",
    "prj10_router": f"""WITH pairs AS ({PAIRS}), k AS (SELECT *, len([x FOR x IN string_split(regexp_replace(evidence_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(x) <> '']) - case_id % 2 AS chunks FROM pairs),
      r AS (SELECT case_id, CASE WHEN NOT available THEN 'source_unavailable' WHEN chunks = 0 THEN 'empty_available_source' WHEN chunks > 1 THEN 'multi_chunk_source' WHEN strlen(evidence_text) > 120 THEN 'context_budget_exceeded' ELSE 'single_chunk_within_context_budget' END AS reason FROM k)
      SELECT case_id, CASE reason WHEN 'source_unavailable' THEN 'deterministic_source_unavailable' WHEN 'single_chunk_within_context_budget' THEN 'full_context_single_agent' ELSE 'retrieval_judge' END AS route, reason FROM r""",
}
SQL["flagship"] = SQL["ver1_verdicts"]
