"""Queries over seams, lexical features and rules on single texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import datasets, models, windows
from attestra.plans.texts import read
from attestra.plans.texts_sql import _GRAMS


def strict_drafts(spark, sf_dir):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": Infinity}', "[1]", '{"a": 1, "z": 2}', '{"b": "x"}', '{"a": ']))
    return read(spark, sf_dir, "part").select("p_partkey", datasets.strict_json(F.get(kinds, (k % 7).cast("int")), ["a"], ["a", "b"]).alias("problem"))


def ordered_spans(spark, sf_dir):
    k = F.col("p_partkey")
    word = lambda x: F.concat(F.lit(x), k.cast("string"))
    drafts = F.when(k % 3 == 0, F.array(word("a"), word("c"))).when(k % 3 == 1, F.array(word("b"), word("c"))).otherwise(F.array(word("c"), word("b")))
    found = windows.monotonic_spans(F.concat_ws(" ", word("a"), word("b"), word("a"), word("c")), drafts)
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.status", F.get("f.spans", F.lit(0))["start"].alias("first_start"), F.get("f.spans", F.lit(1))["start"].alias("second_start"))


def routing_tokens(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("In 2024-01-02 release v1."), (k % 9).cast("string"), F.lit(".0 took "), (k % 50).cast("string"), F.lit("% of "), k.cast("string"), F.lit(" runs"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(windows.routing_tokens(text), lambda x: F.concat_ws("=", x["kind"], x["token"])), " ").alias("tokens"))


def protected_spans(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("never "), k.cast("string"), F.lit(" or more"))
    made = windows.protected_spans(text)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(made, lambda x: F.concat_ws(":", x["key"], x["start"].cast("string"), x["end"].cast("string"))), " ").alias("spans"))


def cited_sentences(spark, sf_dir):
    k = F.col("p_partkey")
    name = k.cast("string")
    text = F.concat(F.lit("one "), name, F.lit("\ntwo\none "), name)
    n = F.length(name).cast("bigint")
    row = lambda s, a, b: F.struct(F.lit(s).cast("bigint").alias("sentence"), a.cast("bigint").alias("char_start"), b.cast("bigint").alias("char_end"))
    offsets = F.array(row(0, F.lit(0), n + 4), row(1, n + 5, n + 8), row(2, n + 9, n + n + 13))
    span = F.when(k % 4 == 0, "two").when(k % 4 == 1, "one").when(k % 4 == 2, F.concat(name, F.lit("\ntwo"))).otherwise("three")
    found = datasets.cited_sentences(text, offsets, span)
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.status", F.array_join("f.sentences", ",").alias("sentences"))


def model_answers(spark, sf_dir):
    """Answers of the deterministic stand-in; every fifth task fails once and is asked again."""
    task = F.when(F.col("p_partkey") % 5 == 0, "flaky").otherwise("judge")
    made = models.complete(models.fake_client, ["label"])(task, F.to_json(F.struct(F.col("p_partkey").alias("claim"))))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("m")).select("p_partkey", F.get_json_object("m.answer", "$.label").alias("label"), "m.attempts", "m.failed")


def scored_pairs(spark, sf_dir):
    made = models.scorer(models.overlap_scores, 6)(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("s")).select("p_partkey", "s.rejected", F.round("s.entailment", 9).alias("entailment"), F.round("s.contradiction", 9).alias("contradiction"))


def swapped_average(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("swapped"), F.col("l_discount").alias("support"), F.col("l_tax").alias("neither"), (F.col("l_quantity") / 50).alias("against"))
    made = models.swapped_average(rows, "l_orderkey", ["support", "neither", "against"])
    return made.select("l_orderkey", *(F.round(c, 9).alias(c) for c in ("support", "neither", "against")), "n")


def lexical_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(((F.col("l_partkey") + k) % 10 / 10).alias(name) for k, name in enumerate([*models.LEXICAL_WEIGHTS, "normalized_sentence_position"])))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(models.lexical_score(), 9).alias("score"))


def fitted_cosines(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1)).alias("other"), (F.col("p_partkey") % 3 != 0).alias("train"))
    made = models.pair_cosines(rows, "p_partkey", "p_name", "other", "train", models.word_grams, "cosine")
    return made.select("p_partkey", F.round("cosine", 6).alias("cosine"))


def grid_sweep(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_discount").alias("score"), (F.col("l_partkey") % 2 == 0).alias("good"))
    grid = spark.createDataFrame([(x / 100,) for x in range(0, 10, 2)], "threshold double")
    hit = (F.col("score") >= F.col("threshold")) == F.col("good")
    metric = lambda frame, by: frame.groupBy(*by).agg(F.count_if(F.col("score") >= F.col("threshold")).alias("n_kept"), F.avg(hit.cast("double")).alias("accuracy"))
    best = models.grid_sweep(rows, "fold", grid, metric, F.col("n_kept") > 0, [F.round("accuracy", 9), -F.col("threshold")])
    return best.select("fold", "threshold", "n_kept", F.round("accuracy", 9).alias("accuracy"))


def weighted_moments(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 2).alias("y"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    moments = models.weighted_scaler(models.claim_weights(rows, "l_orderkey", "y"), ["q", "d"])
    return spark.createDataFrame([(k, round(m, 6), round(s, 6)) for k, (m, s) in sorted(moments.items())], "feature string, mean double, deviation double")


_FEATURES = [*models.LEXICAL_WEIGHTS, "normalized_sentence_position"]
_SCORE = " + ".join(f"{w} * ((l_partkey + {k}) % 10 / 10)" for k, w in enumerate(models.LEXICAL_WEIGHTS.values())) + f" + {models.POSITION_WEIGHT} * (1.0 - (l_partkey + {len(models.LEXICAL_WEIGHTS)}) % 10 / 10)"

QUERIES = {
    "msc16_strict_drafts": strict_drafts, "prj20_ordered_spans": ordered_spans, "par23_routing_tokens": routing_tokens, "par21_protected_spans": protected_spans, "msc8_cited_sentences": cited_sentences, "udf1_model_answers": model_answers, "ml5_scored_pairs": scored_pairs,
    "ml6_swapped_average": swapped_average, "ml3_lexical_scores": lexical_scores, "ml1_fitted_cosines": fitted_cosines, "ml4_grid_sweep": grid_sweep, "ml2_weighted_moments": weighted_moments,
}
SQL = {
    "msc16_strict_drafts": "SELECT p_partkey, [NULL, 'duplicate_key', 'not_finite', 'not_an_object', 'unknown_field', 'missing_field', 'malformed'][p_partkey % 7 + 1] AS problem FROM part",
    "prj20_ordered_spans": "WITH n AS (SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) AS n FROM part) SELECT p_partkey, ['ambiguous', 'mapped', 'non_source'][p_partkey % 3 + 1] AS status, CAST(CASE WHEN p_partkey % 3 = 1 THEN n + 2 END AS INT) AS first_start, CAST(CASE WHEN p_partkey % 3 = 1 THEN 3 * n + 6 END AS INT) AS second_start FROM n",
    "par23_routing_tokens": "SELECT p_partkey, concat('date=2024-01-02 semver=v1.', p_partkey % 9, '.0 percent=', p_partkey % 50, '% number=', p_partkey) AS tokens FROM part",
    "par21_protected_spans": "WITH n AS (SELECT p_partkey, length(CAST(p_partkey AS VARCHAR)) AS n FROM part) SELECT p_partkey, concat('never:0:5 ', p_partkey, ':6:', 6 + n, ' more:', 10 + n, ':', 14 + n) AS spans FROM n",
    "msc8_cited_sentences": "SELECT p_partkey, ['mapped', 'ambiguous', 'mapped', 'out_of_scope'][p_partkey % 4 + 1] AS status, ['1', NULL, '0,1', NULL][p_partkey % 4 + 1] AS sentences FROM part",
    "udf1_model_answers": "SELECT p_partkey, ['entailed', 'contradicted', 'not_in_source'][('0x' || substr(sha256(concat('{\"claim\": ', p_partkey, '}')), 1, 2))::INT % 3 + 1] AS label, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS attempts, false AS failed FROM part",
    "ml5_scored_pairs": "WITH w AS (SELECT p_partkey, string_split(concat(p_name, ' ', p_type), ' ') AS a, string_split(p_name, ' ') AS b FROM part) SELECT p_partkey, len(a) + len(b) > 6 AS rejected, CASE WHEN len(a) + len(b) <= 6 THEN 1.0 END AS entailment, CASE WHEN len(a) + len(b) <= 6 THEN 0.0 END AS contradiction FROM w",
    "ml6_swapped_average": "WITH r AS (SELECT l_orderkey, l_linenumber % 2 = 0 AS s, l_discount AS a, l_tax AS b, l_quantity / 50 AS c FROM lineitem) SELECT l_orderkey, round(avg(CASE WHEN s THEN c ELSE a END), 9) AS support, round(avg(b), 9) AS neither, round(avg(CASE WHEN s THEN a ELSE c END), 9) AS against, count(*) AS n FROM r GROUP BY l_orderkey",
    "ml3_lexical_scores": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_SCORE}, 9) AS score FROM lineitem",
    "ml1_fitted_cosines": f"""WITH a AS (SELECT p_partkey AS id, 'l' AS side, p_name AS t, p_partkey % 3 <> 0 AS fit FROM part UNION ALL SELECT p_partkey, 'r', concat(p_type, ' ', string_split(p_name, ' ')[1]), p_partkey % 3 <> 0 FROM part),
      g AS (SELECT id, side, fit, term, 1 + ln(count(*)) AS tf FROM (SELECT id, side, fit, unnest({_GRAMS}) AS term FROM (SELECT id, side, fit, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM a)) GROUP BY ALL), n AS (SELECT count(*) AS n FROM a WHERE fit),
      d AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM g, n WHERE fit GROUP BY term), w AS (SELECT id, side, g.term, tf * idf AS w FROM g JOIN d ON g.term = d.term), m AS (SELECT id, side, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
      c AS (SELECT x.id, sum(x.w * y.w) AS dot FROM w x JOIN w y ON x.id = y.id AND x.term = y.term AND x.side = 'l' AND y.side = 'r' GROUP BY ALL)
      SELECT p_partkey, round(coalesce(dot / (l.norm * r.norm), 0.0), 6) AS cosine FROM part LEFT JOIN c ON c.id = p_partkey LEFT JOIN m l ON l.id = p_partkey AND l.side = 'l' LEFT JOIN m r ON r.id = p_partkey AND r.side = 'r'""",
    "ml4_grid_sweep": "WITH g AS (SELECT unnest([0.0, 0.02, 0.04, 0.06, 0.08])::DOUBLE AS t), m AS (SELECT l_orderkey % 5 AS fold, t, count(*) FILTER (l_discount >= t) AS n_kept, round(avg(CAST((l_discount >= t) = (l_partkey % 2 = 0) AS DOUBLE)), 9) AS accuracy FROM lineitem, g GROUP BY ALL) SELECT fold, t AS threshold, n_kept, accuracy FROM m WHERE n_kept > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY accuracy DESC, t) = 1",
    "ml2_weighted_moments": "WITH r AS (SELECT l_orderkey, l_partkey % 2 AS y, l_quantity AS q, l_discount AS d FROM lineitem), c AS (SELECT l_orderkey, count(DISTINCT y) AS k FROM r GROUP BY ALL), w AS (SELECT q, d, 1.0 / (k * count(*) OVER (PARTITION BY r.l_orderkey, y)) AS w FROM r JOIN c ON r.l_orderkey = c.l_orderkey), m AS (SELECT sum(w * q) / sum(w) AS mq, sum(w * d) / sum(w) AS md FROM w) SELECT 'd' AS feature, round(any_value(md), 6) AS mean, round(sqrt(sum(w * (d - md) ** 2) / sum(w)), 6) AS deviation FROM w, m UNION ALL SELECT 'q', round(any_value(mq), 6), round(sqrt(sum(w * (q - mq) ** 2) / sum(w)), 6) FROM w, m",
}
