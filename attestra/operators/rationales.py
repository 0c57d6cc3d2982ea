"""Pooled scoring of retrieved documents and predicted rationale sentences.

``gold``: (claim, doc, rationale, label, sentences array<int>), one row a rationale; ``predicted``:
(claim, doc, label, sentences array<int>); ``retrieved``: (claim, docs array). Claims without gold
evidence have no row in ``gold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import ratio

#: Fixed value: sentences of a document that count for its rationale, at least.
LEAST_SENTENCES = 3


def retrieval_scores(claims: DataFrame, gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row: hit_one and hit_all over all claims (no evidence counts as a hit) and over those with evidence, MRR and pooled recall."""
    docs = gold.groupBy("claim").agg(F.collect_set("doc").alias("gold_docs"))
    none = F.array().cast(docs.schema["gold_docs"].dataType)
    base = claims.select("claim").join(docs, "claim", "left").join(retrieved, "claim", "left").select("claim", F.coalesce("gold_docs", none).alias("g"), F.coalesce("docs", none).alias("p"))
    hit, every, has = F.arrays_overlap("g", "p"), F.size(F.array_except("g", "p")) == 0, F.size("g") > 0
    first = F.array_min(F.filter(F.transform("p", lambda d, i: F.when(F.array_contains("g", d), i + 1)), lambda x: x.isNotNull()))
    n = F.count(F.lit(1))
    return base.agg(
        n.alias("n_claims"), ratio(F.count_if(hit | ~has), n).alias("hit_one"), ratio(F.count_if(every), n).alias("hit_all"), F.count_if(has).alias("n_evidence_claims"), ratio(F.count_if(has & hit), F.count_if(has)).alias("evidence_hit_one"),
        ratio(F.count_if(has & every), F.count_if(has)).alias("evidence_hit_all"), ratio(F.sum(F.when(has, F.coalesce(1 / first, F.lit(0.0)))), F.count_if(has)).alias("mrr"), ratio(F.sum(F.size(F.array_intersect("g", "p"))), F.sum(F.size("g"))).alias("document_recall"),
    )


def rank_statistics(gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """Median, mean, least and most 0-based rank of gold documents in full rankings (claim, docs array)."""
    ranks = gold.select("claim", "doc").distinct().join(rankings, "claim").select((F.array_position("docs", F.col("doc")) - 1).alias("r"))
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.median("r"), F.lit(0.0)).alias("median_rank"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("mean_rank"), F.min("r").alias("least"), F.max("r").alias("most"))


def pipeline_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(measure, precision, recall, f1) for sentence selection and label, abstract label and rationale.

    A sentence is correct if the rationale it belongs to is predicted as a whole; an abstract is
    rationalised if its label is right and a whole rationale lies in its first sentences (three, or
    as many as the shortest rationale has). Repeated predicted sentences count as retrieved.
    """
    per_doc = gold.groupBy("claim", "doc").agg(F.first("label").alias("gold_label"), F.collect_list("sentences").alias("rationales"))
    joined = predicted.join(per_doc, ["claim", "doc"], "left")
    whole = lambda of: F.filter("rationales", lambda r: F.size(F.array_except(r, of)) == 0)
    most = F.greatest(F.lit(LEAST_SENTENCES), F.array_min(F.transform("rationales", F.size)))
    found = F.col("rationales").isNotNull()
    right = F.coalesce(F.col("label") == F.col("gold_label"), F.lit(False))
    correct = F.when(found, F.size(F.array_intersect(F.array_distinct("sentences"), F.flatten(whole(F.col("sentences")))))).otherwise(0)
    rationalised = found & right & (F.size(whole(F.slice(F.col("sentences"), F.lit(1), F.coalesce(most, F.lit(LEAST_SENTENCES))))) > 0)
    counts = joined.agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("sentences")), F.lit(0)).alias("sents"), F.coalesce(F.sum(correct), F.lit(0)).alias("c_sel"), F.coalesce(F.sum(F.when(right, correct).otherwise(0)), F.lit(0)).alias("c_lab"), F.count_if(right).alias("c_doc"), F.count_if(rationalised).alias("c_rat"),
    )
    wanted = gold.agg(F.count_distinct("claim", "doc").alias("g_docs"), F.coalesce(F.sum(F.size("sentences")), F.lit(0)).alias("g_sents"))
    one = counts.crossJoin(wanted)  # one row each
    row = lambda name, hit, got, want: F.struct(F.lit(name).alias("measure"), ratio(F.col(hit), F.col(got)).alias("precision"), ratio(F.col(hit), F.col(want)).alias("recall"))
    made = one.select(F.explode(F.array(row("sentence_selection", "c_sel", "sents", "g_sents"), row("sentence_label", "c_lab", "sents", "g_sents"), row("abstract_label_only", "c_doc", "docs", "g_docs"), row("abstract_rationalized", "c_rat", "docs", "g_docs"))).alias("m")).select("m.*")
    return made.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_rationale(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(claim, doc, best_f1, complete): the best set F1 over the alternatives, and whether one is covered."""
    both = gold.join(predicted.select("claim", "doc", F.array_distinct("sentences").alias("p")), ["claim", "doc"], "left").withColumn("p", F.coalesce("p", F.array().cast("array<int>")))
    shared = F.size(F.array_intersect("sentences", "p"))
    f1: Column = ratio(2.0 * shared, F.size("sentences") + F.size("p"))
    return both.groupBy("claim", "doc").agg(F.max(f1).alias("best_f1"), F.max(F.size(F.array_except("sentences", "p")) == 0).alias("complete"))
