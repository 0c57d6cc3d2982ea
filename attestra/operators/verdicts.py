"""Judges that turn overlap and signals into a relation, and the checks and policies on verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.numbers import clamp
from attestra.operators.signals import CAUTION, SLOT, has

RELATIONS = ["entailed", "partially_entailed", "contradicted", "not_in_source", "source_unavailable", "not_checkable"]
SEVERITIES = ["pass", "notice", "warning", "error"]
#: The default policy: the labels that fail, warn and notify.
FAIL_ON = ["contradicted"]
WARN_ON = ["partially_entailed", "not_in_source", "disputed", "no_evidence"]
NOTICE_ON = ["source_unavailable", "not_checkable"]


def overlap(claim: Column, evidence: Column) -> Column:
    own = T.judge_words(claim)
    return F.size(F.array_intersect(own, T.judge_words(evidence))) / F.greatest(F.size(own), F.lit(1))


def span_is_literal(span: Column, source: Column) -> Column:
    return (F.trim(span) != "") & (F.instr(source, span) > 0)


def deterministic(pairs: DataFrame, claim: str = "claim_text", evidence: str = "evidence_text") -> DataFrame:
    """Add ``relation`` and ``confidence`` by the ordered rules of the deterministic judge.

    Needs ``signals``, ``score`` (of the best hit), ``available`` and ``checkable``. Null evidence is none.
    """
    share, s = overlap(F.col(claim), F.coalesce(F.col(evidence), F.lit(""))), F.col("signals")
    base = T.once(pairs, {"overlap": share})
    share = F.col("overlap")
    qualifier_error = F.exists(s, lambda x: (x["code"] == "qualifier_mismatch") & (x["severity"] == "error"))
    rated = (
        F.when(has(s, SLOT) & (share >= 0.4), "contradicted").when(has(s, ["entity_mismatch"]) & (share >= 0.4), "contradicted").when(has(s, ["negation_mismatch"]) & (share >= 0.5), "contradicted")
        .when(qualifier_error & (share >= 0.4), "contradicted").when(has(s, ["conjunction_mismatch", "qualifier_mismatch"]) & (share >= 0.4), "partially_entailed")
        .when(share >= 0.75, "entailed").when(share >= 0.4, "partially_entailed").otherwise("not_in_source")
    )
    relation = F.when(~F.col("checkable") | T.subjective(F.col(claim)), "not_checkable").when(~F.col("available"), "source_unavailable").when(F.col(evidence).isNull() | (F.trim(F.col(evidence)) == ""), "not_in_source").otherwise(rated)
    base = T.once(base, {"relation": relation})
    scored = clamp(F.col("score") / 10.0, 0.1, 0.99)
    scored = F.when(F.col("relation") == "entailed", F.least(scored, F.lit(0.74))).otherwise(scored)
    scored = F.when(has(s, CAUTION), F.least(scored, F.lit(0.69))).otherwise(scored)
    return T.once(base, {"confidence": F.when(F.col("relation") == "not_checkable", 0.95).when(F.col("relation").isin("source_unavailable", "not_in_source"), 0.0).otherwise(scored)})


def lexical(pairs: DataFrame, claim: str = "claim_text", evidence: str = "evidence_text", partial: bool = True, share: str | None = None) -> DataFrame:
    """Add ``lexical_relation`` and ``lexical_confidence`` by overlap thresholds; ``partial`` false leaves three labels.

    ``share`` names a column that already holds the overlap of the two texts.
    """
    share = F.col(share) if share else overlap(F.col(claim), F.coalesce(F.col(evidence), F.lit("")))
    base, s = T.once(pairs, {"__share": share}), F.col("signals")
    share = F.col("__share")
    conflict = has(s, [*SLOT, "negation_mismatch"])
    rated = F.when(conflict & (share >= 0.25), "contradicted").when(share >= 0.75, "entailed")
    rated = rated.when(share >= 0.35, "partially_entailed" if partial else "entailed").otherwise("not_in_source")
    none = F.col(evidence).isNull() | (F.col(evidence) == "")
    relation = F.when(~F.col("available"), "source_unavailable").when(none, "not_in_source").otherwise(rated)
    return T.once(base, {"lexical_relation": relation, "lexical_confidence": F.when(~F.col("available") | none, 0.0).otherwise(F.least(share, F.lit(0.99)))}).drop("__share")


def _rank(label: Column) -> Column:
    return F.when(label.isin(FAIL_ON), 3).when(label.isin(WARN_ON), 2).when(label.isin(NOTICE_ON), 1).otherwise(0)


def severity(relation: Column, corroboration: Column) -> Column:
    """The more severe of the two labels' severities."""
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(_rank(relation), _rank(corroboration)) + 1)


def route(unavailable: Column, subjective: Column, chunks: Column, context_bytes: Column, budget: int = 8000) -> Column:
    """The adaptive route and its reason: the first rule that holds."""
    to = lambda way, reason: F.struct(F.lit(way).alias("route"), F.lit(reason).alias("reason"))
    return (
        F.when(unavailable, to("deterministic_source_unavailable", "source_unavailable")).when(subjective, to("deterministic_not_checkable", "subjective_without_fact_slots"))
        .when(chunks == 0, to("retrieval_judge", "empty_available_source")).when(chunks > 1, to("retrieval_judge", "multi_chunk_source"))
        .when(context_bytes > budget, to("retrieval_judge", "context_budget_exceeded")).otherwise(to("full_context_single_agent", "single_chunk_within_context_budget"))
    )


def high_risk(relation: Column, confidence: Column, claim: Column, signals: Column) -> Column:
    # fixed value: wording that makes a claim risky
    risky = r"(?i)\b(?:v?\d+(?:\.\d+){1,3}|20\d{2}[-/]\d{1,2}[-/]\d{1,2}|\d+(?:[.,]\d+)?%?|more|less|higher|lower|faster|slower|best|worst|maximum|minimum|before|after|than)\b"
    return (relation == "contradicted") | (confidence < 0.65) | claim.rlike(risky) | has(signals, ["numeric_mismatch", "date_mismatch", "version_mismatch", "entity_mismatch", "negation_mismatch"])


def challenge(relation: Column, confidence: Column) -> Column:
    """The offline challenger abstains on weak verdicts that do not contradict."""
    return F.when((confidence < 0.5) & (relation != "contradicted"), "abstain").otherwise("uphold")


def error_stage(predicted: Column, gold: Column, gold_span: Column, retrieved: Column, retrieves: Column) -> Column:
    """Where a wrong verdict went wrong: retrieval if the gold span is in no retrieved text, else the judge."""
    seen = F.exists(retrieved, lambda x: (F.instr(x, gold_span) > 0) | (F.instr(gold_span, x) > 0))
    return F.when(predicted == gold, "none").when(retrieves & gold_span.isNotNull() & ~F.coalesce(seen, F.lit(False)), "retrieval").otherwise("judge")


def changed_slots(before: str, after: str) -> Column:
    """The slot families in which two texts (prefixes of slot columns) differ."""
    kinds = [("dates", "date"), ("versions", "version"), ("numbers", "number"), ("entities", "entity"), ("qualifiers", "qualifier")]
    differs = lambda kind: F.array_sort(F.col(f"{before}_{kind}")) != F.array_sort(F.col(f"{after}_{kind}"))
    return F.array_compact(F.array(*(F.when(differs(kind), F.lit(name)) for kind, name in kinds), F.when(F.col(f"{before}_negated") != F.col(f"{after}_negated"), F.lit("negation"))))


def select_by_outcome(options: DataFrame, claim: str = "claim_id", outcome: str = "outcome", score: str = "score", cited: str = "is_citation", option: str = "option_id") -> DataFrame:
    """One row per claim: CONFLICT where options disagree in outcome, else the best option by (score, citation, id)."""
    best = F.max(F.struct(F.col(score), F.col(cited), F.col(option))).alias("best")
    found = options.groupBy(claim).agg(F.count_distinct(outcome).alias("n_outcomes"), F.count(F.lit(1)).alias("n_options"), best)
    return found.select(claim, "n_outcomes", "n_options", F.when(F.col("n_outcomes") > 1, "conflict").otherwise("selected").alias("status"), F.when(F.col("n_outcomes") <= 1, F.col(f"best.{option}")).alias("selected_option"))


def subset_judge(scored: DataFrame, claim: str = "claim_id", least_probability: float = 0.5, least_margin: float = 0.1) -> DataFrame:
    """(claim, relation, indices, probability): the verdict from scored evidence subsets.

    Needs indices (array<int>), entailment, contradiction and neutral per subset. A subset counts for
    a relation with enough probability and margin over the best other label; the best of a relation
    is the most probable, then the widest margin, the smallest, the first. Subsets for both relations
    are a conflict, none is no support.
    """
    others = {"entailed": ("entailment", "contradiction"), "contradicted": ("contradiction", "entailment")}
    rows = None
    for relation, (own, other) in others.items():
        margin = F.col(own) - F.greatest(F.col(other), F.col("neutral"))
        part = scored.where((F.col(own) >= least_probability) & (margin >= least_margin)).select(claim, F.lit(relation).alias("relation"), F.col(own).alias("probability"), margin.alias("margin"), "indices")
        rows = part if rows is None else rows.unionByName(part)
    key = F.struct(F.col("probability"), F.col("margin"), -F.size("indices"), F.transform("indices", lambda i: -i))
    best = rows.groupBy(claim, "relation").agg(F.max_by(F.struct("indices", "probability"), key).alias("b"))
    each = best.groupBy(claim).agg(F.count(F.lit(1)).alias("n"), F.first("relation").alias("r"), F.first("b").alias("b"))
    found = each.select(claim, F.when(F.col("n") > 1, "conflict").otherwise(F.col("r")).alias("relation"), F.when(F.col("n") == 1, F.col("b.indices")).alias("indices"), F.when(F.col("n") == 1, F.col("b.probability")).alias("probability"))
    return scored.select(claim).distinct().join(found, claim, "left").na.fill({"relation": "not_in_source"})


def gate(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """``metrics`` with ``achieved`` and the names of those under their floor (null counts as under)."""
    under = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(name) >= least, F.lit(False)), F.lit(name)) for name, least in sorted(floors.items()))))
    return metrics.withColumn("under_floor", under).withColumn("achieved", F.size("under_floor") == 0)
