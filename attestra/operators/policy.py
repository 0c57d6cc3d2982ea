"""Suppression, effective severity, action plans and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import spans
from attestra.operators.verdicts import SEVERITIES

#: Relations that a counter-search may still settle.
UNRESOLVED = ["not_in_source", "source_unavailable", "partially_entailed"]


def suppressed(claims: DataFrame, directives: DataFrame, scope: str, key: str, ignored_types: list[str], size: int = 256) -> DataFrame:
    """Claims with ``suppression_kind`` (directive, claim_type or null), ``suppression_id`` and ``reason``.

    Claims have a half-open span (c_start, c_end) and a claim_type, directives a target (d_start, d_end),
    an ordinal in document order, suppression_id and reason. The first directive that overlaps a claim
    counts; a claim type that the policy ignores counts where none does.
    """
    found = spans.overlapping(claims, directives, scope, size, ("c_start", "c_end"), ("d_start", "d_end"))
    first = found.groupBy(scope, key).agg(F.min(F.struct("ordinal", "suppression_id", "reason")).alias("d"))
    by_type = F.col("claim_type").isin(ignored_types) if ignored_types else F.lit(False)
    joined = claims.join(first, [scope, key], "left")
    kind = F.when(F.col("d").isNotNull(), "directive").when(by_type, "claim_type")
    reason = F.coalesce(F.col("d.reason"), F.when(by_type, F.concat(F.lit("claim type ignored by policy: "), "claim_type")))
    return joined.withColumns({"suppression_kind": kind, "suppression_id": F.col("d.suppression_id"), "suppression_reason": reason}).drop("d")


def effective(severity: Column, kind: Column) -> Column:
    """The severity that counts: none for a suppressed claim."""
    return F.when(kind.isNull(), severity)


def exit_codes(decisions: DataFrame, scope: str, severity: str = "effective_severity", threshold: str = "error") -> DataFrame:
    """(scope, exit_code): 1 where any severity that counts reaches the threshold, else 0."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c)
    fails = F.coalesce(rank(F.col(severity)) >= SEVERITIES.index(threshold) + 1, F.lit(False))
    return decisions.groupBy(scope).agg(F.bool_or(fails).cast("int").alias("exit_code"))


def _within(test: Column, window, limit: int) -> Column:
    """Whether a row is among the first ``limit`` rows of its window that pass ``test``."""
    return test & (F.sum(F.when(test, 1).otherwise(0)).over(window) <= limit)


def initial_plan(claims: DataFrame, scope: str, order: str, discover: bool, limit: int) -> DataFrame:
    """Claims with ``action``: skip what cannot be checked, verify citations, discover for the first ``limit`` others, ask a person for the rest."""
    window = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    open_ = (F.col("checkability") != "not_checkable") & (F.col("n_citations") == 0) & F.lit(discover)
    action = F.when(F.col("checkability") == "not_checkable", "skip_not_checkable").when(F.col("n_citations") > 0, "verify_citation").when(_within(open_, window, limit), "discover").otherwise("request_human")
    return claims.withColumn("action", action)


def review_plan(claims: DataFrame, scope: str, order: str, discover: bool, limit: int) -> DataFrame:
    """Claims with ``action`` after a first verdict: a person for what failed, a counter-search for the first ``limit`` unsettled ones, a challenge for risky ones, else accept."""
    window = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("status") == "completed"
    open_ = done & F.lit(discover) & ~F.col("used_scout") & F.coalesce(F.col("relation").isin(UNRESOLVED), F.lit(False))
    action = F.when(~done, "request_human").when(_within(open_, window, limit), "counter_search").when(F.col("relation").isNotNull() & F.col("high_risk"), "challenge").otherwise("accept")
    return claims.withColumn("action", action)


def plan_violations(plan: DataFrame, claims: DataFrame, allowed: list[str]) -> DataFrame:
    """(claim_id, violation): claims without a task, tasks without a claim, claims with several tasks, actions that the stage does not allow, verifications without a citation."""
    kinds = [
        claims.join(plan, "claim_id", "left_anti").select("claim_id", F.lit("missing_task").alias("violation")),
        plan.join(claims, "claim_id", "left_anti").select("claim_id", F.lit("unknown_claim").alias("violation")),
        plan.groupBy("claim_id").count().where("count > 1").select("claim_id", F.lit("duplicate_task").alias("violation")),
        plan.where(~F.col("action").isin(allowed)).select("claim_id", F.lit("action_not_allowed").alias("violation")),
        plan.where("action = 'verify_citation'").join(claims.where("n_citations = 0"), "claim_id", "left_semi").select("claim_id", F.lit("no_citation").alias("violation")),
    ]
    out = kinds[0]
    for kind in kinds[1:]:
        out = out.unionByName(kind)
    return out


def search_plan_ok(queries: Column, claim: Column, generic: list[str]) -> Column:
    """Whether a search plan keeps the claim itself as a query and no query brings in words that neither the claim nor the general list has."""
    allowed = F.array_union(T.token_set(claim), F.array(*map(F.lit, generic)) if generic else F.array().cast("array<string>"))
    return F.array_contains(queries, claim) & F.forall(queries, lambda q: F.size(F.array_except(T.token_set(q), allowed)) == 0)


def context_bytes(fields: dict[str, Column]) -> Column:
    """UTF-8 bytes of a payload as JSON with sorted names and no spaces."""
    return F.octet_length(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}))


def quadrant(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Which of two systems is right: both, only one, or none."""
    return F.when(a & b, "both_correct").when(a, f"{names[0]}_only_correct").when(b, f"{names[1]}_only_correct").otherwise("both_wrong")


def error_category(correct: Column, ambiguous: Column, gold: Column, exact_hit: Column, partial: Column, calls: Column, available: Column) -> Column:
    """The cause of a wrong verdict: the first that applies; null for right ones."""
    missed = gold.isNotNull() & ~F.coalesce(exact_hit, F.lit(False))
    return (
        F.when(~correct & ambiguous, "annotation_or_translation_ambiguity").when(~correct & missed & F.coalesce(partial, F.lit(False)), "retrieval_partial_context").when(~correct & missed, "retrieval_miss")
        .when(~correct & (calls == 0) & available, "deterministic_router_error").when(~correct & (calls > 0), "judge_error_with_sufficient_evidence").when(~correct, "unsupported_other")
    )


def scope_violation(same_claim: Column, same_source: Column, spans_real: Column, relation: Column, available: Column, blocking: Column, n_spans: Column) -> Column:
    """The first rule that a judge's verdict breaks, or null."""
    return (
        F.when(~same_claim, "claim_id_mismatch").when(~same_source, "source_id_out_of_scope").when(~spans_real, "evidence_span_out_of_scope").when((relation == "source_unavailable") & available, "source_availability_mismatch")
        .when(blocking & (relation == "entailed"), "deterministic_conflict").when(relation.isin("entailed", "partially_entailed", "contradicted") & (n_spans == 0), "missing_substantive_evidence")
    )


def repair_inputs(verdicts: DataFrame, spans_: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, selected, reason): contradicted claims with exactly one span from the selected source and exactly one scalar pair; the first reason that stands against it otherwise.

    ``verdicts``: claim_id, relation, source_id, scalar_in_lines; ``spans_``: claim_id, source_id; ``pairs``: claim_id, n_pairs.
    """
    count = spans_.groupBy("claim_id", "source_id").agg(F.count(F.lit(1)).alias("n_spans"))
    joined = verdicts.join(count, ["claim_id", "source_id"], "left").join(pairs, "claim_id", "left")
    reason = (
        F.when(F.col("relation") != "contradicted", "not_contradicted").when(F.coalesce("n_spans", F.lit(0)) != 1, "span_count").when(F.coalesce("n_pairs", F.lit(0)) != 1, "scalar_pair_count")
        .when(~F.coalesce("scalar_in_lines", F.lit(False)), "scalar_not_in_lines")
    )
    return joined.select("claim_id", reason.isNull().alias("selected"), reason.alias("reason"))
