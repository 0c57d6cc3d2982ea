"""Deterministic signals between a claim and its evidence, as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T

SIGNAL = "array<struct<code:string,severity:string>>"
HARD = ["numeric_mismatch", "date_mismatch", "version_mismatch", "entity_mismatch", "negation_mismatch"]
CAUTION = ["comparison_reminder", "qualifier_mismatch", "conjunction_mismatch"]
SLOT = ["numeric_mismatch", "date_mismatch", "version_mismatch"]
OPPOSED = [(["only"], ["all", "every"]), (["at least"], ["at most"]), (["narrow"], ["wide"]), (["premium"], ["standard"])]


def aligned_clause(claim: Column, evidence: Column) -> Column:
    """The evidence clause that shares most words with a claim without ``and`` or ``or``; the first of equals. A compound claim takes all evidence."""
    clauses = F.filter(F.transform(F.split(evidence, T.CLAUSE), F.trim), lambda x: x != "")
    score = lambda own: F.transform(clauses, lambda c, i: F.struct(F.size(F.array_intersect(own, T.words(c))).alias("shared"), (-i).alias("place"), c.alias("clause")))
    best = T.let(T.words(claim), lambda own: F.array_max(score(own)))
    return F.when(claim.rlike(T.CONJUNCTION), evidence).otherwise(F.coalesce(best["clause"], evidence))


#: Slots read from a text, and those made from others.
SLOTS = {"dates": T.dates, "versions": T.versions, "numbers": T.numbers, "words": T.words, "entities": T.entities, "qualifiers": T.qualifiers, "negated": lambda text: text.rlike(T.NEGATION)}


def with_slots(rows: DataFrame, texts: dict[str, Column], only: dict[str, list[str]] | None = None) -> DataFrame:
    """``rows`` with the slot columns ``<prefix>_<slot>`` of each text, all worked out once; ``only`` names a prefix's slots."""
    wanted = {p: (only or {}).get(p, [*SLOTS, "context"]) for p in texts}
    made = T.once(rows, {f"{p}_{k}": SLOTS[k](text) for p, text in texts.items() for k in wanted[p] if k != "context"})
    context = lambda p: T.context_words(*(F.col(f"{p}_{k}") for k in ("words", "entities", "versions", "numbers")))
    late = {f"{p}_context": context(p) for p in texts if "context" in wanted[p]}
    return T.once(made, late) if late else made


def _aligned(left: str, right: str) -> Column:
    """Whether the contexts of two texts align: two shared words that make up half of the smaller, or one with a shared entity or version."""
    a, b = F.col(f"{left}_context"), F.col(f"{right}_context")
    shared, smaller = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    same = lambda kind: F.size(F.array_intersect(F.col(f"{left}_{kind}"), F.col(f"{right}_{kind}"))) > 0
    return ((shared >= 2) & (shared * 2 >= smaller)) | ((shared > 0) & (same("entities") | same("versions")))


def _differs(kind: str) -> Column:
    claim, source = F.col(f"c_{kind}"), F.col(f"e_{kind}")
    return (F.size(claim) > 0) & (F.size(source) > 0) & (F.size(F.array_except(claim, source)) > 0)


def with_signals(pairs: DataFrame, claim: str = "claim_text", evidence: str = "evidence_text", context: str | None = None) -> DataFrame:
    """``pairs`` with ``aligned_evidence``, ``signals`` (code and severity, in fixed order) and slot columns.

    ``context`` names all evidence text that was given with the pair (the evidence itself if null).
    Null texts count as empty.
    """
    c, e = F.coalesce(F.col(claim), F.lit("")), F.coalesce(F.col(evidence), F.lit(""))
    wide = F.coalesce(F.col(context), e) if context else None
    base = T.once(pairs, {"aligned_evidence": aligned_clause(c, e)})
    texts = {"c": c, "e": F.col("aligned_evidence"), "f": e} | ({"w": wide} if context else {})
    base = with_slots(base, texts, {"w": ["entities"], "f": ["versions", "numbers", "words", "entities", "context"]})
    base = base if context else base.withColumn("w_entities", F.col("f_entities"))
    disjoint = lambda other: F.size(F.array_intersect("c_entities", other)) == 0
    entity = (F.size("c_entities") > 0) & (F.size("e_entities") > 0) & disjoint("e_entities") & disjoint("w_entities") & _aligned("c", "e")
    any_of = lambda column, some: F.size(F.array_intersect(column, F.array(*map(F.lit, some)))) > 0
    cq, eq = F.col("c_qualifiers"), F.col("e_qualifiers")
    opposed = F.lit(False)
    for left, right in OPPOSED:
        opposed = opposed | (any_of(cq, left) & any_of(eq, right)) | (any_of(cq, right) & any_of(eq, left))
    qualifier = (cq != eq) & _aligned("c", "e")
    parts = F.filter(F.transform(F.split(c, T.CONJUNCTION), T.words), lambda w: F.size(w) > 0)
    covered = F.transform(parts, lambda w: T.coverage(w, F.col("f_words")) >= 0.75)
    missing = (F.size(F.split(c, T.CONJUNCTION)) >= 2) & (F.size(covered) >= 2) & F.exists(covered, lambda x: x) & F.exists(covered, lambda x: ~x)
    signal = lambda test, code, severity: F.when(test, F.struct(F.lit(code).alias("code"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))
    found = [
        signal(_differs("dates"), "date_mismatch", "error"), signal(_differs("versions"), "version_mismatch", "error"), signal(_differs("numbers"), "numeric_mismatch", "error"),
        signal((F.col("c_negated") != F.col("e_negated")) & _aligned("c", "e"), "negation_mismatch", "error"), signal(entity, "entity_mismatch", "error"),
        signal(qualifier, "qualifier_mismatch", F.when(opposed, "error").otherwise("warning")), signal(_aligned("c", "f") & missing, "conjunction_mismatch", "warning"), signal(c.rlike(T.COMPARISON), "comparison_reminder", "notice"),
    ]
    return T.once(base, {"signals": F.array_compact(F.array(*found))})


def codes(signals: Column) -> Column:
    return F.transform(signals, lambda s: s["code"])


def has(signals: Column, some: list[str]) -> Column:
    return F.arrays_overlap(codes(signals), F.array(*map(F.lit, some)))
