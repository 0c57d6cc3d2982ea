"""Scalar repairs: unit signatures, replacements in the target's own style, edits and their diffs."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.parse import _MONTHS, scalars
from attestra.operators.spans import clashing

# Currencies before a number and words after one that are no unit.
_CURRENCY = re.compile(r"(?:([$€£¥₹])[ \t]*|(USD|EUR|GBP|JPY|CNY|RMB|INR)[ \t]+)$")
_UNIT = re.compile(r"([ \t]*)([A-Za-zµμ°][A-Za-z0-9µμ°²³^*/_-]*)")
NO_UNITS = {
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "in", "is", "may", "might", "must", "of", "on", "or", "should", "than", "that", "the", "then",
    "this", "to", "was", "were", "which", "will", "with", "would",
}

EDIT = "path string, original string, replacement string, char_start int, char_end int, reason string"


def unit_of(text: str, scalar: dict) -> str | None:
    """Currency before and unit after a plain number; ``%`` for percentages; none for dates and versions."""
    if scalar["kind"] == "percentage":
        return "suffix:%"
    if scalar["kind"] not in ("integer", "decimal"):
        return None
    units = []
    if before := _CURRENCY.search(text[: scalar["start"]]):
        units.append(f"prefix:{before[1] or before[2]}")
    if (after := _UNIT.match(text[scalar["end"] :])) and (not after[1] or after[2].casefold() not in NO_UNITS):
        units.append(f"suffix:{after[2]}")
    return "|".join(units) or None


def date_family(raw: str) -> str | None:
    return "ymd" if re.match(r"\d{4}[-/]", raw) else "month_first" if re.match(r"[A-Za-z]", raw) else "day_first" if re.search("[A-Za-z]", raw) else None


def rendered(target: dict, evidence: dict) -> str:
    """The evidence's value written as the target is: percent gap, date family, separator, month case and day width."""
    if target["kind"] == "percentage":
        number = re.match(r"[+-]?[\d.]+", evidence["raw"])[0]
        return number + re.search(r"[ \t]*%$", target["raw"])[0]
    if target["kind"] != "date":
        return evidence["raw"]
    day = date.fromisoformat(evidence["value"])
    if date_family(target["raw"]) == "ymd":
        mark = target["raw"][4]
        return f"{day.year:04d}{mark}{day.month:02d}{mark}{day.day:02d}"
    name, old = _MONTHS[day.month - 1], re.search("[A-Za-z]+", target["raw"])[0]
    name = name.upper() if old.isupper() else name.lower() if old.islower() else name
    width = len(re.search(r"(?<!\d)\d{1,2}(?!\d)", target["raw"])[0])
    number = f"{day.day:02d}" if width == 2 else str(day.day)
    out = re.sub("[A-Za-z]+", name, target["raw"], count=1)
    out = re.sub(r"(?<!\d)\d{1,2}(?!\d)", number, out, count=1)
    return re.sub(r"\d{4}$", f"{day.year:04d}", out)


def planned(claim: str, evidence: str) -> tuple[str, str, str | None, tuple[int, int] | None]:
    """(reason, original, replacement, span): ready where both texts hold one scalar of one kind and unit with different values."""
    a, b = scalars(claim or ""), scalars(evidence or "")
    if len(a) != 1 or len(b) != 1:
        return "not_one_scalar_each", "", None, None
    x, y = a[0], b[0]
    if x["kind"] != y["kind"] or (x["kind"] == "date" and date_family(x["raw"]) != date_family(y["raw"])):
        return "kinds_differ", x["raw"], None, None
    if unit_of(claim, x) != unit_of(evidence, y):
        return "units_differ", x["raw"], None, None
    if x["value"] == y["value"]:
        return "agrees", x["raw"], None, None
    return "ready", x["raw"], rendered(x, y), (x["start"], x["end"])


def plan(claims: DataFrame) -> DataFrame:
    """Edits of claims (path, claim_start, claim_text, evidence_text), with offsets in their file; see ``EDIT``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start, claim, evidence in batch.itertuples(index=False):
                reason, old, new, span = planned(claim, evidence)
                rows.append((path, old, new, None if span is None else int(start) + span[0], None if span is None else int(start) + span[1], reason))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDIT.split(", ")]).astype({"char_start": "Int32", "char_end": "Int32"})

    return claims.select("path", "claim_start", "claim_text", "evidence_text").mapInPandas(run, EDIT)


def unique_occurrence(text: str, span: str) -> int | None:
    """The place of the only occurrence, overlapping ones counted; none otherwise."""
    first = text.find(span) if span else -1
    return first if first >= 0 and text.find(span, first + 1) < 0 else None


def applied(text: str, edits: list[tuple[int, int, str]]) -> str | None:
    """The text after all edits, or none if two overlap or undoing them does not give the text back."""
    ordered = sorted(edits)
    if any(b[0] < a[1] for a, b in zip(ordered, ordered[1:], strict=False)):
        return None
    out, at, back = [], 0, []
    for start, end, new in ordered:
        out += [text[at:start], new]
        back.append((sum(map(len, out)) - len(new), len(new), text[start:end]))
        at = end
    made = "".join([*out, text[at:]])
    undone = made
    for start, size, old in reversed(back):
        undone = undone[:start] + old + undone[start + size :]
    return made if undone == text else None


def unified(before: str, after: str, path: str) -> str:
    lines = difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{path}", f"b/{path}")
    return "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in lines)


def diffs(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, status, diff) for each file (path, text) with ready edits; a file's edits are one group."""
    ready = edits.where("reason = 'ready'").groupBy("path").agg(F.collect_set(F.struct("char_start", "char_end", "replacement")).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, some in batch.itertuples(index=False):
                after = applied(text, [(e["char_start"], e["char_end"], e["replacement"]) for e in some])
                rows.append((path, "overlap" if after is None else "applied", None if after is None else unified(text, after, path)))
            yield pd.DataFrame(rows, columns=["path", "status", "diff"])

    return files.join(ready, "path").select("path", "text", "edits").mapInPandas(run, "path string, status string, diff string")


def signature(claim: str | None, evidence: str | None) -> tuple[str, str, str | None] | None:
    """(kind, value, unit) of the evidence's scalar, where both texts hold exactly one, of one kind, date family and unit; equal values too."""
    a, b = scalars(claim or ""), scalars(evidence or "")
    if len(a) != 1 or len(b) != 1 or a[0]["kind"] != b[0]["kind"] or (a[0]["kind"] == "date" and date_family(a[0]["raw"]) != date_family(b[0]["raw"])):
        return None
    unit = unit_of(evidence, b[0])
    return (b[0]["kind"], b[0]["value"], unit) if unit_of(claim, a[0]) == unit else None


@T.arrow("kind string, value string, unit string")
def outcome_signature(claims: pa.Array, evidence: pa.Array) -> pa.Array:
    """``signature`` of two text columns, null where there is none: evidence options of one signature agree."""
    found = [signature(c, e) for c, e in zip(claims.to_pylist(), evidence.to_pylist(), strict=True)]
    return pa.array([x and dict(zip(("kind", "value", "unit"), x, strict=True)) for x in found], pa.struct([("kind", pa.string()), ("value", pa.string()), ("unit", pa.string())]))


def decide(proposals: DataFrame) -> DataFrame:
    """Proposals with ``status`` and ``reason``: the first check of the ladder that fails, and overlaps within a file, all of which lose.

    Needs proposal_id, path, relation, challenge, exact (both texts are literal), target_exists, target_current,
    reference_current, occurrences (of the claim in its lines), plan_reason (of ``plan``), protected, char_start, char_end.
    """
    twice = proposals.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n_ids"))
    plan_reason = F.col("plan_reason")
    human = lambda reason: F.struct(F.lit("needs_human").alias("status"), reason.alias("reason"))
    out = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    ladder = (
        F.when(F.col("n_ids") > 1, out("ineligible", "duplicate_proposal_id")).when(F.col("relation") != "contradicted", out("ineligible", "not_contradicted")).when(F.col("challenge") != "uphold", out("ineligible", "not_upheld"))
        .when(~F.col("exact"), out("ineligible", "not_exact")).when(~F.col("target_exists"), out("ineligible", "missing_target")).when(~F.col("target_current"), out("stale_target", "target_hash")).when(~F.col("reference_current"), out("stale_reference", "reference_hash"))
        .when(F.col("occurrences") != 1, human(F.lit("claim_occurrences"))).when(plan_reason.isin("not_one_scalar_each", "kinds_differ", "units_differ"), human(plan_reason)).when(plan_reason == "agrees", out("ineligible", "agrees"))
        .when(F.col("protected"), human(F.lit("protected_location"))).otherwise(out("ready", "ready"))
    )
    judged = proposals.join(twice, "proposal_id").withColumn("d", ladder).select(*proposals.columns, "d.status", "d.reason")
    ready = clashing(judged.where("status = 'ready'"), "path", "char_start", "char_end")
    lost = F.col("clashes")
    ready = ready.withColumns({"status": F.when(lost, "needs_human").otherwise(F.col("status")), "reason": F.when(lost, "overlap").otherwise(F.col("reason"))}).drop("clashes")
    return ready.unionByName(judged.where("status != 'ready'"))
