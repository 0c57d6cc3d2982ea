"""Bounded windows of paragraphs, protected literals with offsets, and spans that must map in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T

_BOUNDARY = re.compile(r"(?:(?<=[!?;。！？；])\s*|(?<=\.)\s+)")
_PIECE = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def fragments(text: str, whole: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, int, int]]:
    """Trimmed sentence fragments with their offsets; no boundary falls strictly inside a range that must stay whole."""
    at = 0
    edges = [m.span() for m in _BOUNDARY.finditer(text) if not any(a < m.start() < b for a, b in whole or [])]
    for end, after in [*edges, (len(text), len(text))]:
        piece = text[at:end]
        start = at + len(piece) - len(piece.lstrip())
        if piece.strip():
            yield piece.strip(), start, start + len(piece.strip())
        at = after


@T.arrow("array<struct<text:string,start:int,end:int>>")
def fragment_spans(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Fragments of a text; ``ranges`` (array of start, end; may be null) stay whole."""
    out = []
    for text, whole in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
        out.append([{"text": t, "start": a, "end": b} for t, a, b in fragments(text or "", [(x["start"], x["end"]) for x in whole or []])])
    return pa.array(out, pa.list_(_PIECE))


def plan_windows(paragraphs: DataFrame, most: int, key: str = "paragraph_id", text: str = "text", ranges: Column | None = None) -> DataFrame:
    """(key, status, window_id, text, start, end, oversized): every fragment as a window, none cut.

    A paragraph's status is oversized if any fragment is longer than ``most``, ready if it has
    fragments, else intentional_empty (one row without a window).
    """
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    each = paragraphs.select(key, fragment_spans(F.coalesce(F.col(text), F.lit("")), ranges if ranges is not None else none).alias("f"))
    over = F.exists("f", lambda x: F.length(x["text"]) > most)
    status = F.when(over, "oversized").when(F.size("f") > 0, "ready").otherwise("intentional_empty")
    rows = each.select(key, status.alias("status"), F.posexplode_outer("f").alias("pos", "w"))
    return rows.select(key, "status", F.when(F.col("pos").isNotNull(), F.format_string("%s_w_%04d", F.col(key).cast("string"), F.col("pos") + 1)).alias("window_id"), "w.text", "w.start", "w.end", (F.length("w.text") > most).alias("oversized"))


_PROTECTED = re.compile(T.PROTECTED)


@T.arrow("array<struct<key:string,start:int,end:int>>")
def protected_spans(texts: pa.Array) -> pa.Array:
    """Protected literals with their offsets; the key is in lower case and single-spaced."""
    out = [[{"key": re.sub(r"\s+", " ", m[0].casefold()), "start": m.start(), "end": m.end()} for m in _PROTECTED.finditer(t or "")] for t in texts.to_pylist()]
    return pa.array(out, pa.list_(pa.struct([("key", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def span_coverage(occurrences: Column, spans: Column) -> Column:
    """How many occurrences lie wholly inside any of the spans (start, end)."""
    return F.size(F.filter(occurrences, lambda o: F.exists(spans, lambda s: (s["start"] <= o["start"]) & (o["end"] <= s["end"]))))


def ordered_spans(text: str, drafts: list[str]) -> tuple[str, list[tuple[int, int]] | None]:
    """Where drafts lie in a text in order: mapped if the earliest and the latest placement agree, else ambiguous or non_source."""
    early, at = [], 0
    for draft in drafts:
        found = text.find(draft, at)
        if found < 0:
            return "non_source", None
        early.append((found, found + len(draft)))
        at = found + len(draft)
    late, bound = [], len(text)
    for draft in reversed(drafts):
        found = text.rfind(draft, 0, bound)
        late.append((found, found + len(draft)))
        bound = found
    return ("mapped", early) if early == late[::-1] else ("ambiguous", None)


@T.arrow("status string, spans array<struct<start:int,end:int>>")
def monotonic_spans(texts: pa.Array, drafts: pa.Array) -> pa.Array:
    out = []
    for text, some in zip(texts.to_pylist(), drafts.to_pylist(), strict=True):
        status, places = ordered_spans(text or "", some or [])
        out.append({"status": status, "spans": None if places is None else [{"start": a, "end": b} for a, b in places]})
    return pa.array(out, pa.struct([("status", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))


# The scalar tokens that route evidence, in the order in which they claim characters.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
ROUTING = [
    ("date", re.compile(rf"\b(?:\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}|(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}|\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b", re.I)),
    ("semver", re.compile(r"(?<![A-Za-z0-9])v?\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?(?![A-Za-z0-9])")),
    ("percent", re.compile(r"(?<![\w.])\d+(?:\.\d+)?%(?!\w)")),
    ("number", re.compile(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.%])")),
]


@T.arrow("array<struct<kind:string,token:string>>")
def routing_tokens(texts: pa.Array) -> pa.Array:
    """Scalar tokens in order of place; characters that an earlier kind has are not taken again."""
    out = []
    for text in texts.to_pylist():
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern in ROUTING:
            fresh = [m for m in pattern.finditer(text or "") if not any(m.start() < b and a < m.end() for a, b, *_ in taken)]
            taken += [(m.start(), m.end(), kind, m[0].casefold()) for m in fresh]
        out.append([{"kind": kind, "token": token} for _, _, kind, token in sorted(taken)])
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string())])))
