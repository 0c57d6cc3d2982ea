"""Documents to lines, paragraphs, chunks, citations, headings and diff hunks.

The line, paragraph, sentence and chunk operators are built-in functions; Markdown, HTML and scalar
extraction, whose rules depend on what was consumed before, run per document in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from decimal import Decimal
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from attestra.functions import text as T
from attestra.sources.shared import spread


def lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, offset_start, offset_end, line): 1-based lines with half-open character offsets; null text has none.

    A text's lines are numbered where the text is read, so no line is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, made, numbers = [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                if value is None:
                    continue
                each = value.split("\n")
                ends = list(accumulate(len(x) + 1 for x in each))
                rows += [k] * len(each)
                numbers += range(1, len(each) + 1)
                starts += [0, *ends[:-1]]
                made += each
            stops = [a + len(x) for a, x in zip(starts, made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(made, pa.string())], names=["doc", "line_no", "offset_start", "offset_end", "line"])

    kind = docs.schema[doc].dataType.simpleString()
    return spread(docs).select(F.col(doc).alias("doc"), text).mapInArrow(run, f"doc {kind}, line_no int, offset_start bigint, offset_end bigint, line string").withColumnRenamed("doc", doc)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text", gap: str = r"\n[ \t]*\n\s*") -> DataFrame:
    """(doc, paragraph_id, ordinal, paragraph): blocks parted by blank lines, trimmed."""
    each = docs.select(doc, F.posexplode(F.filter(F.transform(F.split(text, gap), lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != "")).alias("ordinal", "paragraph"))
    return each.withColumn("ordinal", F.col("ordinal") + 1).withColumn("paragraph_id", F.format_string("p_%04d", F.col("ordinal")))


def sentence_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, chunk_id, text): one chunk a sentence, numbered from 0."""
    return docs.select(doc, F.posexplode(T.sentences(F.col(text))).alias("chunk_id", "text"))


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def bounded_spans(texts: pd.Series, chars: pd.Series, size: pd.Series) -> pd.Series:
    """Chunks of at most so many characters and bytes, broken at the last white space inside, trimmed."""

    def cut(text: str | None, most: int, bytes_most: int) -> list[tuple[int, int]]:
        out, at = [], 0
        text = text or ""
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            end = min(len(text), at + most)
            while len(text[at:end].encode()) > bytes_most:
                end -= max(1, (len(text[at:end].encode()) - bytes_most) // 4)
            stop = end
            if end < len(text) and not text[end].isspace():
                space = next((k for k in range(end - 1, at, -1) if text[k].isspace()), None)
                stop = space if space is not None else end
            tail = stop
            while tail > at and text[tail - 1].isspace():
                tail -= 1
            out.append((at, tail))
            at = stop
        return out

    return pd.Series([[{"start": a, "end": b} for a, b in cut(t, c, s)] for t, c, s in zip(texts, chars, size, strict=True)])


def bounded_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", chars: int = 2000, size: int = 8000) -> DataFrame:
    spans = docs.select(doc, text, F.posexplode(bounded_spans(F.col(text), F.lit(chars), F.lit(size))).alias("chunk_id", "span"))
    return spans.select(doc, "chunk_id", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), F.substring(F.col(text), F.col("span.start") + 1, F.col("span.end") - F.col("span.start")).alias("text"))


def heading_path(headings: Column) -> Column:
    """The path after a list of (level, title): each heading cuts the path to ``level - 1`` entries and adds itself."""
    return F.aggregate(headings, F.array().cast("array<string>"), lambda path, h: F.array_append(F.slice(path, 1, h["level"] - 1), h["title"]))


def subsets(rows: DataFrame, items: str, most: int = 5) -> DataFrame:
    """One row for each non-empty subset of at most ``most`` items (31 at most)."""
    n = F.least(F.size(items), F.lit(most))
    masks = rows.withColumn("mask", F.explode(F.when(n > 0, F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int")))))
    return masks.withColumn("subset", F.filter(F.slice(items, 1, most), lambda x, i: F.getbit("mask", i) == 1))


# -- Markdown -----------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"( *)(?:[-+*]|\d{1,9}[.)])[ \t]+(.*)$")
_DEFINITION = re.compile(r" {0,3}\[(\^?[^\]\n]+)\]:[ \t]*(\S.*)?$")
_COMMENT = re.compile(r"<!--(.*?)-->", re.S)
_REASON = re.compile(r"\breason\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_CODE = re.compile(r"(`+)(?:(?!\1).)+?\1", re.S)
_INLINE = re.compile(r"(!?)\[((?:\\.|[^\[\]\\])*)\](?:\(\s*<?([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)>?(?:\s+[\"'(].*?[\"')])?\s*\)|\[((?:\\.|[^\[\]\\])*)\])?")
_AUTO = re.compile(r"<((?:https?|ftp)://[^\s<>]+|[\w.+-]+@[\w.-]+)>")
_BARE = re.compile(r"(?<![\w(<\[\"'/])https?://[^\s<>\"'`]+", re.I)
PARAGRAPH = "doc_id bigint, ordinal int, kind string, line_start int, line_end int, heading_path array<string>, raw_text string, plain_text string"
CITATION = "doc_id bigint, ordinal int, kind string, line int, label string, reference_key string, destination string"


def trim_bare_url(url: str) -> str:
    """Drop trailing punctuation, then closers that have no opener inside; punctuation before a closer stays."""
    url = url.rstrip(".,;:!?")
    while url and (opener := {")": "(", "]": "[", "}": "{"}.get(url[-1])) and url.count(url[-1]) > url.count(opener):
        url = url[:-1]
    return url


def reference_key(label: str) -> str:
    return re.sub(r"\s+", " ", unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", label))).strip().casefold()


def markdown_blocks(text: str) -> tuple[list[dict], list[dict], list[int]]:
    """Paragraphs, definitions and the lines in code blocks of a Markdown text; lines that are comments alone part paragraphs."""
    rows, definitions, code, path = [], [], [], []
    held: list[tuple[int, str]] = []
    kind, fence = "paragraph", None

    def close() -> None:
        nonlocal held, kind
        if held:
            raw = "\n".join(x for _, x in held)
            rows.append({"kind": kind, "line_start": held[0][0], "line_end": held[-1][0], "heading_path": list(path), "raw_text": raw, "plain_text": plain(raw)})
        held, kind = [], "paragraph"

    for number, line in enumerate(text.split("\n"), 1):
        if fence:
            code.append(number)
            if re.match(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", line):
                fence = None
            continue
        if found := _FENCE.match(line):
            close()
            fence = found[1]
        elif not line.strip():
            close()
        elif found := _HEADING.match(line):
            close()
            path = [*path[: len(found[1]) - 1], (found[2] or "").strip()]
        elif not held and (found := _DEFINITION.match(line)):
            definitions.append({"kind": "footnote" if found[1].startswith("^") else "reference", "key": reference_key(found[1].lstrip("^")), "destination": (found[2] or "").strip(), "line": number})
        elif _COMMENT.fullmatch(line.strip()):
            close()
        elif not held and line.startswith("    "):
            code.append(number)
        elif found := _ITEM.match(line):
            close()
            kind = "list_item"
            held.append((number, found[2]))
        elif line.lstrip().startswith(">"):
            if kind != "blockquote":
                close()
            kind = "blockquote"
            held.append((number, re.sub(r"^\s*>\s?", "", line)))
        else:
            held.append((number, line.strip()))
    close()
    return rows, definitions, code


SUPPRESSION = "doc_id bigint, suppression_id string, scope string, reason string, line int, target_start int, target_end int, problem string"


def bind_directives(text: str, marker: str) -> list[dict]:
    """Directives ``<!-- marker: ignore reason="..." -->`` with the lines they cover.

    One alone on its line covers the next paragraph, if only blank lines and other directives stand
    between; one beside text covers its line. Others carry a ``problem``: unsupported_action,
    invalid_reason or orphan. Comments in code blocks are none.
    """
    rows, _, code = markdown_blocks(text)
    lines, hidden = text.split("\n"), {*code}
    found, alone = [], set()
    for m in _COMMENT.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        inner = m[1].strip()
        if line in hidden or not inner.startswith(f"{marker}:"):
            continue
        action, _, rest = inner[len(marker) + 1 :].strip().partition(" ")
        given = _REASON.search(rest)
        reason = ((given[1] if given[1] is not None else given[2]) or "").strip() if given else ""
        row = {"scope": None, "reason": reason, "line": line, "target_start": None, "target_end": None, "problem": None}
        if action != "ignore":
            row["problem"] = "unsupported_action"
        elif not reason:
            row["problem"] = "invalid_reason"
        elif lines[line - 1].strip() != m[0].strip():
            row |= {"scope": "line", "target_start": line, "target_end": line}
        else:
            alone.add(line)
            row["scope"] = "paragraph"
        found.append(row)
    for row in found:
        if row["scope"] == "paragraph":
            target = next((x for x in rows if x["line_start"] > row["line"]), None)
            between = range(row["line"] + 1, target["line_start"]) if target else ()
            if target is None or any(lines[k - 1].strip() and k not in alone for k in between):
                row |= {"scope": None, "problem": "orphan"}
            else:
                row |= {"target_start": target["line_start"], "target_end": target["line_end"]}
    good = [x for x in found if not x["problem"]]
    return [x | {"suppression_id": f"sup_{good.index(x) + 1:04d}" if not x["problem"] else None} for x in found]


def suppressions(docs: DataFrame, marker: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All suppression directives of the documents, bound to their lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"doc_id": d, **x} for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in bind_directives(t or "", marker)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUPPRESSION.split(", ")]).astype({"target_start": "Int32", "target_end": "Int32"})

    return docs.select(F.col(doc).cast("bigint"), text).mapInPandas(run, SUPPRESSION)


_BARE_URL = re.compile(r"https?://[^\s<>\"']+")
_EMPHASIS = re.compile(r"(\*\*|__|\*|(?<!\w)_|~~)(?=\S)(.+?)(?<=\S)\1", re.S)


def visible(raw: str, first_line: int) -> tuple[str, list[dict]]:
    """The text a model is shown and its source map: runs (start, end, line) of characters from one source line.

    Footnote marks, images, link targets, URLs, comments and marks of emphasis and code are left out;
    white space collapses, and a space maps to the line where it begins.
    """
    keep = bytearray(b"\1" * len(raw))

    def drop(a: int, b: int) -> None:
        keep[a:b] = bytes(b - a)

    code = [m.span() for m in _CODE.finditer(raw)]
    inside = lambda at: any(a <= at < b for a, b in code)
    for m in _CODE.finditer(raw):
        drop(m.start(), m.start() + len(m[1]))
        drop(m.end() - len(m[1]), m.end())
    for m in _COMMENT.finditer(raw):
        if not inside(m.start()):
            drop(*m.span())
    for m in _INLINE.finditer(raw):
        if inside(m.start()):
            continue
        if m[1] or (m[2].startswith("^") and m[3] is None):
            drop(*m.span())
        else:
            drop(m.start(), m.start(2))
            drop(m.end(2), m.end())
    for m in [*_AUTO.finditer(raw), *_BARE_URL.finditer(raw)]:
        if not inside(m.start()):
            drop(m.start(), m.start() + len(trim_bare_url(m[0])) if m.re is _BARE_URL else m.end())
    for m in _EMPHASIS.finditer(raw):
        if not inside(m.start()):
            drop(m.start(), m.start(2))
            drop(m.end(2), m.end())
    out: list[tuple[str, int]] = []
    line = first_line
    for char, kept in zip(raw, keep, strict=True):
        if kept or char == "\n":
            if not char.isspace():
                out.append((char, line))
            elif out and out[-1][0] != " ":
                out.append((" ", line))
        line += char == "\n"
    if out and out[-1][0] == " ":
        out.pop()
    segments: list[dict] = []
    for at, (_, where) in enumerate(out):
        if segments and segments[-1]["line"] == where:
            segments[-1]["end"] = at + 1
        else:
            segments.append({"start": at, "end": at + 1, "line": where})
    return "".join(c for c, _ in out), segments


@T.arrow("text string, segments array<struct<start:int,end:int,line:int>>")
def visible_text(raws: pa.Array, lines: pa.Array) -> pa.Array:
    """Columns raw_text and line_start to the text a model is shown, with its source map."""
    made = [visible(raw or "", line or 1) for raw, line in zip(raws.to_pylist(), lines.to_pylist(), strict=True)]
    return pa.array([{"text": t, "segments": s} for t, s in made], pa.struct([("text", pa.string()), ("segments", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32())])))]))


def plain(raw: str) -> str:
    """Text a reader sees: link and image labels, code without ticks, no marks of emphasis, single spaces."""
    text = re.sub(r"<!--.*?-->", " ", raw, flags=re.S)
    out, at = [], 0
    for code in [*_CODE.finditer(text), None]:
        part = text[at : code.start() if code else len(text)]
        part = _INLINE.sub(lambda m: "" if m[1] or (m[2].startswith("^") and m[3] is None) else m[2], part)
        part = re.sub(r"(\*\*|__|\*|(?<!\w)_|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", _AUTO.sub(r"\1", part), flags=re.S)
        out.append(unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", part)))
        if code:
            out.append(code[0].strip("`"))
            at = code.end()
    return re.sub(r"\s+", " ", "".join(out)).strip()


def citations(raw: str) -> list[dict]:
    """Inline, reference, footnote, autolink and bare-URL citations in order; code, images and comments hide theirs."""
    masked = _CODE.sub(lambda m: " " * len(m[0]), re.sub(r"<!--.*?-->", lambda m: " " * len(m[0]), raw, flags=re.S))
    masked = re.sub(r"\\[\[\]<]", "  ", masked)
    out: list[tuple[int, dict]] = []
    taken: list[tuple[int, int]] = []
    for m in _INLINE.finditer(masked):
        taken.append(m.span())
        if m[1]:
            continue
        label = m[2]
        if label.startswith("^") and m[3] is None and m[4] is None:
            out.append((m.start(), {"kind": "footnote", "label": label[1:], "reference_key": reference_key(label[1:]), "destination": None}))
        elif m[3] is not None:
            out.append((m.start(), {"kind": "inline", "label": label, "reference_key": None, "destination": m[3]}))
        else:
            out.append((m.start(), {"kind": "reference", "label": label, "reference_key": reference_key(m[4] or label), "destination": None}))
    for kind, pattern in (("autolink", _AUTO), ("bare_url", _BARE)):
        for m in pattern.finditer(masked):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                taken.append(m.span())
                out.append((m.start(), {"kind": kind, "label": None, "reference_key": None, "destination": trim_bare_url(m[0]) if kind == "bare_url" else m[1]}))
    return [x | {"offset": at} for at, x in sorted(out, key=lambda x: x[0])]


def markdown_paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"doc_id": d, "ordinal": k, **x} for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for k, x in enumerate(markdown_blocks(t or "")[0], 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAGRAPH.split(", ")])

    return docs.select(F.col(doc).cast("bigint"), text).mapInPandas(run, PARAGRAPH)


def markdown_citations(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Citations of every paragraph; unresolved reference keys are those that no definition has (see ``resolve``)."""

    def of(d: int, t: str) -> Iterator[dict]:
        number = 0
        for block in markdown_blocks(t or "")[0]:
            for found in citations(block["raw_text"]):
                if found["kind"] == "reference" and not re.search(rf"\[{re.escape(found['label'])}\]", block["raw_text"]):
                    continue
                number += 1
                line = block["line_start"] + block["raw_text"][: found["offset"]].count("\n")
                yield {"doc_id": d, "ordinal": number, "line": line, **{k: found[k] for k in ("kind", "label", "reference_key", "destination")}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in of(d, t)], columns=[c.split()[0] for c in CITATION.split(", ")])

    return docs.select(F.col(doc).cast("bigint"), text).mapInPandas(run, CITATION)


def markdown_definitions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, key, destination, line, duplicate): the first definition of a key counts, later ones are duplicates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"doc_id": d, **x} for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in markdown_blocks(t or "")[1]]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "key", "destination", "line"])

    found = docs.select(F.col(doc).cast("bigint"), text).mapInPandas(run, "doc_id bigint, kind string, key string, destination string, line int")
    return found.withColumn("duplicate", F.row_number().over(Window.partitionBy("doc_id", "kind", "key").orderBy("line")) > 1)


def resolve(cites: DataFrame, definitions: DataFrame) -> DataFrame:
    """Citations with the destination of their definition; ``resolved`` is false where there is none."""
    known = definitions.where("not duplicate").select("doc_id", F.col("key").alias("reference_key"), F.when(F.col("kind") == "footnote", "footnote").otherwise("reference").alias("kind"), F.col("destination").alias("__to"))
    joined = cites.join(known, ["doc_id", "kind", "reference_key"], "left")
    return joined.withColumn("destination", F.coalesce("destination", "__to")).drop("__to").withColumn("resolved", F.col("destination").isNotNull())


# -- plain text ---------------------------------------------------------------

PLAIN = "doc_id bigint, paragraph_id string, line_start int, line_end int, char_start int, char_end int, raw_text string, urls array<struct<url:string,char_start:int,char_end:int,byte_start:int,byte_end:int>>"


def plain_blocks(text: str) -> Iterator[tuple]:
    """Blocks of lines parted by blank ones, with lines, offsets and the URLs inside; URL spans must not be split or edited."""
    at, block, number = 0, None, 0
    for line_no, line in enumerate([*text.split("\n"), ""], 1):
        if line.strip() and line_no <= text.count("\n") + 1:
            block = block or [line_no, line_no, at, at]
            block[1], block[3] = line_no, at + len(line)
        elif block:
            number += 1
            first, last, a, b = block
            urls = []
            for m in _BARE_URL.finditer(text, a, b):
                end = m.start() + len(trim_bare_url(m[0]))
                before = len(text[: m.start()].encode())
                urls.append({"url": text[m.start() : end], "char_start": m.start(), "char_end": end, "byte_start": before, "byte_end": before + len(text[m.start() : end].encode())})
            yield f"p_{number:04d}", first, last, a, b, text[a:b], urls
            block = None
        at += len(line) + 1


def plain_text(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs of plain texts with their URL citations; raw text is shown as it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in plain_blocks(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "paragraph_id", "line_start", "line_end", "char_start", "char_end", "raw_text", "urls"])

    return spread(docs).select(F.col(doc).cast("bigint"), text).mapInPandas(run, PLAIN)


# -- HTML evidence --------------------------------------------------------------

# Elements and attribute words that mark page furniture, elements without an end, text blocks.
_SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_TEXT_BLOCKS = {"p", "li", "dt", "dd", "pre"}
_NOISE = re.compile(r"(?<![A-Za-z0-9])(?:nav(?:bar|igation)?|sidebar|footer|header|advert(?:isement|ising)?|cookie|breadcrumb|social)(?![A-Za-z0-9])", re.I)
_HEADING_TAG = re.compile(r"h\d")


def _single_spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Evidence(HTMLParser):
    """Text blocks outside page furniture with their heading path.

    A block's text counts when its own end tag comes; a new block's start drops what an unclosed one
    held. Inside furniture every end tag goes one level up. Loose text serves where a page has no block.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.blocks, self.path, self.loose = "", [], [], []
        self.open, self.held = "", ""
        self.depth, self.in_title = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.depth:
            self.depth += tag not in _VOID
            return
        named = {k.lower(): v or "" for k, v in attrs}
        furniture = tag in _SKIP or "hidden" in named or named.get("aria-hidden", "").lower() == "true" or _NOISE.search(" ".join(v or "" for _, v in attrs))
        if furniture:
            self.depth = int(tag not in _VOID)
        elif tag == "title":
            self.in_title = True
        elif tag in _TEXT_BLOCKS or _HEADING_TAG.fullmatch(tag):
            self.open, self.held = tag, ""

    def handle_endtag(self, tag: str) -> None:
        if self.depth:
            self.depth -= 1
        elif tag == "title":
            self.in_title = False
        elif tag and tag == self.open:
            text, self.open = _single_spaced(self.held), ""
            if _HEADING_TAG.fullmatch(tag):
                self.path = [*self.path[: int(tag[1]) - 1], *([text] if text else [])]
            elif text:
                self.blocks.append((list(self.path), text))

    def handle_data(self, data: str) -> None:
        if self.depth:
            return
        if self.in_title:
            self.title += data
        elif self.open:
            self.held += data
        elif data.strip():
            self.loose.append(data)

    def found(self) -> list[tuple[list[str], str]]:
        loose = _single_spaced(" ".join(self.loose))
        return self.blocks or ([([], loose)] if loose else [])


_REFERENCE = re.compile(r"&(#\d+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def closed_references(markup: str) -> str:
    """Markup in which only character references that end in a semicolon are any: every other ``&`` is escaped."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], markup)


def bounded_ranges(text: str, chars: int = 2000, size: int = 8000) -> list[tuple[int, int]]:
    """Trimmed ranges within both limits, cut at the last white space that still fits."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = min(at + chars, len(text))
        while len(text[at:end].encode()) > size:
            end -= 1
        if end < len(text):
            cut = max(text.rfind(x, at + 1, end + 1) for x in " \n\t")
            end = cut if cut > at else end
        stop = at + len(text[at:end].rstrip())
        out.append((at, stop))
        at = max(end, at + 1)
    return out


EVIDENCE = "page_id bigint, title string, ordinal int, heading_path array<string>, locator string, text string, char_start int, char_end int"


def html_blocks(pages: DataFrame, page: str = "page_id", html: str = "html", chars: int = 2000, size: int = 8000, closed: bool = False) -> DataFrame:
    """Evidence chunks of pages: (page_id, title, ordinal, heading_path, locator, text, char_start, char_end).

    Offsets run over the page's blocks with two characters between; the locator counts the paragraphs
    of each heading path, and the parts of a long one. As in browsers, ``&amp`` is a reference without
    its semicolon too, unless ``closed`` asks for those that have one.
    """

    def chunks(key: int, markup: str) -> Iterator[tuple]:
        parser = _Evidence()
        parser.feed(closed_references(markup) if closed else markup)
        parser.close()
        counts: dict[tuple, int] = {}
        at, number, title = 0, 0, _single_spaced(parser.title)
        for path, text in parser.found():
            counts[tuple(path)] = paragraph = counts.get(tuple(path), 0) + 1
            ranges = bounded_ranges(text, chars, size)
            for part, (a, b) in enumerate(ranges, 1):
                number += 1
                name = " > ".join([*path, f"paragraph {paragraph}"]) + (f" part {part}" if len(ranges) > 1 else "") + f" [chars {at + a}-{at + b}]"
                yield key, title, number, path, name, text[a:b], at + a, at + b
            at += len(text) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [x for key, markup in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in chunks(key, markup or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVIDENCE.split(", ")])

    return spread(pages).select(F.col(page).cast("bigint"), html).mapInPandas(run, EVIDENCE)


# -- unified diffs --------------------------------------------------------------

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
HUNK = "diff_id bigint, file_no int, status string, old_path string, new_path string, old_start int, old_count int, new_start int, new_count int, added array<int>, removed array<int>"


def diff_hunks(text: str) -> Iterator[dict]:
    """Hunks of a unified diff with the new line numbers of added and the old ones of removed lines; a file without hunks gives one row."""
    file: dict = {}
    number, hunk = 0, None

    def out() -> Iterator[dict]:
        nonlocal hunk
        if file and (hunk is not None or not file["seen"]):
            file["seen"] = True
            yield {"file_no": number, "status": file["status"], "old_path": None if file["status"] == "added" else file["old"], "new_path": None if file["status"] == "deleted" else file["new"], **{k: v for k, v in (hunk or {"old_start": None, "old_count": None, "new_start": None, "new_count": None, "added": [], "removed": []}).items() if k[0] != "_"}}
        hunk = None

    def path(name: str, lead: str) -> str | None:
        name = name.split("\t")[0].strip().strip('"')
        return None if name == "/dev/null" else name.removeprefix(lead)

    for line in text.splitlines():
        if line.startswith("diff --git "):
            yield from out()
            old, _, new = line[len("diff --git a/") :].partition(" b/")
            file, number = {"status": "modified", "old": old, "new": new, "seen": False}, number + 1
        elif found := _HUNK.match(line):
            if hunk is not None:
                yield from out()
            a, b, c, d = found.groups()
            hunk = {"old_start": int(a), "old_count": int(b or 1), "new_start": int(c), "new_count": int(d or 1), "added": [], "removed": [], "_old": int(a), "_new": int(c)}
        elif hunk is not None and line[:1] in ("+", "-", " "):
            if line[0] == "+":
                hunk["added"].append(hunk["_new"])
            if line[0] == "-":
                hunk["removed"].append(hunk["_old"])
            hunk["_new"] += line[0] in "+ "
            hunk["_old"] += line[0] in "- "
        elif hunk is None and file:
            for start, status in (("new file mode", "added"), ("deleted file mode", "deleted"), ("rename from", "renamed"), ("copy from", "copied")):
                if line.startswith(start):
                    file["status"] = status
            if line.startswith("--- "):
                file["old"] = path(line[4:], "a/") or file["old"]
            elif line.startswith("+++ "):
                file["new"] = path(line[4:], "b/") or file["new"]
    yield from out()


def unified_diffs(diffs: DataFrame, key: str = "diff_id", patch: str = "patch") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"diff_id": k, **x} for k, p in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for x in diff_hunks(p or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HUNK.split(", ")]).astype({c: "Int32" for c in ("old_start", "old_count", "new_start", "new_count")})

    return diffs.select(F.col(key).cast("bigint"), patch).mapInPandas(run, HUNK)


# -- typed scalars --------------------------------------------------------------

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_NAMES = "|".join(_MONTHS)
_SEMVER = re.compile(r"(?<![0-9A-Za-z.-])((?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)(?![0-9A-Za-z-]|\.\d)")
_KINDS = [
    ("date", re.compile(r"(?<!\d)(?P<y>\d{4})([-/])(?P<m>\d{2})\2(?P<d>\d{2})(?!\d)")),
    ("date", re.compile(rf"(?<![A-Za-z0-9])(?P<m>{_NAMES})[ \t]+(?P<d>0?[1-9]|[12]\d|3[01]),[ \t]+(?P<y>\d{{4}})(?!\d)", re.I)),
    ("date", re.compile(rf"(?<![A-Za-z0-9])(?P<d>0?[1-9]|[12]\d|3[01])[ \t]+(?P<m>{_NAMES})[ \t]+(?P<y>\d{{4}})(?!\d)", re.I)),
    ("percentage", re.compile(r"(?<![A-Za-z0-9_.])([+-]?\d+(?:\.\d+)?)[ \t]*%(?![A-Za-z0-9_])")),
    ("decimal", re.compile(r"(?<![A-Za-z0-9_.])([+-]?\d+\.\d+)(?!\d|\.\d)")),
    ("integer", re.compile(r"(?<![A-Za-z0-9_.])([+-]?\d+)(?!\d|\.\d)")),
]


def scalars(text: str) -> list[dict]:
    """Typed scalars in order of place; an earlier kind (semver, date, percentage, decimal, integer) claims its characters."""
    out = [{"kind": "semver", "raw": m[1], "start": m.start(1), "end": m.end(1), "value": m[1]} for m in _SEMVER.finditer(text)]
    for kind, pattern in _KINDS:
        for m in pattern.finditer(text):
            if any(m.start() < x["end"] and x["start"] < m.end() for x in out):
                continue
            if kind == "date":
                month = m["m"]
                try:
                    value = date(int(m["y"]), int(month) if month.isdigit() else 1 + [x.lower() for x in _MONTHS].index(month.lower()), int(m["d"])).isoformat()
                except ValueError:
                    continue
            else:
                value = str(int(m[1])) if kind == "integer" else str(Decimal(m[1]).normalize())
            out.append({"kind": kind, "raw": m[0], "start": m.start(), "end": m.end(), "value": value})
    return sorted(out, key=lambda x: (x["start"], x["end"]))


@F.pandas_udf(ArrayType(StructType([StructField("kind", StringType()), StructField("raw", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("value", StringType())])))
def typed_scalars(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: scalars(t or ""))
