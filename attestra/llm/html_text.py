"""Layout-aware rendering of HTML to text.

A tree builder reads the markup, closes the elements whose end tags HTML lets authors leave out, and
keeps the rest as a tree. The renderer walks it as a browser lays it out: what is not visible is
left out (by the kind of element, its ``hidden`` attribute, its own style and style sheets); white
space collapses outside ``pre``; blocks start new lines and paragraphs, headings and the like are set
apart by one blank line; list items carry their marker and indent; table cells are aligned in columns,
wide ones wrapped. All visible text is emitted, navigation and footers too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.common import field, type_of
from attestra.sources.shared import spread

# Fixed values of the HTML standard: kinds of elements by their names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "object", "svg", "canvas", "audio", "video", "datalist", "math", "rp", "meta", "link", "base", "param", "source", "track", "col", "colgroup"}
APART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "pre", "blockquote", "figure", "fieldset", "table", "hr", "menu", "xmp", "listing"}
BLOCK = APART | {"address", "article", "aside", "body", "center", "dd", "details", "dialog", "dir", "div", "dt", "figcaption", "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "nav", "optgroup", "option", "search", "section", "summary", "caption", "tr", "tbody", "thead", "tfoot", "td", "th"}
#: Start tags that end an open paragraph.
ENDS_P = APART | {"address", "article", "aside", "center", "dd", "details", "dialog", "dir", "div", "dt", "figcaption", "footer", "form", "header", "hgroup", "li", "main", "nav", "search", "section", "summary"}
#: A start tag ends these open elements, looked for up to the elements named second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}), "body": ({"head"}, set()),
}
#: An end tag does not reach past these to close what is outside.
FENCES = {"table", "td", "th", "caption", "template", "button", "object"}

#: Elements nested deeper than this become siblings; their text stays.
DEEPEST = 120
#: Cells that others follow in their row are wrapped at this width, so that columns stay aligned side by side.
WIDEST = 60
#: Columns that begin farther to the right than this are no longer padded to their place, which bounds a line's padding.
FARTHEST = 1000

_MARKUP = re.compile(r"<(?:!--(?s:.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*+>)")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"@([a-z-]+)([^{};]*+)(?:;|\{((?:[^{}]++|\{[^{}]*+\})*+)\})|([^{}@;]++)\{([^{}]*+)\}", re.I)
_SHOWS = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"([a-z][\w-]*|\*)?((?:[.#][\w-]+)*)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "sheet")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.sheet: tuple[str, str] | None = None  # what style sheets say: declarations before and after the element's own

    def get(self, name: str) -> str | None:
        """An attribute's value, empty where it has none; null where it is not there."""
        if name not in self.attrs and name not in self.attrs.lower():
            return None
        for found in _ATTRIBUTE.finditer(self.attrs):
            if found[1].lower() == name:
                return html.unescape(found[2] or found[3] or found[4] or "")
        return None


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations; of conditional blocks only those for all or for screens."""
    for found in _RULE.finditer(css):
        if found[4] is not None:
            yield found[4], found[5]
        elif found[1].lower() == "media" and found[3] and {x.strip().lower() for x in found[2].split(",")} & {"all", "screen", "only screen"}:
            yield from _rules(found[3])


def _apply_sheets(root: Node, sheets: list[str]) -> None:
    """Note on each element what style sheets say about its display and visibility.

    Selectors of a tag name, classes and an id without combinators are followed; more specific ones
    win, then later ones, and important declarations win over the element's own.
    """
    wanted: list[tuple[tuple, str, set[str], set[str], str, bool]] = []
    for order, (selectors, body) in enumerate(x for css in sheets for x in _rules(_COMMENT.sub(" ", css))):
        shows = _SHOWS.findall(body)
        for selector in selectors.split(",") if shows else []:
            if not (parts := _SELECTOR.fullmatch(selector.strip())) or not parts[0]:
                continue
            tag, names = (parts[1] or "*").lower(), re.findall(r"([.#])([\w-]+)", parts[2])
            ids, classes = {n for kind, n in names if kind == "#"}, {n for kind, n in names if kind == "."}
            for name, value, important in shows:
                wanted.append(((len(ids), len(classes), tag != "*", order), tag, ids, classes, f"{name}:{value}", bool(important)))
    if not wanted:
        return
    by: dict[str, list] = {}
    for rule in sorted(wanted, key=lambda x: x[0]):
        by.setdefault(next((f"#{x}" for x in sorted(rule[2])), None) or next((f".{x}" for x in sorted(rule[3])), rule[1]), []).append(rule)
    stack = [root]
    while stack:
        node = stack.pop()
        classes, own = {*(node.get("class") or "").split()}, node.get("id")
        some = [r for key in (node.tag, "*", *(f".{x}" for x in classes), f"#{own}") if key in by for r in by[key]]
        some = sorted((r for r in some if r[1] in ("*", node.tag) and r[2] <= {own} and r[3] <= classes), key=lambda x: x[0])
        if some:
            node.sheet = ";".join(r[4] for r in some if not r[5]), ";".join(r[4] for r in some if r[5])
        stack += [k for k in node.kids if isinstance(k, Node)]


def _style(node: Node) -> str:
    own = node.get("style") or "" if node.attrs else ""
    return f"{node.sheet[0]};{own};{node.sheet[1]}" if node.sheet else own


def tree(markup: str) -> Node:
    """Parse markup; tags that fit nowhere are dropped, their text stays."""
    root, sheets = Node("html", ""), []
    stack, at, end = [root], 0, len(markup)
    while at < end:
        mark = markup.find("<", at)
        if mark < 0:
            mark = end
        if mark > at:
            stack[-1].kids.append(_plain(markup[at:mark]))
            at = mark
        if at == end:
            break
        found = _MARKUP.match(markup, at) or _LOOSE.match(markup, at)
        if found is None:
            stack[-1].kids.append("<")
            at += 1
            continue
        at = found.end()
        if not (tag := found[2]):
            continue
        tag = tag.lower()
        if found[1]:
            _close(stack, tag)
            continue
        node = _open(stack, tag, found[3])
        if tag in RAW and not found[3].endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(markup, at)
            inner = markup[at : stop.start() if stop else end]
            node.kids.append(_plain(inner) if tag in ("textarea", "title") else inner)
            at = stop.start() if stop else end
            if tag == "style" and ("display" in inner.lower() or "visibility" in inner.lower()):
                sheets.append(inner)
    if sheets:
        _apply_sheets(root, sheets)
    return root


def _plain(text: str) -> str:
    return html.unescape(text) if "&" in text else text


def _open(stack: list[Node], tag: str, attrs: str) -> Node:
    if tag in ("html", "body") and len(stack) == 1:
        node = Node("div", attrs)
        if tag == "body":
            stack[-1].kids.append(node)
            stack.append(node)
        return node
    if tag in ENDS_P:
        _end_implied(stack, {"p"}, FENCES)
    if tag in IMPLIED:
        _end_implied(stack, *IMPLIED[tag])
    elif stack[-1].tag == "head" and tag not in UNSEEN:
        stack.pop()
    node = Node(tag, attrs)
    stack[-1].kids.append(node)
    if tag not in VOID and tag not in RAW and len(stack) < DEEPEST:
        stack.append(node)
    elif tag in RAW and len(stack) < DEEPEST:
        stack.append(node)
    return node


def _end_implied(stack: list[Node], ended: set[str], fences: set[str]) -> None:
    """Close the outermost open element of ``ended`` that lies inside the nearest fence."""
    cut = 0
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ended:
            cut = k
        elif stack[k].tag in fences:
            break
    if cut:
        del stack[cut:]


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].kids.append(Node("br", ""))
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in FENCES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
            return
    if tag == "p":
        stack[-1].kids.append(Node("p", ""))


class _Page:
    """Lines under construction: pending text, pending line ends, and whether a space is due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.due = False
        self.gap = 0

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text == " ":
            self.space = True
            return
        if not text:
            return
        lead = text[0] == " "
        if self.parts:
            if self.space or lead:
                self.parts.append(" ")
        else:
            self._start()
        tail = text[-1] == " "
        self.parts.append(text[lead : len(text) - tail])
        self.space = tail

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            if not self.parts:
                self._start()
            self.parts.append(first)
        for line in rest:
            self.line_end()
            if line:
                self._start()
                self.parts.append(line)

    def _start(self) -> None:
        if self.gap and self.lines and self.gap > 1 and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def line_end(self) -> None:
        """A forced line end: an empty line stays empty."""
        if not self.parts:
            self._start()
        self.lines.append("".join(self.parts))
        self.parts, self.space = [], False

    def block(self, gap: int) -> None:
        """The border of a block: ends the line; the largest gap of adjoining borders counts."""
        if self.parts:
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, lines: list[str], gap: int) -> None:
        self.block(gap)
        if lines:
            self._start()
            self.lines += lines
        self.block(gap)

    def done(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        while self.lines and not self.lines[0].strip():
            del self.lines[0]
        return self.lines


def render(root: Node) -> str:
    page = _Page()
    _walk(root, page, True, False, 0)
    return "\n".join(x.replace("\xa0", " ").rstrip() for x in page.done())


def _lines(node: Node, seen: bool, pre: bool, depth: int) -> list[str]:
    page = _Page()
    _walk(node, page, seen, pre, depth)
    return page.done()


def _walk(node: Node, page: _Page, seen: bool, pre: bool, depth: int) -> None:
    closed = node.tag == "details" and node.get("open") is None
    summary = closed and next((k for k in node.kids if isinstance(k, Node) and k.tag == "summary"), None)
    for kid in node.kids:
        if isinstance(kid, str):
            if seen and not closed:
                page.verbatim(kid) if pre else page.text(kid)
        elif not closed or kid is summary:
            _element(kid, page, seen, pre, depth)


def _element(node: Node, page: _Page, seen: bool, pre: bool, depth: int) -> None:
    tag = node.tag
    if tag in UNSEEN:
        return
    if node.attrs or node.sheet:
        if _gone(node):
            return
        if shown := _VISIBILITY.findall(_style(node)):
            seen = shown[-1].lower() == "visible"
    if tag == "br":
        if seen:
            page.line_end()
    elif tag == "hr":
        page.block(2)
    elif tag == "wbr" or tag in ("img", "area", "embed"):
        return
    elif tag == "input":
        if seen and (node.get("type") or "").lower() in ("submit", "button", "reset") and (value := node.get("value")):
            page.text(value)
    elif tag == "dialog" and node.get("open") is None:
        return
    elif tag == "select":
        options = [k for k in _inside(node, {"option"}, {"optgroup"}) if k.get("hidden") is None]
        chosen = [k for k in options if k.get("selected") is not None] or (options if node.get("multiple") is not None else options[:1])
        for option in chosen:
            page.text(" ")
            _walk(option, page, seen, False, depth + 1)
            page.text(" ")
    elif tag in ("ul", "ol", "menu", "dir"):
        _list(node, page, seen, pre, depth)
    elif tag == "table":
        page.put(_table(node, seen, depth), 2)
    elif tag == "blockquote" or tag == "dd":
        page.put(["  " + x if x else x for x in _lines(node, seen, pre, depth + 1)], 2 if tag == "blockquote" else 1)
    elif tag in ("pre", "xmp", "listing", "textarea"):
        page.block(2 if tag != "textarea" else 1)
        if node.kids and isinstance(node.kids[0], str) and node.kids[0].startswith(("\n", "\r\n")):
            node.kids[0] = node.kids[0].lstrip("\r")[1:]
        _walk(node, page, seen, True, depth + 1)
        page.block(2 if tag != "textarea" else 1)
    elif tag in BLOCK:
        gap = 2 if tag in APART else 1
        page.block(gap)
        _walk(node, page, seen, pre, depth + 1)
        page.block(gap)
    elif tag == "q":
        page.text("“" if seen else "")
        _walk(node, page, seen, pre, depth + 1)
        page.text("”" if seen else "")
    else:
        _walk(node, page, seen, pre, depth + 1)


def _inside(node: Node, wanted: set[str], through: set[str]) -> Iterator[Node]:
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.tag in wanted:
                yield kid
            elif kid.tag in through:
                yield from _inside(kid, wanted, through)


def _number(value: str | None, otherwise: int, least: int = -(10**9), most: int = 10**9) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(most, max(least, int(found[1]))) if found else otherwise


def _list(node: Node, page: _Page, seen: bool, pre: bool, depth: int) -> None:
    """Items with markers; what stands between items is shown as it comes."""
    lines: list[str] = []
    at = _number(node.get("start"), 1)
    step = 1
    if node.tag == "ol" and node.get("reversed") is not None:
        step = -1
        if node.get("start") is None:
            at = sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
    loose = Node("div", "")
    for kid in [*node.kids, None]:
        if kid is not None and not (isinstance(kid, Node) and kid.tag == "li"):
            loose.kids.append(kid)
            continue
        if loose.kids:
            lines += ["  " + x if x else x for x in _lines(loose, seen, pre, depth + 1)]
            loose = Node("div", "")
        if kid is None:
            break
        holder = Node("div", "")
        holder.kids.append(kid)
        inner = _lines(holder, seen, pre, depth + 1)
        if node.tag == "ol":
            at = _number(kid.get("value"), at)
            marker = f"{at}. "
            at += step
        else:
            marker = "- "
        if inner:
            lines.append(marker + inner[0])
            lines += [" " * len(marker) + x if x else x for x in inner[1:]]
    page.put(lines, 1 if depth and any(lines) and _nested(page) else 2)


def _nested(page: _Page) -> bool:
    """Whether a list follows text on the lines of the same item."""
    return len(page.lines) + bool(page.parts) == 1


def _table(node: Node, seen: bool, depth: int) -> list[str]:
    out: list[str] = []
    rows: list[Node] = []

    def stray(part: Node | str) -> None:
        """What has no place in a table stands before it, as a browser puts it."""
        holder = Node("div", "")
        holder.kids.append(part)
        out.extend(_lines(holder, seen, False, depth + 1))

    for part in node.kids:
        if isinstance(part, str) or part.tag not in ("caption", "tr", "tbody", "thead", "tfoot", "td", "th"):
            stray(part)
        elif part.tag == "caption":
            out += [] if _gone(part) else _lines(part, seen, False, depth + 1)
        elif part.tag in ("tr", "td", "th"):
            rows.append(part)
        elif not _gone(part):
            for kid in part.kids:
                if isinstance(kid, Node) and kid.tag in ("tr", "td", "th"):
                    rows.append(kid)
                else:
                    stray(kid)
    for row in rows:
        if row.tag == "tr" and not _gone(row):
            for kid in row.kids:
                if isinstance(kid, str) or kid.tag not in ("td", "th"):
                    stray(kid)
    grid: list[dict[int, list[str]]] = []
    width: dict[int, int] = {}  # of the columns that hold a cell of their own
    taken: list[tuple[int, int, int]] = []  # (first column, column after the last, rows) that cells from above still fill, ascending
    for row in rows:
        if _gone(row):
            continue
        given = [k for k in ([row] if row.tag in ("td", "th") else row.kids) if isinstance(k, Node) and k.tag in ("td", "th") and not _gone(k)]
        cells, at, above, fresh = {}, 0, 0, []
        for place, cell in enumerate(given):
            while above < len(taken) and taken[above][0] <= at:
                at = max(at, taken[above][1])
                above += 1
            across, down = _number(cell.get("colspan"), 1, 1, 1000), _number(cell.get("rowspan"), 1, 1, 65534)
            holder = Node("div", "")
            holder.kids.append(cell)
            lines = _lines(holder, seen, False, depth + 1)
            cells[at] = lines if place + 1 == len(given) else _wrapped(lines)
            if across == 1:
                width[at] = max(width.get(at, 0), *(min(len(x), WIDEST) for x in cells[at]), 0)
            if down > 1:
                fresh.append((at, at + across, down))
            at += across
        taken = sorted([(a, b, n - 1) for a, b, n in taken if n > 2] + [(a, b, n) for a, b, n in fresh])
        taken = [(a, b, n) for a, b, n in taken if n > 1]
        grid.append(cells)
    columns = sorted(c for c, x in width.items() if x)
    left_of = [0, *accumulate(width[c] + 2 for c in columns)]
    for cells in grid:
        for k in range(max(map(len, cells.values()), default=0)):
            line = ""
            for at, lines in cells.items():
                if k < len(lines) and (text := lines[k]):
                    left = min(left_of[bisect_left(columns, at)], FARTHEST)
                    line = line.ljust(left) if len(line) <= left else line + "  "
                    line += text
            out.append(line)
    return out


def _gone(node: Node) -> bool:
    """Whether an element is not displayed: by the last declaration that counts, else by its ``hidden`` attribute."""
    if not node.attrs and not node.sheet:
        return False
    told = _DISPLAY.findall(_style(node))
    return told[-1].lower() == "none" if told else node.get("hidden") is not None


def _wrapped(lines: list[str]) -> list[str]:
    """Lines broken at spaces where they are wider than a column may be; a longer word stays whole."""
    out: list[str] = []
    for line in lines:
        while len(line) > WIDEST:
            cut = line.rfind(" ", 1, WIDEST + 1)
            cut = cut if cut > 0 else line.find(" ", WIDEST)
            if cut < 0 or not line[:cut].strip():
                break
            out.append(line[:cut])
            line = line[cut + 1 :]
        out.append(line)
    return out


def title_of(root: Node) -> str | None:
    """The text of the first title element."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(k for k in node.kids if isinstance(k, str))).strip()
        if node.tag not in ("svg", "template"):
            stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return None


def to_text(markup: str) -> str:
    return render(tree(markup))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text, n_chars, n_lines) of every page, over the whole markup.

    Null markup gives null title and text and no characters; empty markup and pages that show nothing
    give an empty text. Broken markup never fails: unknown tags count as inline, stray ones are
    dropped, very deep nesting is flattened. Repeated rows stay; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts = [], []
            for markup in batch.column(1).to_pylist():
                root = None if markup is None else tree(markup)
                titles.append(root and title_of(root))
                texts.append(root and render(root))
            sizes, lines = [len(x or "") for x in texts], [x.count("\n") + 1 if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(lines, pa.int64())], names=["id", "title", "text", "n_chars", "n_lines"])

    made = spread(pages).select(field(id_col).alias("id"), field(html_col).cast("string").alias("html")).mapInArrow(run, f"id {type_of(pages, id_col)}, title string, text string, n_chars bigint, n_lines bigint")
    return made.withColumnRenamed("id", id_col)
