"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that supplies the end tags HTML lets authors leave out (p, li, dt, dd, option, tr, td,
th, thead, tbody, tfoot, caption; the head ends before the first content) and ignores end tags without a start. Rules on tags and attributes say what is visible:
no head matter, script, style, template, noscript and the like; nothing hidden by ``hidden``, ``aria-hidden``, an inline ``display:none``
or a ``dialog`` that is not open, and of closed ``details`` the summary only; ``visibility`` is inherited, so what an element within a hidden one shows again is visible.
Buttons and text fields show their value. The renderer walks the tree and emits all visible text: white space collapses
outside ``pre``; blocks begin on new lines and paragraphs, headings, lists and tables are set off by an empty line; list items get
``- `` or their number and the indent of their nesting; table cells are padded so that columns align and separated by
`` | `` (cells keep their own lines, lists and tables); what a table holds outside its cells comes before it.

One page at a time, without recursion, in time that grows with the page. Where columns as wide as their cells would make a table
many times larger, cells longer than ``WIDEST`` are unpadded, and if that does not do, all are. Defined results: a null or empty html gives an
empty text; a broken page gives what its tokens hold; repeated rows are rendered each; other columns pass through ``render``
(a column ``text`` of the input is replaced).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, with_workers

WIDEST = 60
#: Tables within more tables than this are set without columns, each cell on its own lines.
NESTED = 16
#: Elements nested deeper than this become siblings, as in browsers; no text is lost, and what is hidden stays hidden.
DEEPEST = 512
# ---- fixed values of HTML
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
_UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link base audio video canvas datalist desc metadata defs annotation annotation-xml".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre section summary table ul tr td th thead tbody tfoot caption".split()
)
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
_CLOSES_P = _BLOCK - {"html", "body", "li", "dd", "dt", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "summary"}
#: start tag: (tags that it ends, tags at which the search for them stops)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Kinds of input that show their value.
_FIELDS = frozenset("submit button reset text search email url tel number".split())
# ---- end of fixed values
_TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())
#: A quote counts where a value begins only, so a stray one swallows nothing; a tag that nothing closes reaches to the end, as in browsers.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)|<[!?/][^<>]*>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([\w-]+)", re.I)
_WS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "parts", "attrs", "shown")

    def __init__(self, tag: str, attrs: str = "", shown: bool = True):
        self.tag, self.attrs, self.shown, self.parts = tag, attrs, shown, []

    def get(self, name: str) -> str | None:
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


def _looks(tag: str, attrs: str) -> tuple[bool, bool | None]:
    """Whether an element is out of sight with all that it holds; the visibility that it sets, if any."""
    gone, shown = tag in _UNSEEN or tag == "dialog", None
    low = attrs.lower()
    if not any(x in low for x in ("hidden", "style", "open")):
        return gone, shown
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, shown
        if name == "open" and tag == "dialog":
            gone = False
        if name == "style":
            display, visibility = _DISPLAY.findall(value), _VISIBILITY.findall(value)  # the last one holds
            if display and display[-1].lower() == "none":
                return True, shown
            if visibility:
                shown = {"hidden": False, "collapse": False, "visible": True}.get(visibility[-1].lower())
    return gone, shown


def build(html: str) -> Node:
    """The tree of a page; hidden elements are nodes without parts."""
    root = Node("html")
    stack, open_tags, at, low = [root], ["html"], 0, None
    unseen, unclosed = 0, set()  # depth of open hidden elements; raw tags that end nowhere
    below: Counter = Counter()  # open elements too deep for the stack, within a hidden one
    begun, closed = False, []  # whether the body has begun; closed details

    def end_head() -> int:
        """The head ends before what is no head matter, with an end tag or without; returns the depth of hidden elements left."""
        left = unseen - sum(n.tag == "-" for n in stack[1:])
        del stack[1:], open_tags[1:]
        return left

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and not begun and (open_tags[-1] == "head" or len(open_tags) == 1) and _WS.sub("", text):
            unseen, begun = end_head(), True
        if text and not unseen and stack[-1].shown:
            stack[-1].parts.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1] and tag not in _HEAD and tag not in ("html", "head") and not begun:
            unseen, begun = end_head(), True
        if tag == "head" and (m[1] and "head" not in open_tags or not m[1] and (begun or len(open_tags) > 1)):
            continue  # a head within the body is none
        below = below if unseen else Counter()
        if m[1]:
            if below[tag]:
                below[tag] -= 1
            elif tag in open_tags[1:]:
                while True:
                    gone = open_tags.pop()
                    unseen -= stack.pop().tag == "-"
                    if gone == tag:
                        break
            continue
        if tag in ("html", "body") and tag in open_tags:
            continue
        within = unseen and any(below.values())
        if tag in _CLOSES_P and "p" in open_tags and not within:
            k = len(open_tags) - 1 - open_tags[::-1].index("p")
            if not any(t in ("table", "td", "th", "button", "li") for t in open_tags[k + 1 :]):
                unseen -= sum(n.tag == "-" for n in stack[k:])
                del stack[k:], open_tags[k:]
        if tag in _IMPLIED and not within:
            ends, stops = _IMPLIED[tag]
            k, cut = len(open_tags) - 1, None
            while k > 0 and open_tags[k] not in stops:
                if open_tags[k] in ends:
                    cut = k
                k -= 1
            if cut:
                unseen -= sum(n.tag == "-" for n in stack[cut:])
                del stack[cut:], open_tags[cut:]
        hidden, shown = _looks(tag, m[3])
        node = Node("-" if hidden else tag, m[3], stack[-1].shown if shown is None else shown)
        if not unseen and not hidden and (node.shown or tag not in ("img", "hr", "input")):
            stack[-1].parts.append(node)
        if tag == "details" and node.get("open") is None:
            closed.append(node)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK | _RAW:
            continue
        if tag in _RAW:
            low = html.lower() if low is None else low
            end = -1 if tag in unclosed else low.find(f"</{tag}", at)
            if end < 0:
                unclosed.add(tag)
            if end < 0 and tag in ("title", "textarea"):
                continue
            if not hidden and not unseen and node.shown:
                raw = html[at : end if end >= 0 else len(html)]
                node.parts.append(unescape(raw) if tag == "textarea" else raw)
            at = html.find(">", end) + 1 if end >= 0 else len(html)
            if not at:
                break
            continue
        if len(stack) >= DEEPEST and (unseen or not hidden and node.shown == stack[-1].shown):
            below[tag] += bool(unseen)
            continue
        stack.append(node)
        open_tags.append(tag)
        unseen += hidden
    for node in closed:  # of closed details the first summary is in sight
        node.parts = [p for p in node.parts if isinstance(p, Node) and p.tag == "summary"][:1]
    return root


class _Lines:
    """Output under construction: lines, the line at hand, and how many breaks are due before more text."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line: list[str] = []
        self.due = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def stop(self, breaks: int) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.due = max(self.due, breaks)

    def _begin(self) -> None:
        if not self.line:
            if self.due > 1 and self.out:
                self.out.append("")
            self.due = 0
            self.line.append(self.indent + self.mark)
            self.mark = ""

    def text(self, s: str) -> None:
        flat = _WS.sub(" ", s)
        if flat == " " or not flat:
            self.space |= bool(flat)
            return
        lead = (self.space or flat[0] == " ") and bool(self.line)
        self._begin()
        self.line.append((" " if lead else "") + flat.strip(" "))
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                self._begin()
                self.out.append("".join(self.line).rstrip())
                self.line, self.due = [], 0
            if part:
                self._begin()
                self.line.append(part)

    def done(self) -> list[str]:
        self.stop(0)
        return self.out


def _holds(node: Node) -> bool:
    """Whether rows or cells of the table around a node lie in it."""
    todo = [node]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, Node) and part.tag != "table":
                if part.tag in _TABLE_PARTS:
                    return True
                todo.append(part)
    return False


def _rows(node: Node) -> tuple[list[list[Node]], list]:
    """The cells of a table by row; and what else it holds, which pages show before it."""
    rows, rest, todo = [], [], [(p, None) for p in reversed(node.parts)]
    bare = None  # the row of cells outside rows
    while todo:
        part, row = todo.pop()
        if isinstance(part, str):
            rest += [part] if part.strip() else []
        elif part.tag in ("td", "th"):
            if row is None:
                if bare is None:
                    rows.append(bare := [])
                row = bare
            row.append(part)
        elif part.tag == "tr":
            rows.append([])
            bare = None
            todo += [(p, rows[-1]) for p in reversed(part.parts)]
        elif part.tag in _TABLE_PARTS or part.tag != "table" and _holds(part):
            todo += [(p, row) for p in reversed(part.parts)]
        else:
            rest.append(part)
    return [r for r in rows if r], rest


def _span(cell: Node, name: str, most: int) -> int:
    span = cell.get(name) if cell.attrs else None
    return max(1, min(int(span), most)) if span and re.fullmatch("[0-9]{1,9}", span) else 1


def _placed(rows: list[list[Node]]) -> list[list[int]]:
    """The column of every cell, by the spans of those before it. Columns in which no cell begins do not count."""
    busy: dict[int, int] = {}  # column: the first row in which it is free again
    at, left = [], 1_000_000  # spans are followed for so many steps
    for r, row in enumerate(rows):
        col, own = 0, []
        for cell in row:
            while left > 0 and busy.get(col, 0) > r:
                col += 1
                left -= 1
            own.append(col)
            wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            if high > 1 and left > 0:
                left -= wide
                busy |= dict.fromkeys(range(col, col + wide), r + high)
            col += wide
        at.append(own)
    number = {c: k for k, c in enumerate(sorted({c for own in at for c in own}))}
    return [[number[c] for c in own] for own in at]


def _table(rows: list[list[Node]], done: dict[int, list[str]]) -> list[str]:
    cells = [[_lines(c, done) for c in row] for row in rows]
    at = _placed(rows)
    size = sum(len(x) + 3 for row in cells for c in row for x in c)
    heights = [max(map(len, row)) for row in cells]
    for widest in (1 << 30, WIDEST):  # columns as wide as their cells, unless that makes the page many times larger
        widths = [0] * (1 + max((own[-1] for own in at), default=-1))
        for row, own in zip(cells, at, strict=True):
            for c, k in zip(row, own, strict=True):
                widths[k] = max([widths[k], *(len(x) for x in c if len(x) <= widest)])
        ends = [0]
        for w in widths:
            ends.append(ends[-1] + w + 3)
        if sum(h * ends[own[-1]] for h, own in zip(heights, at, strict=True)) <= 16 * size + (1 << 16):
            break
    else:  # no columns
        return [x for row in cells for x in ([" | ".join(c[0] for c in row if c)] if all(len(c) < 2 for c in row) else [x for c in row for x in c]) if x]
    out = []
    for row, own, height in zip(cells, at, heights, strict=True):
        for j in range(height):
            line = [""] * (own[-1] + 1)
            for c, k in zip(row, own, strict=True):
                line[k] = c[j] if j < len(c) else ""
            while line and not line[-1]:
                line.pop()
            out.append(" | ".join(x.ljust(widths[k]) for k, x in enumerate(line)).rstrip())
    return out


def render_page(html: str | None) -> str:
    """All visible text of a page."""
    if not html:
        return ""
    root, tables, done = build(html), [], {}
    todo = [(root, 0)]
    while todo:
        x, depth = todo.pop()
        if x.tag == "table":
            depth += 1
            if depth <= NESTED:
                tables.append(x)
        todo += [(p, depth) for p in x.parts if isinstance(p, Node)]
    for x in reversed(tables):  # inner ones first
        rows, rest = _rows(x)
        before = Node("div")
        before.parts = rest
        done[id(x)] = _lines(before, done) + _table(rows, done)
    return "\n".join(_lines(root, done))


def _lines(root: Node, done: dict[int, list[str]]) -> list[str]:
    """The lines of a node, with those of the tables in it."""
    out = _Lines()
    todo: list = [("node", root, 0)]
    lists: list[list] = []
    pre = 0
    while todo:
        kind, x, extra = todo.pop()
        if kind == "text":
            out.raw(x) if pre else out.text(x)
        elif kind == "end":
            breaks, indent = extra
            out.stop(breaks)
            out.indent = indent
            if x == "pre":
                pre -= 1
            elif x in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif x == "li":
                out.mark = ""
        elif x.tag == "br":
            if out.line:
                out.stop(1)
            else:
                out.due = max(out.due, 2)
        elif x.tag == "hr":
            out.stop(1)
            out._begin()
            out.line.append("---")
            out.stop(1)
        elif x.tag == "img":
            if alt := x.get("alt"):
                out.text(alt)
        elif x.tag == "input":
            kind = (x.get("type") or "text").lower()
            if value := x.get("alt" if kind == "image" else "value") if kind == "image" or kind in _FIELDS else None:
                out.text(f" {value} ")
        elif x.tag == "table" and id(x) in done:
            out.stop(2)
            for line in done[id(x)]:
                out._begin()
                out.line.append(line)
                out.stop(1)
            out.stop(2)
        else:
            tag = x.tag
            if tag in _BLOCK:
                breaks = 2 if tag in _SPACED and not (tag in ("ul", "ol") and lists) else 1
                out.stop(breaks)
                todo.append(("end", tag, (breaks, out.indent)))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = x.get("start") if tag == "ol" else None
                    lists.append([tag == "ol", int(start) if start and re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                    if len(lists) > 1:
                        out.indent = (out.indent + "  ")[:40]
                elif tag == "li":
                    if lists and lists[-1][0]:
                        value = x.get("value")
                        if value and re.fullmatch(r"-?[0-9]{1,9}", value):
                            lists[-1][1] = int(value)
                        out.mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    else:
                        out.mark = "- "
                elif tag in ("dd", "blockquote"):
                    out.indent = (out.indent + "  ")[:40]
                elif tag == "pre":
                    pre += 1
            if tag in ("option", "textarea"):
                out.text(" ")
                todo.append(("text", " ", 0))
            for part in reversed(x.parts):
                todo.append(("text", part, 0) if isinstance(part, str) else ("node", part, 0))
    lines = "\n".join(out.done()).strip("\n")
    return lines.split("\n") if lines else []


def render(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with ``text``."""
    with_workers(pages.sparkSession)
    kept = [c for c in pages.columns if c not in ("html", "text")]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render_page(h.as_py()) for h in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, "text"])

    return pages.mapInArrow(run, schema)


def op6_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "pages"))
