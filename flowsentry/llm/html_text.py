"""Text of web pages by layout: a tree with implied tags, visibility rules, and block, list and table layout.

`tree` reads tags, comments and character references and builds the element tree as a browser would in the
common cases: void elements hold nothing; a new paragraph, list item, table cell or option ends the one that is
open; a block ends an open paragraph; an end tag closes what is open inside its element, and one without an
open element is ignored (except that a lone </p> is an empty paragraph and </br> a line break); what is open
at the end is closed there. `render` emits every visible text once, in order:

* elements that are never shown (`HIDDEN`), that carry `hidden`, `aria-hidden="true"`, or a style of
  `display:none` or `visibility:hidden` are left out with all they hold; an inner `visibility:visible` is
  shown again; `<input type="hidden">` has no text, an image has its alternative text;
* blocks begin and end on lines of their own, paragraphs, headings, lists, tables and quotations have an empty
  line around them; inside a block runs of white space are one space; `<pre>` and `<textarea>` keep theirs;
* list items begin with `- ` or their number, indented by two spaces for each list around them;
* rows of a table are lines whose cells are padded to their columns' widths and joined by ` | `; a cell that
  spans columns takes their places; a cell's inner lines are joined by a space, so that no text is lost. A
  table inside a cell is joined in the same way; a cell that spans rows keeps its place in them. In tables wider than
  `ALIGNED` cells are wrapped between words to `CELL` characters, so that every table is aligned.

Defined results: null and empty pages give an empty text; text outside any element is shown; repeated rows are
rendered alike; null ids and other columns do not matter; an empty table gives an empty result. Elements may be nested
to any depth.
"""

from __future__ import annotations

import html
import re
import sys
import textwrap
from collections import Counter

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])

# fixed values: names of elements by their part in the layout
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title style script noscript template object iframe audio video canvas svg math datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section summary table ul caption tbody thead tfoot tr""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body html li dd dt option optgroup caption tbody thead tfoot tr legend".split())
#: An opening tag ends the open elements of the second column, up to but not through those of the third.
IMPLIED = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "td": ("td th", "table tr"), "th": ("td th", "table tr"),
    "tr": ("tr td th caption colgroup", "table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "body": ("head title", "html"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
SCOPE = frozenset("table td th caption html".split())
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
TABLE_SCOPE = frozenset("table html".split())

ALIGNED, CELL = 200, 40
#: Input elements whose value is not shown as text.
NO_VALUE = frozenset("hidden checkbox radio range color file image password".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
                    re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def tree(page: str) -> tuple[Node, int]:
    """The root of the element tree, and how deep it is."""
    root = Node("", {})
    stack, opened, deepest = [root], Counter(), 1
    at, size = 0, len(page)

    def close(index: int) -> None:
        opened.subtract(n.name for n in stack[index:])
        del stack[index:]

    def last(names, barrier) -> int:
        """The innermost open element among `names` with none of `barrier` inside it, 0 if there is none."""
        if not any(opened[n] for n in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in barrier:
                return 0
        return 0

    def open_tag(name: str, attributes: dict[str, str]) -> None:
        if name in ENDS_PARAGRAPH and (i := last(("p",), SCOPE)):
            close(i)
        if name in _IMPLIED:
            ends, barrier = _IMPLIED[name]
            outer = 0
            for i in range(len(stack) - 1, 0, -1) if any(opened[n] for n in ends) else ():
                if stack[i].name in barrier:
                    break
                if stack[i].name in ends:
                    outer = i
            if outer:
                close(outer)
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name not in VOID:
            stack.append(node)
            opened[name] += 1

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif i := last((name,), (TABLE_SCOPE if name in TABLE_PARTS else SCOPE) - {name}):
                close(i)
            elif name == "p":
                stack[-1].children.append(Node("p", {}))
            continue
        open_tag(name, _attributes(m[3]))
        if name in RAW and stack[-1].name == name:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            inner = page[at:end.start() if end else size]
            stack[-1].children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = end.end() if end else size
            close(len(stack) - 1)
        deepest = max(deepest, len(stack))
    return root, deepest


def _style(node: Node) -> str:
    return re.sub(r"\s+", "", node.attributes.get("style", "").lower())


def _gone(node: Node) -> bool:
    a = node.attributes
    return (node.name in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
            or bool(a) and "display:none" in _style(node)
            or node.name == "input" and a.get("type", "").lower() == "hidden")


class _Page:
    """Lines in the making: `gap` empty lines wait in front of the next text."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space, self.indent, self.marker = [], "", 0, False, 0, ""

    def end_line(self, gap: int) -> None:
        if self.line:
            self.lines.append(self.line)
            self.line, self.gap = "", gap
        elif self.lines:
            self.gap = max(self.gap, gap)
        self.space = False

    def _begin(self) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.line = "  " * self.indent + self.marker
            self.marker = ""
            self.space = False

    def text(self, words: str) -> None:
        flat = _WHITE.sub(" ", words)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or bool(flat) and bool(self.line)
            return
        lead = (self.space or flat[0] == " ") and bool(self.line)
        self._begin()
        self.line += " " + body if lead else body
        self.space = flat[-1] == " "

    def exact(self, words: str) -> None:
        for i, part in enumerate(words.split("\n")):
            if i:
                if not self.line and self.lines:
                    self.lines += [""] * self.gap
                self.gap = 0
                self.lines.append(self.line.rstrip())
                self.line = ""
            if part:
                self._begin()
                self.line += part


def _walk(node: Node, page: _Page, shown: bool, exact: bool, lists: list) -> None:
    for child in node.children:
        if isinstance(child, str):
            if shown:
                page.exact(child) if exact else page.text(child)
            continue
        if _gone(child):
            continue
        style = _style(child) if child.attributes else ""
        visible = "visibility:visible" in style or shown and "visibility:hidden" not in style \
            and "visibility:collapse" not in style
        name = child.name
        if name == "br":
            if shown:
                page.end_line(page.gap if not page.line else 0)
        elif name == "img":
            if visible and child.attributes.get("alt"):
                page.text(child.attributes["alt"])
        elif name == "input":
            if visible and child.attributes.get("type", "text").lower() not in NO_VALUE:
                page.text(child.attributes.get("value", ""))
        elif name == "table":
            page.end_line(1)
            for line in _table(child, visible):
                page._begin()
                page.line += line
                page.end_line(0)
            page.end_line(1)
        elif name in ("ul", "ol", "menu", "dir"):
            inner = bool(lists)
            page.end_line(0 if inner else 1)
            start = child.attributes.get("start", "")
            lists.append([name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            page.indent = len(lists) - 1
            _walk(child, page, visible, exact, lists)
            lists.pop()
            page.indent = max(0, len(lists) - 1)
            page.end_line(0 if inner else 1)
        elif name == "li":
            page.end_line(0)
            numbered = bool(lists) and lists[-1][0] == "ol"
            page.marker = f"{lists[-1][1]}. " if numbered else "- "
            if numbered:
                lists[-1][1] += 1
            _walk(child, page, visible, exact, lists)
            page.end_line(0)
            page.marker = ""
        elif name in BLOCK:
            gap = 1 if name in SPACED else 0
            page.end_line(gap)
            _walk(child, page, visible, exact or name == "pre", lists)
            page.end_line(gap)
        elif name in ("td", "th"):  # outside any table
            page.space = True
            _walk(child, page, visible, exact, lists)
            page.space = True
        else:
            _walk(child, page, visible, exact or name == "textarea", lists)


def _lines(node: Node, shown: bool) -> list[str]:
    page = _Page()
    _walk(node, page, shown, False, [])
    page.end_line(0)
    return page.lines


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "")
    return int(value) if re.fullmatch(r"[1-9]\d{0,2}", value) else 1


def _in_columns(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Cells with their widths in columns; an empty cell stands where one from a row above reaches down."""
    out, below = [], {}  # rows that a column's cell still reaches into
    for row in rows:
        cells, column = [], 0
        for text, span, down in row:
            while span and below.get(column):
                below[column] -= 1
                cells.append(("", 1))
                column += 1
            cells.append((text, span))
            for i in range(column, column + span):
                below[i] = down - 1
            column += span
        if any(span for _, span, _ in row):
            for i in [i for i, left in below.items() if i >= column and left]:
                below[i] -= 1
        out.append(cells)
    return out


def _table(table: Node, shown: bool) -> list[str]:
    """The caption, then the rows; text that stands between rows or cells becomes a line or a cell of its own."""
    before: list[str] = []
    rows: list[list[tuple[str, int, int]]] = []

    def visible(node: Node, shown: bool) -> bool:
        style = _style(node) if node.attributes else ""
        return "visibility:visible" in style or shown and "visibility:hidden" not in style \
            and "visibility:collapse" not in style

    def cells(row: Node, shown: bool) -> list[tuple[str, int, int]]:
        out = []
        for c in row.children:
            if isinstance(c, str):
                if shown and c.strip():
                    out.append((_WHITE.sub(" ", c).strip(" "), 1, 1))
            elif not _gone(c):
                holder = c
                if c.name not in ("td", "th"):
                    holder = Node("td", {})
                    holder.children = [c]
                text = " ".join(x for x in (line.strip() for line in _lines(holder, visible(c, shown))) if x)
                if text or c.name in ("td", "th"):
                    out.append((text, _span(c, "colspan"), _span(c, "rowspan")))
        return out

    def collect(node: Node, shown: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if shown and c.strip():
                    rows.append([(_WHITE.sub(" ", c).strip(" "), 0, 1)])
            elif _gone(c):
                continue
            elif c.name in ("tbody", "thead", "tfoot"):
                collect(c, visible(c, shown))
            elif c.name == "tr":
                rows.append(cells(c, visible(c, shown)))
            elif c.name in ("td", "th"):
                holder = Node("tr", {})
                holder.children = [c]
                rows.append(cells(holder, shown))
            elif c.name == "caption":
                before.extend(_lines(c, visible(c, shown)))
            else:
                holder = Node("div", {})
                holder.children = [c]
                rows.extend([(x.strip(), 0, 1)] for x in _lines(holder, shown) if x.strip())

    collect(table, shown)
    placed = _in_columns(rows)
    widths = _widths(placed, None)
    most = None if sum(widths.values()) + 3 * len(widths) <= ALIGNED else CELL
    if most:
        widths = _widths(placed, most)
    lines = []
    for row in placed:
        column, columns = 0, []
        for text, span in row:
            width = sum(widths.get(i, 0) for i in range(column, column + span)) + 3 * max(0, span - 1)
            columns.append((_wrapped(text, max(width, most)) if most and span else [text], min(width, ALIGNED)))
            column += span
        if any(text for text, _ in row):
            for i in range(max(len(parts) for parts, _ in columns)):
                lines.append(" | ".join((parts[i] if i < len(parts) else "").ljust(width) for parts, width in columns).rstrip())
    return before + lines


def _wrapped(text: str, width: int) -> list[str]:
    return textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False) or [""]


def _widths(rows: list[list[tuple[str, int]]], most: int | None) -> dict[int, int]:
    """The width of each column: its longest cell, or the longest line of one that is wrapped."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for text, span in row:
            if span == 1:
                length = max(map(len, _wrapped(text, most))) if most else len(text)
                widths[column] = max(widths.get(column, 0), length)
            column += span
    return widths


def render(page: str) -> str:
    if not page:
        return ""
    root, depth = tree(page)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 8 * depth + 1000))  # the walk is plain Python, which takes no machine stack
    try:
        return "\n".join(x.rstrip() for x in _lines(root, True))
    finally:
        sys.setrecursionlimit(limit)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([render(h) for h in batch.column("html").to_pylist()], pa.string())],
                names=["page_id", "text"])

    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                      F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, text string")
