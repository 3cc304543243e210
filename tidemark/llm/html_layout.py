"""Visible text of HTML by a tree builder and a layout renderer.

The tree builder reads tags with a tolerant tokenizer. It implies the tags that HTML leaves out: a
block ends an open paragraph; list items, terms, rows, cells, table sections and options end their
like; cells imply rows; an end tag closes what stands open inside its element and is ignored if
there is none (</p> without <p> makes an empty paragraph). Scripts, styles and other raw-text
elements are read up to their own end tag.

Not visible: head, script, style, template, noscript, iframes and their like, comments, hidden
inputs, closed dialogs, titles, definitions and metadata of drawings, annotations of formulas, and
elements with the hidden attribute or with display:none or visibility:hidden in their style
attribute. All other text is emitted, formulas and labels of drawings included, character references
resolved.

Layout: white space collapses outside <pre>. Blocks stand on lines of their own; paragraphs,
headings, lists, tables, quotes and <pre> are set off by a blank line. List items get "- " or their
number, and nested lists are indented. Tables are laid out in columns: a column is as wide as its
widest cell, cells are padded and set two spaces apart, cells may have several lines, span columns and
span rows (they stand in their first row and keep their columns free below). Spans and list numbers
that aren't whole numbers count as absent.

Rows: null HTML gives null text; empty HTML empty text. Depth is bounded by the input only (no
recursion but for tables in tables beyond whose TABLE_DEPTH cells are laid out as blocks). Repeated
pages repeat; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import per_batch

TABLE_DEPTH = 64
#: Most columns that a cell spans, as in browsers.
COLUMNS = 1000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title object video audio canvas datalist map annotation annotation-xml desc defs metadata".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset legend li dt dd figcaption details summary dialog center menu tr caption option optgroup".split())
#: Start tags that end an open paragraph.
ENDS_P = (BLOCK | {"table", "hr"}) - frozenset("html body li dt dd tr caption option optgroup".split())
#: tag -> (tags that it ends, tags beyond which it doesn't look)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = {name: re.compile(rf"(?:^|\s){name}\s*=\s*[\"']?\s*([^\s\"'>]*)", re.I) for name in ("colspan", "rowspan", "start")}
_STYLED = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|style\s*=)", re.I)
_QUOTED = re.compile(r"=\s*(\"[^\"]*\"|'[^']*')")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "shown")

    def __init__(self, tag: str, attributes: str = "", shown: bool = True):
        self.tag, self.attributes, self.shown = tag, attributes, shown
        self.children: list[Node | str] = []


def attribute(node: Node, name: str) -> str:
    found = _ATTRIBUTE[name].search(node.attributes)
    return found[1].lower() if found else ""


def whole_number(node: Node, name: str) -> int | None:
    """The attribute as a whole number of up to nine digits, or None."""
    found = re.fullmatch(r"-?[0-9]{1,9}", attribute(node, name))
    return int(found[0]) if found else None


def _hidden(tag: str, attributes: str) -> bool:
    if tag in HIDDEN:
        return True
    if not attributes:
        return False
    if tag == "input":
        return True
    if tag == "dialog" and not re.search(r"(?:^|\s)open(?=[\s=/]|$)", attributes, re.I):
        return True
    if not _STYLED.search(attributes):
        return False
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", _QUOTED.sub("=", attributes), re.I):
        return True
    style = re.search(r"(?:^|\s)style\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", attributes, re.I | re.S)
    return bool(style and re.search(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", next((g for g in style.groups() if g), ""), re.I))


class _Stack(list):
    """The open elements, and how many of each tag there are."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.open[node.tag] += 1

    def cut(self, at: int) -> None:
        """Close all elements from the place at on."""
        self.open.subtract([node.tag for node in self[at:]])
        del self[at:]


def parse(html: str) -> Node:
    """The tree of a page, with implied tags."""
    root = Node("html")
    stack = _Stack(root)
    at = 0
    search = _TOKEN.search
    while at < len(html):
        token = search(html, at)
        text = html[at : token.start()] if token else html[at:]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not token:
            break
        at = token.end()
        end, start = token[1], token[2]
        if start:
            tag, attributes = start.lower(), token[3]
            if tag == "html":
                continue
            _open(stack, tag, attributes)
            if tag in RAW and stack[-1].tag == tag:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                stop = close.start() if close else len(html)
                if stop > at and stack[-1].shown:
                    stack[-1].children.append(unescape(html[at:stop]))
                at = close.end() if close else len(html)
                stack.cut(len(stack) - 1)
        elif end:
            _close(stack, end.lower())
        elif token[0].startswith("<![CDATA["):
            stack[-1].children.append(token[0][9:].removesuffix("]]>"))
    return root


def _open(stack: _Stack, tag: str, attributes: str) -> None:
    if tag in ENDS_P:
        _end(stack, {"p"}, {"table", "td", "th", "caption", "button", "object"})
    if tag in ENDS:
        _end(stack, *ENDS[tag])
    if tag in ("td", "th") and stack[-1].tag != "tr":
        _open(stack, "tr", "")
    node = Node(tag, attributes, not _hidden(tag, attributes))
    stack[-1].children.append(node)
    if tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "math")):
        stack.push(node)


def _end(stack: _Stack, tags: set, limits: set) -> None:
    """Close the outermost of the open elements with one of the tags, not beyond a limit."""
    if not any(stack.open[tag] for tag in tags):
        return
    found = None
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in limits:
            break
        if stack[k].tag in tags:
            found = k
    if found:
        stack.cut(found)


def _close(stack: _Stack, tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    for k in range(len(stack) - 1, 0, -1) if stack.open[tag] else ():
        if stack[k].tag == tag:
            stack.cut(k)
            return
        if stack[k].tag == "table" and tag not in ("body", "html"):
            break
    if tag == "p":
        stack[-1].children.append(Node("p"))


class _Lines:
    """Text laid out in lines: collapses white space, keeps track of blank lines and indentation."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False  # white space is pending
        self.gap = 0  # lines to break before the next text: 1 new line, 2 blank line
        self.indent = ""
        self.marker = ""

    def text(self, text: str) -> None:
        parts = _SPACE.split(text)
        if len(parts) == 1:
            if text:
                self._put(text)
            return
        if parts[0]:
            self._put(parts[0])
        self.space = True
        body = " ".join(parts[1:-1] if parts[0] or len(parts) > 1 else parts)
        if body:
            self._put(body)
            self.space = True
        if parts[-1]:
            self._put(parts[-1])

    def _put(self, text: str) -> None:
        if self.gap:
            self._break()
        if self.space and self.words:
            self.words.append(" ")
        self.space = False
        self.words.append(text)

    def _flush(self) -> None:
        if self.words:
            first = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent
            self.lines.append((first + "".join(self.words)).rstrip(" "))
            self.words, self.marker = [], ""
        self.space = False

    def _break(self) -> None:
        self._flush()
        if self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def block(self, spaced: bool) -> None:
        self.gap = max(self.gap, 2 if spaced else 1)

    def line_break(self) -> None:
        if self.gap:
            self._break()
        if self.words:
            self._flush()
        elif self.lines:
            self.lines.append("")
        self.space = False

    def verbatim(self, lines: list[str]) -> None:
        for k, line in enumerate(lines):
            self._break() if self.gap else self._flush()
            first = self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker and not k else self.indent
            self.marker = "" if not k else self.marker
            self.lines.append((first + line).rstrip(" "))

    def done(self) -> list[str]:
        self._flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(node: Node, depth: int = 0) -> list[str]:
    """Lines of a node's visible text."""
    out = _Lines()
    stack: list = [(node, 0, None)]
    counters: list = []
    if not node.shown:
        return []
    while stack:
        node, at, after = stack.pop()
        if at == 0:
            after = _enter(node, out, counters, depth)
            if after == "done":
                continue
        children = node.children
        while at < len(children):
            child = children[at]
            at += 1
            if isinstance(child, str):
                out.text(child)
            elif child.tag == "br":
                out.line_break()
            elif child.shown:
                stack += [(node, at, after), (child, 0, None)]
                break
        else:
            _leave(node, out, counters, after)
            continue
    return out.done()


def _enter(node: Node, out: _Lines, counters: list, depth: int):
    """Open a node; what _leave needs, or "done" if it has been laid out whole."""
    tag, before = node.tag, out.indent
    if tag == "table" and depth < TABLE_DEPTH:
        lines = _table(node, depth)
        out.block(True)
        if lines:
            out.verbatim(lines)
        out.block(True)
        return "done"
    if tag == "pre":
        out.block(True)
        text = _plain(node).removeprefix("\n").rstrip("\n")
        if text:
            out.verbatim(text.split("\n"))
        out.block(True)
        return "done"
    if tag in ("td", "th", "text"):
        out.text(" ")
    if tag in BLOCK:
        out.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
    if tag in ("ul", "ol", "menu"):
        first = whole_number(node, "start")
        counters.append(None if tag != "ol" else 0 if first is None else first - 1)
    elif tag == "li":
        if counters and counters[-1] is not None:
            counters[-1] += 1
        mark = "- " if not counters or counters[-1] is None else f"{counters[-1]}. "
        out._flush()
        if out.gap:
            out._break()
        out.marker = mark
        out.indent += " " * len(mark)
    elif tag in ("blockquote", "dd"):
        if out.gap:
            out._break()
        out.indent += "  "
    return before


def _leave(node: Node, out: _Lines, counters: list, before: str) -> None:
    tag = node.tag
    if tag in BLOCK:
        if out.indent != before:
            out._flush()
            out.marker = ""
            out.indent = before
        out.block(tag in SPACED and not (tag in ("ul", "ol") and len(counters) > 1))
    if tag in ("ul", "ol", "menu"):
        counters.pop()


def _plain(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            out.append(now)
        elif now.tag == "br":
            out.append("\n")
        elif now.shown:
            stack += now.children[::-1]
    return "".join(out)


def _table(table: Node, depth: int) -> list[str]:
    """A table's captions, then its rows with aligned columns; other content comes first, as in browsers."""
    rows: list[list[tuple[int, list[str], int]]] = []  # cells: first column, lines, columns
    taken: dict[int, int] = {}  # column -> rows below that a cell above still holds
    loose: list[str] = []
    stack: list = list(table.children[::-1])
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip(" \t\n\f\r"):
                loose.append(_SPACE.sub(" ", node).strip())
        elif not node.shown:
            continue
        elif node.tag == "tr":
            cells = _row(node, taken, loose, depth)
            if any(lines for _, lines, _ in cells):
                rows.append(cells)
        elif node.tag in ("thead", "tbody", "tfoot"):
            stack += node.children[::-1]
        elif node.tag not in ("colgroup", "col"):
            loose += render(node, depth + 1)
    widths: dict[int, int] = {}
    for cells in rows:
        for column, lines, span in cells:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
    out = loose
    for cells in rows:
        text = [""] * max(len(lines) for _, lines, _ in cells)
        at = 0
        for column, lines, span in cells:
            free = "".join(" " * (widths.get(c, 0) + 2) for c in range(at, column))
            width = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
            width = max(width, max(map(len, lines), default=0)) if span > 1 else width
            text = [t + free + (lines[k] if k < len(lines) else "").ljust(width) + "  " for k, t in enumerate(text)]
            at = column + span
        out += [t.rstrip(" ") for t in text]
    return out


def _row(row: Node, taken: dict[int, int], loose: list[str], depth: int) -> list[tuple[int, list[str], int]]:
    """The cells of a row beside those that reach down into it; text outside cells goes to loose."""
    cells, column = [], 0
    held = {c: n - 1 for c, n in taken.items()}
    for cell in row.children:
        if isinstance(cell, str):
            if cell.strip(" \t\n\f\r"):
                loose.append(_SPACE.sub(" ", cell).strip())
        elif cell.shown and cell.tag in ("td", "th"):
            while column in taken:
                column += 1
            span = min(max(whole_number(cell, "colspan") or 1, 1), COLUMNS)
            below = whole_number(cell, "rowspan")
            inner = Node("div")
            inner.children = cell.children
            cells.append((column, render(inner, depth + 1), span))
            if below == 0 or (below or 1) > 1:  # 0: all rows that follow
                held.update(dict.fromkeys(range(column, column + span), below - 1 if below else 1 << 30))
            column += span
        elif cell.shown and cell.tag not in VOID:
            loose += render(cell, depth + 1)
    taken.clear()
    taken.update({c: n for c, n in held.items() if n > 0})
    return cells


def visible_text(html: str | None) -> str | None:
    return None if html is None else "\n".join(render(parse(html)))


def extract(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, text) of every whole page."""
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(h) for h in batch.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return pages.select(id_column, html_column).mapInArrow(per_batch(run), f"`{id_column}` {kind}, text string")
