"""Visible text of web pages, laid out.

A tree builder reads the markup with implied and omitted tags, a visibility rule drops what a browser
would not show, and a renderer emits blocks on lines of their own, list items with their marks, and tables
with aligned columns.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from .columns import keyed, rekeyed

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript title object iframe canvas svg math audio video select datalist".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html legend li main menu nav ol p pre section summary table ul tr td th caption thead tbody tfoot".split())
#: Blocks with an empty line before and after.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
#: An open element on the left ends when one on the right begins; the search stops at the second set.
ENDED_BY = {
    "p": (BLOCK - {"html", "body", "tr", "td", "th", "caption", "thead", "tbody", "tfoot"}, set("table td th caption button".split())),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "td": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot", "thead"}, {"table"}), "thead": ({"tbody", "tfoot"}, {"table"}),
    "tbody": ({"tbody", "tfoot"}, {"table"}), "caption": ({"tr", "thead", "tbody", "tfoot", "td", "th"}, {"table"}), "option": ({"option", "optgroup"}, {"select"}),
}
ROW_PARENTS = {"table", "thead", "tbody", "tfoot"}
RAW = {"script", "style"}
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Depth beyond which elements no longer nest: deeper ones become siblings.
MAX_DEPTH = 200


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the element tree; end tags without an open element are ignored, open elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            self._body(tag, attrs)
            return
        if tag in BLOCK and any(n.tag == "head" for n in self.open):
            self._close("head")
        for at in range(len(self.open) - 1, 0, -1):
            own = self.open[at].tag
            ends = ENDED_BY.get(own)
            if ends and tag in ends[0]:
                del self.open[at:]
            elif self._bounds(tag, own):
                break
        if tag in ("td", "th", "tr"):
            self._back_to(ROW_PARENTS if tag == "tr" else {"tr"} | ROW_PARENTS)
        if tag in ("td", "th") and self.open[-1].tag in ROW_PARENTS:
            self._push(Node("tr", {}))
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        # a form between rows or cells holds nothing, as in the HTML standard
        between = tag == "form" and self.open[-1].tag in {"tr"} | ROW_PARENTS
        if tag not in VOID and len(self.open) < MAX_DEPTH and not between:
            self.open.append(node)

    def _bounds(self, tag, own):
        """Whether the search for elements that a start tag ends stops at an open element."""
        if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            return own == "table"
        if tag == "li":
            return own in ("ul", "ol", "menu", "dir", "td", "th")
        if tag in ("dt", "dd"):
            return own in ("dl", "td", "th")
        return own in ("table", "td", "th", "caption", "button")

    def _back_to(self, tags):
        """Ends the elements that stand between a row or cell and the part of the table that it belongs to."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at + 1:]
                return
            if self.open[at].tag in ("td", "th", "caption"):
                return

    def _push(self, node):
        self.open[-1].children.append(node)
        self.open.append(node)

    def _body(self, tag, attrs):
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
        elif not any(n.tag == "body" for n in self.open):
            self._close("head")
            self._push(Node("body", attrs))

    def _close(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return True
            if self.open[at].tag == "table" and tag not in ("div", "section", "article", "main", "body", "head", "table"):
                return False
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p" and not self._close("p"):
            self.open[-1].children.append(Node("p", {}))
        elif tag not in VOID and tag not in ("p", "html", "body"):
            self._close(tag)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def shown(node: Node) -> bool:
    """Visibility rule: element class, hidden attribute, inline style, closed details."""
    return not (node.tag in HIDDEN or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or _UNSEEN.search(node.attrs.get("style", ""))
                or (node.tag == "input"))


def width(text: str) -> int:
    """Columns that a text takes; wide letters take two, combining marks none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines of a block; text is gathered in the last line, with white space run together."""

    def __init__(self, tight: bool = False):
        self.lines, self.current, self.gap, self.tight = [], "", False, tight

    def text(self, data: str):
        flat = _SPACE.sub(" ", data)
        if not self.current or self.current.endswith(" "):
            flat = flat.lstrip(" ")
        self.current += flat

    def end(self):
        if self.current.strip(" "):
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.current.rstrip(" "))
        self.current = ""

    def space(self):
        self.end()
        self.gap = True

    def block(self, lines: list[str]):
        self.end()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines


def _rendered(nodes: list, page: _Page, pre: bool = False) -> None:
    for node in nodes:
        if isinstance(node, str):
            if pre:
                first, *rest = node.split("\n")
                page.current += first
                for line in rest:
                    page.lines.append(page.current)
                    page.current = line
            else:
                page.text(node)
        elif shown(node):
            _element(node, page, pre)


def _lines(nodes: list, pre: bool = False, tight: bool = False) -> list[str]:
    page = _Page(tight)
    _rendered(nodes, page, pre)
    page.end()
    return page.lines


def _element(node: Node, page: _Page, pre: bool) -> None:
    tag = node.tag
    if tag == "br":
        page.lines.append(page.current.rstrip(" "))
        page.current = ""
    elif tag == "img":
        page.text(node.attrs.get("alt", ""))
    elif tag not in BLOCK:
        _rendered(node.children, page, pre)
    else:
        spaced = tag in SPACED and not (page.tight and tag in ("ul", "ol"))  # a list inside an item follows at once
        (page.space if spaced else page.end)()
        if tag in ("ul", "ol", "menu", "dir"):
            page.block(_list(node))
        elif tag == "table":
            page.block(_table(node))
        elif tag == "pre":
            page.block(_lines(node.children, True))
        elif tag == "hr":
            page.block(["---"])
        elif tag == "blockquote":
            page.block(["> " + x if x else ">" for x in _lines(node.children)])
        elif tag == "dd":
            page.block(["  " + x if x else x for x in _lines(node.children)])
        elif tag == "li":
            page.block(_item("- ", node))
        else:
            _rendered(node.children, page, pre)
        (page.space if spaced else page.end)()


def _item(mark: str, node: Node) -> list[str]:
    return [(mark if k == 0 else " " * len(mark)) + x if x or k == 0 else x for k, x in enumerate(_lines(node.children, tight=True) or [""])]


def _list(node: Node) -> list[str]:
    out, nth = [], int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out += _lines([child])
        elif shown(child):
            if child.tag == "li":
                out += _item(f"{nth}. " if node.tag == "ol" else "- ", child)
                nth += 1
            else:  # a list right inside a list
                out += ["  " + x if x else x for x in _lines([child])]
    return out


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "")
    return max(1, min(1000, int(value))) if re.fullmatch(r"\d{1,4}", value) else 1


def _table(node: Node) -> list[str]:
    """Rows on a grid with row and column spans; columns are padded to their widest line.

    What stands in the table or its rows outside of cells and captions goes before the table.
    """
    strays, heads, rows = [], [], []

    def collect(parent):
        for child in parent.children:
            if isinstance(child, str):
                strays.append(child)
            elif shown(child):
                if child.tag == "tr":
                    cell = [not isinstance(c, str) and c.tag in ("td", "th") for c in child.children]
                    rows.append([c for c, own in zip(child.children, cell, strict=True) if own and shown(c)])
                    strays.extend(c for c, own in zip(child.children, cell, strict=True) if not own)
                elif child.tag in ("thead", "tbody", "tfoot", "colgroup", "form"):
                    collect(child)
                elif child.tag == "caption":
                    heads.extend(_lines(child.children))
                else:
                    strays.append(child)

    collect(node)
    grid: list[dict[int, list[str]]] = []
    below: dict[int, int] = {}  # column -> rows that a cell above still fills
    for row in rows:
        line, column = {}, 0
        filled, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for cell in row:
            while column in filled:
                column += 1
            line[column] = _lines(cell.children)
            for c in range(column, column + _span(cell, "colspan")):
                if _span(cell, "rowspan") > 1:
                    below[c] = _span(cell, "rowspan") - 1
            column += _span(cell, "colspan")
        grid.append(line)
    used = sorted({c for line in grid for c in line})
    size = {c: max((width(x) for line in grid for x in line.get(c, [])), default=0) for c in used}
    out = _lines(strays) + heads
    for line in grid:
        for k in range(max((len(x) for x in line.values()), default=0)):
            cells = [(line.get(c, []) + [""] * (k + 1))[k] for c in used]
            text = " | ".join(x + " " * (size[c] - width(x)) for c, x in zip(used, cells, strict=True)).rstrip(" ")
            out.append(text)
    return out


def text_of(html: str) -> str:
    """Laid-out visible text of a page; at most one empty line in a row."""
    lines = _lines([parse(html)])
    out = [x for k, x in enumerate(lines) if x or (k and lines[k - 1])]
    return "\n".join(out).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text, n_chars, n_lines) of every page.

    A null page gives null text and zeros, an empty or invisible one the empty text.  Rows with equal or
    null keys stay rows of their own; other columns are not read.
    """
    def run(batches):
        for pdf in batches:
            texts = [None if h is None else text_of(h) for h in pdf["text"].tolist()]
            yield pd.DataFrame({"key": pdf["key"], "text": texts, "n_chars": [len(t or "") for t in texts],
                                "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]})

    return rekeyed(keyed(pages, key, html).mapInPandas(run, "key string, text string, n_chars long, n_lines long"), pages, key)
