"""Visible text of web pages, laid out by their elements.

A page is read into a tree (end tags that may be left out are implied, unknown
tags are inline), and the tree is walked without recursion.  Blocks start lines,
paragraph-like blocks are set off by an empty line, list items get markers and
indents, cells of a table are aligned in columns, ``pre`` keeps its blanks, and
all other runs of blanks become one.  Nothing inside hidden elements is emitted.

Columns are padded up to ``MOST_PAD`` characters; longer cells simply run on, so
output stays in proportion to the page.  Null and empty pages give empty text;
pages without any tag are text.  Every row gives a row, repeated ones too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import slices

MOST_PAD = 80
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)"
    r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_BLANK = re.compile(r"[ \t\r\n\f]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")

# Element names by their meaning in HTML (fixed values).
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
_HEAD = set("base link meta noscript script style template title".split())
_UNSEEN = set(
    "head script style title template noscript iframe noembed noframes datalist audio video "
    "canvas object rp".split()
)
_PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset".split())
_BLOCKS = _PARAGRAPHS | set(
    "html body div section article header footer nav main aside li dt dd details summary "
    "figcaption form address center legend search dialog hgroup caption tr thead tbody tfoot "
    "optgroup option xmp".split()
)
_ENDS_P = _PARAGRAPHS | set(
    "address article aside center details dialog div fieldset figcaption footer form header "
    "hgroup main nav search section summary".split()
)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TABLE_PARTS = set("table caption colgroup thead tbody tfoot tr td th".split())
_SCOPE = {"table", "td", "th", "caption", "html", "template", "button", "object"}
#: Start tag: the open elements it ends, and those beyond which it does not look.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"} | _SCOPE),
    "dt": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "dd": ({"dt", "dd"}, {"dl"} | _SCOPE),
    "option": ({"option"}, {"select", "datalist", "optgroup"} | _SCOPE),
    "optgroup": ({"option", "optgroup"}, {"select"} | _SCOPE),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "a": ({"a"}, _SCOPE),
    "button": ({"button"}, _SCOPE - {"button"}),
}


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


class TreeBuilder:
    """Reads a page into a tree."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.body = False

    def page(self, source: str) -> Node:
        """The tree of one page."""
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            if found is None:
                self._text(source[at:])
                break
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                else:
                    self._start(tag, _attributes(found[3]) if found[3].strip(" /\n") else {})
                    if tag in _RAW:
                        at = self._raw(source, at, tag)
        return self.root

    def _raw(self, source: str, at: int, tag: str) -> int:
        close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
        end = close.start() if close else len(source)
        inside = source[at:end]
        self.open[-1].children.append(html.unescape(inside) if tag == "textarea" else inside)
        self.open.pop()
        return close.end() if close else end

    def _text(self, source: str) -> None:
        if not self.body and source.strip():
            self._enter_body()
        if self.body or self.open[-1].tag != "html":
            self.open[-1].children.append(html.unescape(source))

    def _enter_body(self) -> None:
        self.body = True
        del self.open[1:]
        self._push("body", {})

    def _push(self, tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)

    def _close(self, ends: set[str], limits: set[str]) -> bool:
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.open[place].tag
            if tag in ends:
                del self.open[place:]
                return True
            if tag in limits:
                break
        return False

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "head", "body"):
            if tag == "head" and not self.body and len(self.open) == 1:
                self._push(tag, attributes)
            if tag == "body" and not self.body:
                self._enter_body()
                self.open[-1].attributes = attributes
            return
        if not self.body and tag not in _HEAD:
            self._enter_body()
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPE)
        if tag in _HEADINGS and self.open[-1].tag in _HEADINGS:
            self.open.pop()
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag in ("td", "th"):
            self._imply("tr")
        elif tag == "tr":
            self._imply("tbody")
        self._push(tag, attributes)
        if tag in _VOID:
            self.open.pop()

    def _imply(self, tag: str) -> None:
        """A row for a cell, a body for a row, where the page has none open."""
        if tag == "tr" and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if self.open[-1].tag == "table":
                self._push("tbody", {})
            self._push("tr", {})
        elif tag == "tbody" and self.open[-1].tag == "table":
            self._push("tbody", {})

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in _VOID - {"br"}:
            return
        if tag == "br":
            self._start("br", {})
        elif tag == "head":
            self._close({"head"}, set())
        elif tag in _TABLE_PARTS:
            self._close({tag}, {"table"} - {tag})
        else:
            ends = _HEADINGS if tag in _HEADINGS else {tag}
            self._close(ends, _SCOPE - {tag})


def _seen(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether the element is laid out, and whether its text is visible."""
    own = node.attributes
    if node.tag in _UNSEEN or "hidden" in own:
        return False, False
    if node.tag == "dialog" and "open" not in own:
        return False, False
    if "style" in own:
        style = re.sub(r"\s|/\*.*?\*/", "", own["style"].lower())
        rules = dict(r.split(":", 1) for r in style.split(";") if ":" in r)
        if rules.get("display", "").startswith("none"):
            return False, False
        if "visibility" in rules:
            shown = not rules["visibility"].startswith(("hidden", "collapse"))
    return True, shown


def _chosen(node: Node) -> list:
    """The children that are laid out: of a closed details its first summary, of
    a select its selected or first option."""
    inside = node.children
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in inside if isinstance(c, Node) and c.tag == "summary"][:1]
    if node.tag == "select":
        options, waiting = [], list(reversed(inside))
        while waiting:
            child = waiting.pop()
            if isinstance(child, Node):
                if child.tag == "option":
                    options.append(child)
                waiting += reversed(child.children)
        picked = [o for o in options if "selected" in o.attributes]
        return picked[-1:] or options[:1]
    return inside


class _Lines:
    """Lines of one column of text."""

    def __init__(self, node: Node | None = None):
        self.node = node
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.items = 0

    def text(self, source: str, keep: bool) -> None:
        if keep:
            first, *rest = source.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in rest:
                self.line(keep=True)
                self.now.append(line)
            return
        plain = _BLANK.sub(" ", source)
        if plain.startswith(" ") and (not self.now or self.now[-1].endswith((" ", "\t"))):
            plain = plain[1:]
        if plain:
            self.now.append(plain)

    def line(self, keep: bool = False) -> None:
        """End the line at hand; ``keep`` also ends an empty one."""
        text = "".join(self.now).rstrip(" \t")
        self.now = []
        if text or keep:
            self.add([text])

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.done and self.gap > 1:
                self.done.append("")
            self.gap = 0
            self.done += lines

    def block(self, gap: int) -> None:
        """A block border with at least this gap (2: an empty line)."""
        self.line()
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.line()
        lines = self.done
        while lines and not lines[-1]:
            lines.pop()
        return lines


class _Grid:
    """Rows of a table; a cell has its lines and the columns it spans."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.below: dict[int, int] = {}
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.taken = {c for c, n in self.below.items() if n > 0}
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        column = row[-1][0] + row[-1][1] if row else 0
        while column in self.taken:
            column += 1
        row.append((column, across, lines))
        if down > 1:
            for c in range(column, column + across):
                self.below[c] = down - 1

    def lines(self) -> list[str]:
        """Aligned columns, separated by a bar; empty rows are left out."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    width = min(max(map(len, lines), default=0), MOST_PAD)
                    widths[column] = max(widths.get(column, 0), width)
        out = list(self.caption)
        for row in self.rows:
            for n in range(max((len(c[2]) for c in row), default=0)):
                parts, at = [], 0
                for column, across, lines in row:
                    while at < column:
                        if widths.get(at):
                            parts.append(" " * widths[at])
                        at += 1
                    spans = [widths.get(c, 0) for c in range(column, column + across)]
                    width = sum(spans) + 3 * (sum(1 for w in spans if w) - 1)
                    at = column + across
                    text = lines[n] if n < len(lines) else ""
                    if text or width > 0:
                        parts.append(text.ljust(width))
                out.append(" | ".join(parts).rstrip(" |") if n else " | ".join(parts).rstrip())
        return out


def _whole(source: str | None, default: int, least: int, most: int) -> int:
    found = _NUMBER.match(source or "")
    return min(max(int(found[1]), least), most) if found else default


def visible_text(source: str) -> str:
    """The visible text of one page."""
    root = TreeBuilder().page(source)
    columns = [_Lines()]
    grids: list[_Grid] = []
    #: Waiting steps: a child to lay out, or an element to finish.
    waiting: list[tuple] = [(root, True, False, None)]
    while waiting:
        node, shown, keep, leaving = waiting.pop()
        if isinstance(node, str):
            if shown:
                columns[-1].text(node, keep)
            continue
        tag, own = node.tag, node.attributes
        gap = 0 if tag not in _BLOCKS else 1
        if tag in _PARAGRAPHS:
            gap = 1 if tag in ("ul", "ol", "menu") and leaving_item(columns) else 2
        if leaving is None:
            laid, shown = _seen(node, shown)
            if not laid:
                continue
            if tag == "br":
                columns[-1].line(keep=True)
                continue
            if gap:
                columns[-1].block(gap)
            if tag == "hr":
                if shown:
                    columns[-1].add(["---"])
                    columns[-1].gap = 2
                continue
            if tag == "input":
                kind = own.get("type", "text").lower()
                if shown and kind not in ("hidden", "password", "checkbox", "radio", "image", "file"):
                    columns[-1].text(own.get("value") or own.get("placeholder", ""), False)
                continue
            if tag == "table":
                grids.append(_Grid())
            elif tag == "tr" and grids:
                grids[-1].row()
            if tag in ("li", "dd", "blockquote", "td", "th", "caption"):
                columns.append(_Lines(node))
            elif tag in ("ul", "ol", "menu"):
                columns.append(_Lines(node))
                columns[-1].items = _whole(own.get("start"), 1, -(10**9), 10**9) - 1
            keep = keep or tag in ("pre", "textarea", "xmp")
            waiting.append((node, shown, keep, columns[-1]))
            inside = _chosen(node)
            if tag == "pre" and inside and isinstance(inside[0], str) and inside[0][:1] == "\n":
                inside = [inside[0][1:], *inside[1:]]
            waiting += [(child, shown, keep, None) for child in reversed(inside)]
            continue
        if tag in ("li", "dd", "blockquote", "td", "th", "caption", "ul", "ol", "menu"):
            lines = columns.pop().result()
            outer = columns[-1]
            if tag in ("td", "th") and grids:
                across = _whole(own.get("colspan"), 1, 1, 1000)
                grids[-1].cell(lines, across, _whole(own.get("rowspan"), 1, 1, 65534))
            elif tag == "caption" and grids:
                grids[-1].caption = lines
            elif tag == "li":
                mark = "- "
                if outer.node is not None and outer.node.tag == "ol":
                    outer.items = _whole(own.get("value"), outer.items + 1, -(10**9), 10**9)
                    mark = f"{outer.items}. "
                if lines:
                    indent = " " * len(mark)
                    outer.add([mark + lines[0], *(indent + x if x else x for x in lines[1:])])
            elif tag in ("dd", "blockquote"):
                mark = "> " if tag == "blockquote" else "  "
                outer.add([(mark + x).rstrip() for x in lines])
            else:
                outer.add(lines)
        elif tag == "table" and grids:
            columns[-1].line()
            columns[-1].add(grids.pop().lines())
        if gap:
            columns[-1].block(gap)
    return "\n".join(columns[0].result())


def leaving_item(columns: list[_Lines]) -> bool:
    """Whether a list stands inside an item of another list."""
    return any(c.node is not None and c.node.tag == "li" for c in columns[-2:])


def page_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``<key>, text``: the visible text of every page (``html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 2 << 20):
            found = [visible_text(p) for p in part.column("html").to_pylist()]
            yield pa.record_batch([part.column("key"), pa.array(found, pa.string())], names=["key", "text"])

    source = pages.select(F.col(key).alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
