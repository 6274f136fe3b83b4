"""HTML to text as a reader sees it.

``parse`` builds a tree: tags that HTML lets authors omit are implied, void and
raw-text elements take no children, and unmatched end tags are ignored.
``render`` walks the tree without recursion, skips what is not displayed, and
writes the rest: blocks on lines of their own, blank lines around paragraphs and headings, list
items with bullets or numbers, preformatted text untouched, and the cells of a
table aligned in columns, spans included.

Both take time in proportion to the page, whatever it holds: open elements are
found by their place in the stack, text is joined once, and alignment stops at
fixed widths, beyond which text is still written, but not lined up.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned

# Element names of the HTML standard, by how they behave, and its own clamps of spans.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas datalist rp desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "caption", "legend"}
#: A start tag of the key ends an open element of the values, up to the nearest of the limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
}
#: End tags do not look beyond these.
SCOPE = frozenset("html table td th caption template".split())
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534
#: Input types that show no text.
SILENT = frozenset("hidden checkbox radio file image color range password".split())
#: Columns of text up to which nested blocks are indented, table columns padded and cells placed; columns of a table that rows can span; tables inside tables that are laid out.
INDENT, PAD, PLACE, COLUMNS, NESTED = 60, 80, 2000, 1000, 16

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""")
_OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(\s*+=\s*+)?)?")
_BARE = re.compile(r"[^\s>]*+")
_HIDES = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SIGHT = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


def attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from ``at`` on, and where the tag ends; -1 if it never does."""
    out: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(source, at)
        at = m.end()
        if m[1] is None:
            return out, at + 1 if at < len(source) else -1
        value = ""
        if m[2]:
            quote = source[at : at + 1]
            if quote in ("'", '"') and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return out, -1
                value, at = source[at + 1 : end], end + 1
            else:
                bare = _BARE.match(source, at)
                value, at = bare[0], bare.end()
        out.setdefault(m[1].lower(), html.unescape(value))


class _Stack:
    """Open elements, and by name the places where they are."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().name].pop()

    def close(self, names, limits) -> None:
        """End the nearest element of ``names``, all of them where there are several names, up to the nearest limit."""
        while (at := self.last(names)) > self.last(limits):
            self.cut(at)
            if len(names) == 1:
                return


def parse(source: str) -> Node:
    root = Node("#root")
    stack = _Stack(root)
    nodes = stack.nodes
    at = 0
    while at < len(source):
        to = source.find("<", at)
        if to < 0:
            nodes[-1].children.append(html.unescape(source[at:]))
            break
        if to > at:
            nodes[-1].children.append(html.unescape(source[at:to]))
        at = to
        m = _TAG.match(source, at)
        if m:
            ends, name, at = bool(m[1]), m[2].lower(), m.end()
            attrs = {} if ends or not m[3] else attributes(m[3] + ">", 0)[0]
        elif m := _OPEN.match(source, at):
            ends, name = source[at + 1] == "/", m[1].lower()
            attrs, at = attributes(source, m.end())
            if at < 0:  # a tag that never ends takes the rest of the page
                break
        elif source.startswith("<!--", at):
            short = next((n for n in ("<!-->", "<!--->") if source.startswith(n, at)), None)
            end = at + len(short) - 3 if short else source.find("-->", at + 4)
            if end < 0:
                break
            at = end + 3
            continue
        elif source.startswith("<![CDATA[", at) and stack.last(("svg", "math")):
            end = source.find("]]>", at)
            nodes[-1].children.append(source[at + 9 : end if end >= 0 else len(source)])
            if end < 0:
                break
            at = end + 3
            continue
        elif source[at + 1 : at + 2] in ("!", "?", "/") and source[at + 1 : at + 2]:
            end = source.find(">", at)
            if end < 0:
                break
            at = end + 1
            continue
        else:
            nodes[-1].children.append("<")
            at += 1
            continue
        if ends:
            if name == "p" and not stack.last(("p",)):
                nodes[-1].children.append(Node("p"))
            here = stack.last((name,))
            if here and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or here >= stack.last(SCOPE)):
                stack.cut(here)
            continue
        if name in ("html", "body") and stack.last((name,)):
            continue
        if name == "body" or name in CLOSES_P:
            stack.close(("head",), ())
        if name in CLOSES_P:
            stack.close(("p",), SCOPE)
        if name in ENDS:
            stack.close(*ENDS[name])
        if name in ("td", "th") and nodes[-1].name in ("table", "tbody", "thead", "tfoot"):
            nodes[-1].children.append(row := Node("tr"))
            stack.push(row)
        node = Node(name, attrs)
        nodes[-1].children.append(node)
        if name in VOID or source[at - 2] == "/" and stack.last(("svg", "math")):
            continue
        if name in RAW:
            end = _CLOSE[name].search(source, at)
            text = source[at : end.start() if end else len(source)]
            node.children.append(html.unescape(text) if name in ("textarea", "title") else text)
            if not end:
                break
            at = attributes(source, end.end())[1]
            if at < 0:
                break
            continue
        stack.push(node)
    return root


def displayed(n: Node) -> bool:
    """Whether the element has a place on the page at all."""
    if n.name in HIDDEN or "hidden" in n.attrs or n.name == "dialog" and "open" not in n.attrs:
        return False
    style = n.attrs.get("style")
    return not (style and _HIDES.search(style))


def shown(n: Node) -> list[Node | str]:
    """The children that are displayed: a closed ``details`` shows its summary, a drop-down list its choice."""
    if n.name == "details" and "open" not in n.attrs:
        return [c for c in n.children if isinstance(c, Node) and c.name == "summary"][:1]
    if n.name == "select" and "multiple" not in n.attrs and n.attrs.get("size", "1") in ("", "0", "1"):
        options, todo = [], n.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, Node):
                if c.name == "option":
                    options.append(c)
                else:
                    todo.extend(c.children[::-1])
        return [c for c in options if "selected" in c.attrs][-1:] or options[:1]
    if n.name == "input" and n.attrs.get("type", "").lower() not in SILENT:
        return [n.attrs.get("value") or n.attrs.get("placeholder", "")]
    if n.name == "textarea" and not "".join(n.children).strip():
        return [n.attrs.get("placeholder", "")]
    return n.children


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines under construction; ``gap`` is the number of blank lines due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.mark, self.indent = 0, "", 0

    def text(self, s: str) -> None:
        s = _BLANKS.sub(" ", s)
        if not self.parts or self.parts[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.put(s)

    def put(self, s: str) -> None:
        if not self.parts:
            self.begin()
        self.parts.append(s)

    def begin(self) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.parts = [" " * max(0, min(INDENT, self.indent) - len(self.mark)) + self.mark, ""]
        self.mark = ""

    def blank(self) -> bool:
        return not any(p.strip(" ") for p in self.parts)

    def end(self) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line:
            self.lines.append(line)
        self.parts = []

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            if line:
                self.put(line)
                self.end()
            elif self.lines:
                self.lines.append("")


Cell = tuple[str, int, int]


def _table(rows: list[list[Cell]]) -> list[str]:
    """Rows of (cell text, columns, rows spanned) as aligned lines; a cell may have several lines."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    busy: dict[int, int] = {}  # by column, the first row that it is free in
    widths: dict[int, int] = {}
    for r, row in enumerate(rows):
        col, line = 0, []
        for text, across, down in row:
            while busy.get(col, 0) > r:
                col += 1
            if down > 1:
                for c in range(col, min(col + across, COLUMNS)):
                    busy[c] = r + down
            parts = text.split("\n")
            if across == 1:
                widths[col] = max(widths.get(col, 0), min(PAD, max(map(width, parts))))
            line.append((col, across, parts))
            col += across
        placed.append(line)
    known = sorted(widths)
    begins = [0]
    for c in known:
        begins.append(begins[-1] + widths[c] + 2)
    out = []
    for line in placed:
        lines: dict[int, list[tuple[int, str]]] = {}
        for col, _, parts in line:
            place = begins[bisect_left(known, col)]
            for k, part in enumerate(parts):
                if part:
                    lines.setdefault(k, []).append((place, part))
        for k in sorted(lines):
            now, made = 0, []
            for place, part in lines[k]:
                gap = place - now if now < place <= PLACE else 2 if now else 0
                made.append(" " * gap + part)
                now += gap + width(part)
            out.append("".join(made).rstrip())
    return out


def _span(n: Node, name: str, most: int) -> int:
    m = re.match(r"\s*([0-9]{1,9})", n.attrs.get(name, ""))
    if not m:
        return 1
    return min(most, int(m[1])) or (most if name == "rowspan" else 1)


def render(root: Node) -> str:
    page = _Page()
    pages: list[_Page] = []
    lists: list[int | None] = []
    tables: list[list[list[Cell]]] = []
    pre = 0
    todo: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while todo:
        n, leaving, seen = todo.pop()
        if isinstance(n, str):
            if not seen:
                continue
            if pre:
                for k, line in enumerate(n.expandtabs(8).replace("\r\n", "\n").split("\n")):
                    if k:
                        if page.blank():
                            page.lines.append("")
                        page.end()
                    if line:
                        page.put(line)
            else:
                page.text(n)
            continue
        name = n.name
        cell, row = name in ("td", "th") and tables and len(tables) <= NESTED, name == "tr"
        if not leaving:
            if name != "#root" and not displayed(n):
                continue
            if style := n.attrs.get("style"):
                if m := _SIGHT.search(style):
                    seen = m[1].lower() not in ("hidden", "collapse")
            if name == "br":
                if page.parts:
                    page.end()
                elif page.lines and page.lines[-1]:
                    page.lines.append("")
                continue
            if name in BLOCK or row or name in ("td", "th") and not cell:
                page.end()
                if name in SPACED and not (name in ("ul", "ol") and lists):
                    page.gap = 1
            if name in ("ul", "menu", "dir"):
                lists.append(None)
            elif name == "ol":
                start = n.attrs.get("start", "1")
                lists.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
            elif name == "li":
                if lists and lists[-1] is not None:
                    mark, lists[-1] = f"{lists[-1]}. ", lists[-1] + 1
                else:
                    mark = "- "
                page.mark = mark if seen else ""
                n.attrs["#mark"] = mark
                page.indent += len(mark)
            elif name in ("blockquote", "dd"):
                page.indent += 2
            elif name in ("pre", "textarea"):
                pre += 1
            elif name == "table":
                tables.append([])
            elif row and tables:
                tables[-1].append([])
            elif cell:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append(page)
                page = _Page()
            elif name in ("option", "input", "button", "select"):
                page.text(" ")
            todo.append((n, True, seen))
            todo.extend((c, False, seen) for c in reversed(shown(n)))
            continue
        if cell:
            page.end()
            tables[-1][-1].append(("\n".join(x for x in page.lines if x), _span(n, "colspan", MOST_COLSPAN), _span(n, "rowspan", MOST_ROWSPAN)))
            page = pages.pop()
            continue
        if name in BLOCK or row or name in ("td", "th"):
            page.end()
            if name == "table":
                page.whole(_table(tables.pop()))
            if name in SPACED and not (name in ("ul", "ol") and len(lists) > 1):
                page.gap = 1
        if name in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif name == "li":
            page.indent -= len(n.attrs["#mark"])
            page.mark = ""
        elif name in ("blockquote", "dd"):
            page.indent -= 2
        elif name in ("pre", "textarea"):
            pre -= 1
        elif name in ("option", "input", "button", "select"):
            page.text(" ")
    page.end()
    return "\n".join(page.lines).strip("\n")


def to_text(source: str | None) -> str:
    return render(parse(source)) if source else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [to_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null or empty page has the text "" and 0 characters; null page_ids and urls
    pass through.  A page is parsed whole, in time and memory proportional to its
    length.  Repeated rows stay rows of their own; nothing depends on order, so
    there are no ties.  An empty table gives an empty result.  Other columns,
    whatever their names, are ignored.
    """
    tuned(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
