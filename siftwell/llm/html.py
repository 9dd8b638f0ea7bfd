"""HTML extraction by layout: a tree with implied tags, visibility rules, and all visible text as blocks, lists and tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate
from unicodedata import east_asian_width

from pyspark.sql import DataFrame

from siftwell.llm.shared import map_text

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template noscript title object iframe audio video canvas datalist".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tr caption".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
# Fixed values for svg and math: what shows no text, what holds HTML again, where svg shows text, and the HTML tags that end them.
FOREIGN_UNSEEN = set("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml mphantom".split())
HOLDS_HTML = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
SHOWN = {"text", "foreignobject"}
BREAKS_OUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())
# What an opening tag ends, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
GONE = re.compile(r"display\s*:\s*none(?![a-z-])", re.I)
SEEN = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)", re.I)
# Comments, and what comments can't be in: raw text and tags with quoted attributes. What isn't closed ends with the page.
MARKUP = re.compile(
    r"<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*(?:>|\Z)(?:(?!</\1\b)[\s\S])*+"
    r"|<!--(?:-?>|[\s\S]*?(?:--!?>|\Z))"
    r"|</?[a-z](?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+(>|\Z)",
    re.I,
)
BLANK = re.compile(r"[ \t\n\r\f]+")
MOST_CELLS, MOST_ROWS = 1000, 65534
"""Widest column span and deepest row span, as HTML has them."""


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)
    foreign: bool = False
    """An element of svg or math."""
    mute: bool = False
    """Inside svg and outside its text elements."""


class TreeBuilder(HTMLParser):
    """Builds a tree: ends what an opening tag implies ended, wraps stray rows and cells, ignores ends of what isn't open."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section of another kind than HTML's is a comment that ends with the next ">", by HTML's rules."""
        return self.rawdata.find(">", i) + 1 or -1

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        """Where in open the elements of each tag are."""
        self.begun = False
        self.last = self.root

    def _cut(self, at: int) -> None:
        """Ends all elements from a depth on."""
        for node in self.open[at:]:
            self.depths[node.tag].pop()
        del self.open[at:]

    def _deepest(self, tags: set[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Ends the outermost of some open elements that lies within the innermost of others, and all in it."""
        floor = self._deepest(stop)
        first = [d[at] for d in (self.depths[t] for t in tags) if (at := bisect_right(d, floor)) < len(d)]
        if first:
            self._cut(min(first))

    @property
    def _foreign(self) -> bool:
        return self.open[-1].foreign and self.open[-1].tag not in HOLDS_HTML

    def _push(self, node: Node) -> None:
        node.foreign = self._foreign or node.tag in ("svg", "math")
        node.mute = node.tag == "svg" or self.open[-1].mute and not (node.foreign and node.tag in SHOWN)
        self.last = node
        self.open[-1].children.append(node)
        if node.tag not in VOID:
            self.depths[node.tag].append(len(self.open))
            self.open.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in BREAKS_OUT and self._foreign:
            self._cut(len(self.open) - 1)
        if self._foreign:
            self._push(Node(tag, dict(attrs)))
            return
        if tag in ("html", "body") and self.depths[tag] or tag == "head" and self.begun:
            return
        self.begun = self.begun or tag != "html" and tag not in IN_HEAD
        if self.open[-1].tag == "head" and tag not in IN_HEAD or tag == "body" or tag in BLOCKS and tag != "html":
            self._close({"head"}, {"template"})
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "caption", "button", "table"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self._push(Node("tr"))
        self._push(Node(tag, dict(attrs)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash ends elements of svg and math; HTML ignores it."""
        self.handle_starttag(tag, attrs)
        if self.open[-1] is self.last and self.last.foreign:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.depths["p"]:
            self.open[-1].children.append(Node(tag))
            return
        depth = self._deepest({tag})
        if depth > (0 if tag in ("table", "body", "html") else self._deepest({"table"})):
            self._cut(depth)

    def handle_data(self, data: str) -> None:
        if BLANK.sub("", data):
            self.begun = True
            if self.open[-1].tag == "head":
                self._close({"head"}, set())
        if not self.open[-1].mute:
            self.open[-1].children.append(data)


def shown(node: Node, parent: Node | None) -> bool:
    """Whether an element takes part in the layout."""
    if node.foreign and (node.tag in FOREIGN_UNSEEN or node.attrs.get("display") == "none"):
        return False
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and not (node.tag == "summary" and next((c for c in parent.children if isinstance(c, Node) and c.tag == "summary"), None) is node):
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    return node.tag not in UNSEEN and "hidden" not in node.attrs and not GONE.search(node.attrs.get("style") or "") and not (node.tag == "input" and (node.attrs.get("type") or "").lower() == "hidden")


def legible(node: Node, above: bool) -> bool:
    """Whether an element's own text can be seen: what its visibility says, else what holds around it."""
    found = SEEN.findall(node.attrs.get("style") or "")
    said = (found[-1] if found else node.attrs.get("visibility") or "" if node.foreign else "").lower()
    return False if said in ("hidden", "collapse") else True if said == "visible" else above


def lines_of_its_own(node: Node) -> bool:
    return node.foreign and (node.tag in SHOWN or node.tag == "mtr" or node.tag == "math" and node.attrs.get("display") == "block")


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text under construction; blank lines and line ends are asked for and come before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False
        self.mark = ""

    def end_line(self) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line.strip():
            self.lines.append(line)
        self.parts = []

    def space(self) -> None:
        self.end_line()
        self.gap = bool(self.lines)

    def break_line(self) -> None:
        if self.parts:
            self.end_line()
        elif self.lines:
            self.gap = True

    def _begin(self, indent: str) -> None:
        if self.gap and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.gap = False
        if self.mark:
            self.parts, self.mark = [indent[: max(0, len(indent) - len(self.mark))] + self.mark], ""
        elif indent:
            self.parts = [indent]

    def text(self, data: str, indent: str) -> None:
        data = BLANK.sub(" ", data)
        if not self.parts:
            data = data.lstrip(" ")
            if not data:
                return
            self._begin(indent)
        elif self.parts[-1].endswith(" ") and data.startswith(" "):
            data = data[1:]
        if data:
            self.parts.append(data)

    def preformatted(self, data: str, indent: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.lines.append("".join(self.parts).rstrip(" "))
                self.parts = []
            if line:
                if not self.parts:
                    self._begin(indent)
                self.parts.append(line)

    def rows(self, rows: list[str], indent: str) -> None:
        for row in rows:
            self.end_line()
            self._begin(indent)
            self.parts.append(row)
            self.end_line()

    def done(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return "\n".join(self.lines)


PADDING = 8
"""A table is aligned if that takes at most so many spaces for each character of its text; each cell counts as eight more."""
WIDE = 80
"""Lines of cells that are wider don't count for a column's width where a table would need too much padding."""
MOST_COLUMNS = 1000
"""Columns of a table; cells beyond them follow unaligned."""


def _starts(placed: list[list[tuple[int, str, int]]], widest: int | None) -> list[int]:
    """Where columns begin, from the widths of the lines in them; lines wider than `widest` don't count."""
    def wide(text: str) -> int:
        return max((w for x in text.split("\n") if (w := width(x)) <= widest), default=0) if widest is not None else max(width(x) for x in text.split("\n"))

    widths: dict[int, int] = {}
    for cells in placed:
        for at, text, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), wide(text))
    for cells in placed:
        for at, text, span in cells:
            room = sum(widths.get(at + i, 0) for i in range(span)) + 2 * (span - 1)
            if span > 1 and (more := wide(text) - room) > 0:
                widths[at + span - 1] = widths.get(at + span - 1, 0) + more
    return list(accumulate((widths.get(i, 0) + 2 for i in range(max((at + span for row in placed for at, _, span in row), default=0))), initial=0))


def _row_lines(row: list[tuple[int, str, int]], starts: list[int] | None) -> list[str]:
    """The lines of a row; without starts cells follow one another after two spaces."""
    texts = [(starts[at] if starts else 0, text.split("\n")) for at, text, _ in row]
    out = []
    for i in range(max((len(t) for _, t in texts), default=0)):
        line, room = [], 0
        for start, t in texts:
            part = t[i] if i < len(t) else ""
            gap = max(start - room, 2 if line and part else 0)
            line.append(" " * gap + part)
            room += gap + width(part)
        whole = "".join(line)
        if whole.strip():
            out.append(whole.rstrip(" "))
    return out


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns, rows) with columns aligned; a cell's lines stand below one another. Places that a cell of a
    row above reaches down to stay empty. A table that is mostly padding when aligned (see PADDING) is aligned without its wide
    lines, and if that is still too much its cells follow one another; all text is kept."""
    placed: list[list[tuple[int, str, int]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        at, cells = 0, []
        for text, span, deep in row:
            while taken.get(at, 0) > 0:
                at += 1
            at = min(at, MOST_COLUMNS)
            span = max(1, min(span, MOST_COLUMNS - at))
            cells.append((at, text, span))
            if deep > 1 and at < MOST_COLUMNS:
                taken |= {at + i: deep for i in range(span)}
            at += span
        placed.append(cells)
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
    most = PADDING * sum(len(text) + 8 for row in placed for _, text, _ in row)
    for widest in (None, WIDE):
        starts = _starts(placed, widest)
        # The last cell that shows anything decides how far a line is padded.
        if sum(max((starts[at] for at, text, _ in row if text), default=0) * max((text.count("\n") + 1 for _, text, _ in row), default=0) for row in placed) <= most:
            return [line for row in placed for line in _row_lines(row, starts)]
    return [line for row in placed for line in _row_lines(row, None)]


def _counted(n: int, kind: str) -> str:
    """A list's number as its type shows it: letters and Roman numerals where they can, else digits."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(97 + rest) + out
        return out.upper() if kind == "A" else out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def number(text: str | None, low: int, high: int) -> int:
    """A whole number of an attribute, held within limits; low where there is none."""
    found = re.match(r"\s*\+?(\d+)", text or "")
    return low if not found else high if len(found[1]) > 6 else min(max(low, int(found[1])), high)


def render(root: Node) -> str:
    """All visible text of a tree. The walk has its own stack, so depth of nesting is no limit."""
    pages, tables, lists = [Page()], [], []
    indents, pre = [""], 0
    inside: list[tuple[Node, bool]] = []
    todo: list[tuple[object, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        parent, seen = inside[-1] if inside else (None, True)
        if isinstance(node, str):
            if seen and not (parent.tag == "details" and "open" not in parent.attrs):
                (page.preformatted if pre else page.text)(node, indents[-1])
            continue
        tag = node.tag
        if not leaving:
            if not shown(node, parent):
                continue
            if tag == "br":
                page.break_line()
                continue
            if lines_of_its_own(node):
                page.end_line()
            elif node.foreign and tag == "mtd":
                page.text(" ", indents[-1])
            if tag in ("td", "th"):
                pages.append(Page())
                indents.append("")
                lists.append(None)
            elif tag == "table":
                page.space()
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in SPACED and not (tag in ("ul", "ol") and lists and lists[-1] is not None):
                page.space()
            elif tag in BLOCKS:
                page.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                page.end_line()
                back = tag == "ol" and "reversed" in node.attrs
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
                if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start") or ""):
                    first = int(node.attrs["start"])
                lists.append([first, -1 if back else 1, node.attrs.get("type") or "1"] if tag == "ol" else [])
            elif tag == "li":
                owner = lists[-1] if lists and lists[-1] is not None else []
                if owner and re.fullmatch(r"-?\d{1,9}", node.attrs.get("value") or ""):
                    owner[0] = int(node.attrs["value"])
                mark = f"{_counted(owner[0], owner[2])}. " if owner else "- "
                if owner:
                    owner[0] += owner[1]
                page.mark = mark if legible(node, seen) else ""
                indents.append(indents[-1] + " " * len(mark))
            elif tag in ("dd", "blockquote"):
                indents.append(indents[-1] + "  ")
            elif tag in ("pre", "textarea"):
                pre += 1
                # HTML drops a line end right after the tag.
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = re.sub(r"^\r?\n", "", node.children[0])
            elif tag == "optgroup" and node.attrs.get("label"):
                page.end_line()
                page.text(node.attrs["label"], indents[-1])
                page.end_line()
            elif tag == "q":
                page.text('"', indents[-1])
            inside.append((node, legible(node, seen)))
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
            continue
        inside.pop()
        if tag in ("td", "th"):
            text = pages.pop().done()
            indents.pop()
            lists.pop()
            span, deep = number(node.attrs.get("colspan"), 1, MOST_CELLS), number(node.attrs.get("rowspan"), 1, MOST_ROWS)
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((text, span, deep))
            else:
                pages[-1].rows(text.split("\n") if text else [], indents[-1])
            continue
        if tag == "table":
            page.rows(table_lines(tables.pop()), indents[-1])
            page.space()
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
            page.end_line()
            if not any(x is not None for x in lists[-1:]):
                page.gap = bool(page.lines)
        elif tag == "li":
            page.end_line()
            page.mark = ""
            indents.pop()
        elif tag in ("dd", "blockquote"):
            page.end_line()
            indents.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "q":
            page.text('"', indents[-1])
        if lines_of_its_own(node):
            page.end_line()
        if tag in SPACED and tag not in ("ul", "ol", "table"):
            page.space()
        elif tag in BLOCKS:
            page.end_line()
    return pages[0].done()


def _markup(m: re.Match) -> str:
    """Comments go, and so does a tag that the page's end cuts off; what looks like markup in a text area or title is text."""
    if (m[1] or "").lower() in ("textarea", "title"):
        head, end, body = m[0].partition(">")
        return head + end + body.replace("<", "&lt;")
    return "" if m[0].startswith("<!--") or m[2] == "" else m[0]


def visible_text(html: str | None) -> str:
    builder = TreeBuilder()
    html = MARKUP.sub(_markup, html or "")
    # What begins a section after the last ">" is cut off by the page's end.
    cut = html.find("<![", html.rfind(">") + 1)
    builder.feed(html if cut < 0 else html[:cut])
    builder.close()
    return render(builder.root)


def extract_html(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns and text, the visible text of a page.

    Null and empty pages give an empty text, a page without tags its text. Broken markup never fails and takes no longer:
    open elements end with the page, a tag or comment that the page's end cuts off shows nothing. Style sheets are not read. Rows stay as they are, repeated ones too; an empty table gives an empty one.
    """
    return map_text(pages, keep, {"text": "string"}, lambda: lambda texts: [[visible_text(t) for t in texts]], text=html, slab=50)
