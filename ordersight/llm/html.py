"""Layout-aware rendering of HTML pages to text.

A page becomes a tree: a tolerant tokenizer, and a builder with implied tags
(an open paragraph ends at the next block, a list item at the next item, cells,
rows and table sections at their successors; end tags close what is open inside
them, but not out of a table cell). The tree is walked without recursion, and
all visible text is emitted:

* scripts, styles, templates, the head, embedded media and comments are not
  visible, nor is what ``hidden``, ``display:none``, a closed ``details`` or an
  option that isn't chosen hides; ``visibility`` is inherited and may be undone;
* white space collapses except in ``pre`` and ``textarea``; blocks start a line,
  and paragraphs, headings, lists and tables stand between blank lines;
* list items have bullets or numbers (``start`` and ``value`` count), and nested
  items and further lines of an item are indented under it;
* table cells are aligned in columns, with ``colspan`` and ``rowspan``; a cell
  of several lines makes a row of several lines. Text of a table outside cells
  comes before it. Cells wider than ``MAX_PAD`` are whole, but nothing is padded
  beyond it, so output stays in proportion to the text.

Every page is rendered on its own in one map over the table, so large groups of
equal pages or hosts need no care.

Defined cases: a null or empty page gives empty text; a page without tags is
its own text. A null id is kept, repeated rows are rendered each. Tags that are
never closed end with the page; an unfinished tag at the end of a page is not
text. An empty table gives no rows. Columns other than id and page are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MAX_PAD = 40
#: Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title template head iframe noembed noframes object video audio canvas datalist".split())
HEAD = frozenset("title meta link script style base template noscript basefont bgsound".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
table ul xmp optgroup option""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre xmp blockquote table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li optgroup option legend".split()) | HEADINGS
#: A start tag ends the first of these that is open, up to the elements that bound it.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["optgroup", "option"]), frozenset("select datalist".split())),
    "td": (frozenset(["td", "th", "caption"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th", "caption"]), frozenset("tr table".split())),
    "tr": (frozenset(["tr", "caption"]), frozenset("thead tbody tfoot table".split())),
    "thead": (frozenset("thead tbody tfoot tr caption".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
}
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption html body".split())
CELLS = frozenset("td th caption table".split())

_TAG = re.compile(r"""</?([A-Za-z][^\s/>\x00]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTR = re.compile(r"""([^\s"'>/=\x00][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
_NOT_P = frozenset("td th caption table button object".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(page)
    opened: dict[str, int] = {}  # how many elements of each name are open

    def pop_to(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def close(names: frozenset, bounds: frozenset) -> None:
        if any(opened.get(x) for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    while stack[k - 1].tag in names:  # a section ends together with its row
                        k -= 1
                    pop_to(k)
                    return
                if stack[k].tag in bounds:
                    return

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if stack[-1].tag == "head" and not page[at:lt].isspace():
                pop_to(len(stack) - 1)
            stack[-1].children.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        follow = page[lt + 1:lt + 2]
        if follow in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if not (follow.isascii() and follow.isalpha()) and follow != "/":
            stack[-1].children.append("<")
            at = lt + 1
            continue
        gt = page.find(">", lt)
        if gt < 0:
            break  # an unfinished tag
        m = _TAG.match(page, lt)
        if m is None:  # a quote that never ends, or "</ "
            m = _TAG.match(page[lt:gt].replace('"', " ").replace("'", " ") + ">")
            at = gt + 1
            if m is None:
                continue
        else:
            at = m.end()
        tag = m[1].lower()
        if follow == "/":
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif opened.get(tag):
                bounds = frozenset() if tag in TABLE_PARTS else CELLS
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in bounds:
                        break
            elif tag == "p":
                stack[-1].children.append(Node("p", {}))
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if tag in CLOSES_P and opened.get("p"):
            close(frozenset(["p"]), _NOT_P)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in ENDS:
            close(*ENDS[tag])
        node = Node(tag, _attributes(m[2]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            body = page[at:end.start() if end else n]
            if tag not in UNSEEN:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            gt = page.find(">", end.end()) if end else -1
            at = n if gt < 0 else gt + 1
        elif tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


class Flow:
    """Lines of one flow of blocks: a page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.need = 0  # line feeds wanted before the next text
        self.space = False
        self.indents: list[str] = []
        self.marker: str | None = None

    def block(self, feeds: int) -> None:
        self.need = max(self.need, feeds)

    def _start(self) -> None:
        if self.need and (self.lines or self.line):
            self._end()
            # one end of line is made; the others are empty lines
            while len(self.lines) and self._empty() < self.need - 1:
                self.lines.append("")
        self.need = 0
        if not self.line:
            indent = "".join(self.indents)
            if self.marker is not None:
                indent = "".join(self.indents[:-1]) + self.marker
                self.marker = None
            self.line.append(indent)
            self.space = False

    def _empty(self) -> int:
        k = 0
        while k < len(self.lines) and self.lines[-1 - k] == "":
            k += 1
        return k

    def _end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line = []
        self.space = False

    def text(self, s: str) -> None:
        parts = _SPACE.sub(" ", s)
        if not parts.strip(" "):
            self.space = self.space or bool(parts)
            return
        fresh = self.need > 0 or not self.line
        gap = self.space or parts[0] == " "
        self._start()
        if gap and not fresh:
            self.line.append(" ")
        self.line.append(parts.strip(" "))
        self.space = parts[-1] == " "

    def exact(self, s: str) -> None:
        """Preformatted text, with its own line feeds."""
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.feed()
            if part:
                self._start()
                self.line.append(part)

    def feed(self) -> None:
        """A line break."""
        if self.line:
            self._end()
        elif self.lines and not self.need:
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        for k, s in enumerate(lines):
            if k:
                self.need = max(self.need, 1)
            if s:
                self._start()
                self.line.append(s)
            elif self.lines or self.line:
                self._end()
                self.lines.append("")

    def done(self) -> list[str]:
        self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Grid:
    """The cells of a table, by row and column."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}  # column -> rows it is still spanned for
        self.column = 0
        self.captions: list[list[str]] = []

    def row(self) -> None:
        self.rows.append({})
        self.column = 0
        self.taken = {c: k - 1 for c, k in self.taken.items() if k > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        self.rows[-1][self.column] = lines
        if down > 1:
            self.taken.update((c, down) for c in range(self.column, self.column + across))
        self.column += across

    def lines(self) -> list[str]:
        used = sorted({c for r in self.rows for c, x in r.items() if x})
        width = {c: min(MAX_PAD, max(len(s) for r in self.rows for s in r.get(c, ()))) for c in used}
        out = [s for c in self.captions for s in c]
        for r in self.rows:
            for k in range(max((len(x) for x in r.values()), default=0)):
                cells = [(r.get(c) or [])[k:k + 1] or [""] for c in used]
                out.append("  ".join(x[0].ljust(width[c]) for x, c in zip(cells, used, strict=True)).rstrip())
        return out


def _number(s: str | None, default: int, most: int = 1 << 30) -> int:
    return min(int(s), most) if s and len(s) < 12 and s.lstrip("-").isdecimal() and s.isascii() else default


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, grids, lists = [Flow()], [], []
    # (node, or what to do when it ends; visible; preformatted)
    todo: list[tuple] = [(c, True, False) for c in reversed(root.children)]
    while todo:
        node, seen, pre = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen:
                flow.exact(node) if pre else flow.text(node)
            continue
        if not isinstance(node, Node):
            node()
            continue
        tag, attrs = node.tag, node.attrs
        if tag in UNSEEN:
            continue
        if attrs:
            style = attrs.get("style", "")
            if "hidden" in attrs or (style and _DISPLAY_NONE.search(style)) or (
                    tag == "dialog" and "open" not in attrs):
                continue
            m = _VISIBILITY.search(style) if style else None
            if m:
                seen = m[1].lower() not in ("hidden", "collapse")
        elif tag == "dialog":
            continue
        children = node.children
        if tag == "br":
            flow.feed()
            continue
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            children = _chosen(node)
        feeds = 2 if tag in SPACED else 1 if tag in BLOCKS else 0
        if tag in ("ul", "ol", "menu", "dir") and lists:
            feeds = 1  # a nested list stays with its item
        after = None
        if tag in ("td", "th", "caption") and grids:
            flows.append(Flow())
            held = lists[:]
            lists.clear()

            def after(tag=tag, attrs=attrs, held=held):
                lines = flows.pop().done()
                if tag == "caption":
                    grids[-1].captions.append(lines)
                else:
                    grids[-1].cell(lines, max(1, _number(attrs.get("colspan"), 1, 1000)),
                                   max(1, _number(attrs.get("rowspan"), 1, 65_534)))
                lists[:] = held
        elif tag == "tr" and grids:
            grids[-1].row()
        elif tag == "table":
            flow.block(feeds)
            grids.append(Grid())

            def after(flow=flow):
                flow.block(2)
                flow.whole(grids.pop().lines())
                flow.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.block(feeds)
            lists.append([tag, _number(attrs.get("start"), 1)])

            def after(flow=flow, feeds=feeds):
                lists.pop()
                flow.block(feeds)
        elif tag == "li":
            flow.block(1)
            kind = lists[-1] if lists else ["ul", 1]
            if kind[0] == "ol":
                kind[1] = _number(attrs.get("value"), kind[1])
                mark = f"{kind[1]}. "
                kind[1] += 1
            else:
                mark = "- "
            flow.indents.append(" " * len(mark))
            flow.marker = mark

            def after(flow=flow):
                flow.indents.pop()
                flow.marker = None
                flow.block(1)
        elif tag == "hr":
            flow.block(2)
            continue
        elif feeds:
            flow.block(feeds)

            def after(flow=flow, feeds=feeds):
                flow.block(feeds)
        if after:
            todo.append((after, True, False))
        pre = pre or tag in ("pre", "textarea", "xmp", "listing")
        if pre and tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0][:1] == "\n":
            children = [children[0][1:], *children[1:]]
        todo.extend((c, seen, pre) for c in reversed(children))
    return "\n".join(flows[0].done())


def _chosen(select: Node) -> list:
    """The options of a select that show: the chosen ones, or else the first."""
    options, todo = [], list(reversed(select.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Node):
            if c.tag == "option":
                options.append(c)
            else:
                todo.extend(reversed(c.children))
    return [o for o in options if "selected" in o.attrs] or ([] if "multiple" in select.attrs else options[:1])


def text_of(page: str) -> str:
    return render(build(page.replace("\x00", "")))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every page."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(it):
        for batch in it:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield page_id, text_of(page.as_py() or "")

    return map_rows(rows, run, [("page_id", pa.int64(), "long"), ("text", pa.string(), "string")], size=1000)
