"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that knows void elements, raw-text elements, comments and implied
tags (a new paragraph, list item, row or cell closes the open one; a block closes an open
paragraph; what may not stand in an open head closes it; a tag of HTML closes open SVG or MathML).
Subtrees that are not rendered are dropped: head matter, scripts, styles, templates, closed dialogs, all but the
summary of closed details, ``hidden`` and ``display:none`` elements, ``input type=hidden``, annotations
of MathML, and of SVG all but ``text`` and ``foreignObject`` (what ``use`` refers to is not copied).
Text below ``visibility:hidden`` isn't shown, but what is ``visible`` again within it is. The rest is laid out as text: inline runs collapse their white space, blocks stand on lines of their own with a
blank line around paragraphs, headings, lists and tables, list items get bullets or numbers and
indentation, ``pre`` keeps the spacing of all text below it, ``br`` breaks, and the cells of a table are padded to the
width of their columns, of which a cell may span several, as it may rows.

Defined results: null or empty markup renders as the empty text; markup without tags is its collapsed
text; unclosed and stray tags are repaired as above and never fail; a tag that the markup ends within is
text. Building and layout walk explicit stacks, in time that grows with the markup, at any depth. Beyond
``DEEPEST`` open lists, quotations and tables items keep their marks and rows their cells, while indentation
and the padding of columns stop: they would grow as the square of the depth. Other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape as entities

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of the HTML standard, by how they build or lay out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist param source track link meta base area".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure fieldset hr".split())
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption legend option optgroup".split())
#: What may stand in a head: any other tag, or text, closes it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style template".split())
#: Elements of SVG and MathML that aren't rendered, and those whose children are HTML again.
UNSEEN_WITHIN = {
    "svg": frozenset("defs desc title metadata symbol clippath mask pattern marker filter lineargradient radialgradient style script".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
HTML_WITHIN = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: Tags that close open SVG and MathML.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: An opening tag closes the nearest open one of the first set, unless one of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
_MARKED = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
TOKEN = re.compile(_MARKED + r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
#: What a tag's end is no part of: for what comes after the last ``>``.
LAST = re.compile(_MARKED + r"(?P<end>)(?P<name>(?!))?(?P<attrs>)", re.S)
SPAN = re.compile(r"(?:^|[\s/])(col|row)span\s*=\s*[\"']?\s*(\d{1,5})", re.I)
NOT_SHOWN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|type\s*=\s*[\"']?hidden", re.I)
VISIBILITY = re.compile(r"(?:^|[\s;\"'])visibility\s*:\s*(hidden|collapse|visible)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
STYLE = re.compile(r"\bstyle\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
START = re.compile(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", re.I)
OPEN = re.compile(r"(?:^|[\s/])open(?=[\s=/]|$)", re.I)
OFF = re.compile(r"(?:^|\s)display\s*=\s*[\"']?\s*none", re.I)
VISIBLE_SVG = re.compile(r"(?:^|\s)visibility\s*=\s*[\"']?\s*(hidden|collapse|visible)", re.I)
AS_HTML = re.compile(r"\bencoding\s*=\s*[\"']?\s*(?:text/html|application/xhtml\+xml)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 40


class Node:
    __slots__ = ("name", "attrs", "children", "space", "drawn", "visible")

    def __init__(self, name: str, attrs: str = "", space: str = "", drawn: bool = True, visible: bool = True):
        """``space``: svg, math, or none for HTML; ``drawn``: whether text directly below is; ``visible``: by the nearest rule of visibility."""
        self.name, self.attrs, self.children, self.space, self.drawn, self.visible = name, attrs, [], space, drawn, visible

    @property
    def within(self) -> str:
        """The space of the elements below."""
        if self.space and (self.name in HTML_WITHIN[self.space] or self.name == "annotation-xml" and AS_HTML.search(self.attrs)):
            return ""
        return self.space


def shown(name: str, attrs: str, space: str = "") -> bool:
    """The visibility rules for an element of its own."""
    if name in UNSEEN_WITHIN[space] or OFF.search(attrs) if space else name in UNSEEN:
        return False
    if name == "dialog" and not space and not opened(attrs):
        return False
    if not attrs or not NOT_SHOWN.search(attrs):
        return True
    bare = QUOTED.sub('""', attrs)
    if re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", bare, re.I) or name == "input" and re.search(r"type\s*=\s*[\"']?hidden", attrs, re.I):
        return False
    style = STYLE.search(attrs)
    return not (style and re.search(r"display\s*:\s*none", style[1], re.I))


def visibility(attrs: str, space: str, inherited: bool) -> bool:
    """The visibility that an element states, or else has from around it."""
    if not attrs or "visibility" not in attrs.lower():
        return inherited
    style = STYLE.search(attrs)
    stated = style and VISIBILITY.search(style[1]) or space and VISIBLE_SVG.search(attrs)
    return stated[1].lower() == "visible" if stated else inherited


def opened(attrs: str) -> bool:
    return bool(OPEN.search(QUOTED.sub('""', attrs)))


def build(markup: str) -> Node:
    """A tree of elements and strings, with implied tags closed and unseen subtrees left out."""
    root = Node("body")
    stack, unseen = [root], 0  # unseen: how deep the innermost open unseen elements reach
    places: dict[str, list[int]] = {}  # where the open elements of a name are on the stack

    def text(raw: str) -> None:
        if not raw or unseen and stack[-1].name != "head":
            return
        raw = entities(raw) if "&" in raw else raw
        if stack[-1].name == "head" and raw.strip(" \t\n\r\f"):
            pop(len(stack) - 1)
        if not unseen and stack[-1].drawn and stack[-1].visible:
            stack[-1].children.append(raw)

    def innermost(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names, barred) -> None:
        while (k := innermost(names)) > innermost(barred):
            pop(k)
            if stack[-1].name not in names:
                return

    def push(node: Node) -> None:
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def pop(k: int) -> None:
        nonlocal unseen
        for x in stack[k:]:
            places[x.name].pop()
            unseen -= x.children is None
        del stack[k:]

    at, last = 0, markup.rfind(">")
    while True:
        m = (TOKEN if at <= last else LAST).search(markup, at)
        if not m:
            text(markup[at:])
            return root
        text(markup[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"] and stack[-1].name != "head":
                text(m["cdata"])
            continue
        name = name.lower()
        if stack[-1].name == "head" and (name in ("body", "html", "br") if m["end"] else name not in IN_HEAD):
            pop(len(stack) - 1)
        if m["end"]:
            k = innermost((name,))
            if k and (name in BLOCK or k >= innermost(("table", "td", "th"))):
                pop(k)
            elif not k and name == "p" and not unseen:
                stack[-1].children.append(Node("p"))
            continue
        attrs = m["attrs"]
        if name in BREAKS_OUT and stack[-1].within:
            pop(next(k for k in range(len(stack) - 1, -1, -1) if not stack[k].within) + 1)
        above = stack[-1]
        space = name if name in ("svg", "math") else above.within
        empty = bool(space) and attrs.endswith("/")
        if space:
            pass
        elif name in IMPLIED:
            close(*IMPLIED[name])
        elif name in ENDS_P:
            close({"p"}, {"table", "td", "th", "li", "dd", "dt", "caption", "button", "object", "body", "template"})
        above = stack[-1]
        # Of SVG, text is drawn in `text` and in what is HTML again.
        drawn = space != "svg" or name in ("text", "foreignobject") or name != "svg" and above.space == "svg" and above.drawn
        if name == "details" and not space and not opened(attrs):
            drawn = False
        node = Node(name, attrs, space, drawn, visibility(attrs, space, above.visible))
        visible = shown(name, attrs, space) and (node.visible or name not in ("input", "textarea", "xmp", "plaintext"))
        if above.name == "details" and not above.space and not above.drawn:
            # Of closed details only the first summary is rendered.
            visible = visible and name == "summary" and not any(isinstance(x, Node) and x.name == "summary" for x in above.children or ())
        if above.space == "math" and above.name in ("semantics", "maction") and above.children and any(isinstance(x, Node) for x in above.children):
            visible = False  # only the first child is rendered
        if visible and not unseen:
            stack[-1].children.append(node)
        if name in RAW and not empty:
            raw_end = re.compile(rf"</{re.escape(name)}\s*+/?>", re.I).search(markup, at)
            body = markup[at : raw_end.start() if raw_end else len(markup)]
            if visible and not unseen:
                node.children.append(entities(body) if name in ("textarea", "title") else body)
            at = raw_end.end() if raw_end else len(markup)
        elif name not in VOID and not empty:
            if not visible:
                node.children = None  # marks an unseen element that is open
                unseen += 1
            push(node)


class Lines:
    """Text under layout: lines, with pending white space and pending blank lines."""

    def __init__(self):
        self.lines, self.now, self.gap, self.space = [], [], 0, False

    def inline(self, text: str) -> None:
        text = SPACE.sub(" ", text)
        body = text.strip(" ")
        if body:
            self.open()
            if self.now and (self.space or text[0] == " "):
                self.now.append(" ")
            self.now.append(body)
            self.space = text[-1] == " "
        elif text and self.now:
            self.space = True

    def exact(self, text: str) -> None:
        """Text whose white space counts."""
        self.open()
        first, *more = text.split("\n")
        self.now.append(first)
        for line in more:
            self.lines.append("".join(self.now))
            self.now = [line]

    def open(self) -> None:
        if not self.now and self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0

    def end(self, gap: int = 0) -> None:
        now = "".join(self.now)
        if now:
            self.lines.append(now)
            self.gap = 0
        self.now, self.space = [], False
        if self.lines:
            self.gap = max(self.gap, gap)

    def whole(self, lines: list[str], prefix: str = "", rest: str = "") -> None:
        """Lines laid out before, as they are, the first and the others after a prefix."""
        self.end()
        if not lines and prefix:
            lines = [""]
        for k, line in enumerate(lines):
            line = (prefix if k == 0 else rest) + line
            if k == 0 and self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(line.rstrip(" "))


def spans(attrs: str) -> tuple[int, int]:
    """How many columns and rows a cell spans, within the standard's limits; 0 rows are all that follow."""
    found = {a.lower(): int(n) for a, n in SPAN.findall(attrs)} if attrs else {}
    return min(max(found.get("col", 1), 1), 1000), min(found.get("row", 1) or 65534, 65534)


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """A table's cells, each of lines and spans, padded to the width of the columns that they stand in."""
    placed, active = [], []  # cells (first column, end, lines); cells of rows above (first column, end, end row)
    for r, row in enumerate(rows):
        active = [a for a in active if a[2] > r] if row else active
        now, more, k, at = [], [], 0, 0
        for lines, wide, high in row:
            while k < len(active) and active[k][0] <= at:
                at, k = max(at, active[k][1]), k + 1
            end = min(at + wide, active[k][0]) if k < len(active) else at + wide
            now.append((at, end, lines))
            if high > 1:
                more.append((at, end, r + high))
            at = end
        active = sorted(active + more) if more else active
        placed.append(now)
    # Columns that no cell begins or ends between are one.
    number = {x: k for k, x in enumerate(sorted({x for row in placed for a, b, _ in row for x in (a, b)} | {0}))}
    placed = [[(number[a], number[b], lines) for a, b, lines in row] for row in placed]
    wide = [0] * len(number)
    for a, b, lines in sorted((c for row in placed for c in row), key=lambda c: c[1] - c[0]):
        need = max(map(len, lines), default=0)
        if b - a == 1:
            wide[a] = max(wide[a], need)
        elif need:
            wide[b - 1] += max(0, need - sum(wide[a:b]) - 3 * (b - a - 1))
    out = []
    for row in placed:
        for k in range(max((len(c[2]) for c in row), default=0)):
            parts, at = [], 0
            for a, b, lines in row:
                parts += [" " * wide[x] for x in range(at, a)]
                room = wide[a] if b - a == 1 else sum(wide[a:b]) + 3 * (b - a - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at = b
            out.append(" | ".join(parts).rstrip(" "))
    return out


def render(markup: str | None) -> str:
    """All visible text of the markup, laid out."""
    if not markup:
        return ""
    top = Lines()
    # Frames: node, next child, the Lines that it writes to, its own data (list counter, table rows), and
    # whether it is, or is below, a pre.
    todo: list[list] = [[build(markup), 0, top, None, False]]
    nested, tables, lists = 0, [], []  # open boxes of lines; frames of open tables and lists
    while todo:
        frame = todo[-1]
        node, k, out, data, kept = frame
        if k < len(node.children):
            frame[1] += 1
            child = node.children[k]
            if isinstance(child, str):
                if node.name in ("table", "tbody", "thead", "tfoot", "tr") and not child.strip():
                    pass
                elif kept:
                    out.exact(child)
                else:
                    out.inline(child)
                continue
            name, own, extra = child.name, out, None
            if name == "br":
                if kept:
                    out.exact("\n")
                elif out.now:
                    out.end()
                else:
                    out.gap = min(out.gap + 1, 1) if out.lines else 0
                continue
            if name == "img":
                continue
            if name == "input":
                value = re.search(r"\bvalue\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", child.attrs, re.I)
                if value and re.search(r"type\s*=\s*[\"']?(?:submit|button|reset)", child.attrs, re.I):
                    out.inline(" " + entities(value[1].strip("\"'")) + " ")
                continue
            cell = name in ("td", "th") and tables and tables[-1][3]["rows"] is None
            if name in BLOCK and not cell:
                out.end(1 if name in SPACED else 0)
            if name in ("ul", "ol", "menu", "dir"):
                m = START.search(child.attrs) if name == "ol" else None
                extra = [name == "ol", int(m[1]) if m else 1]
                if node.name == "li":
                    out.gap = 0
            elif name in ("li", "table", "td", "th", "blockquote", "dd"):
                if nested < DEEPEST:
                    own, nested = Lines(), nested + 1
                    extra = {"rows": []} if name == "table" else {}
                elif name == "table":
                    extra = {"rows": None}
                elif cell:
                    if out.now:
                        out.inline(" | ")
                elif name in ("li", "dd", "blockquote"):
                    out.inline({"li": marked(lists), "dd": "    ", "blockquote": "> "}[name])
            elif name == "tr" and tables and tables[-1][3]["rows"] is not None:
                tables[-1][3]["rows"].append([])
            elif name == "pre":
                extra = {}
            elif name == "text" and child.space:
                out.inline(" ")
            todo.append([child, 0, own, extra, kept or name == "pre"])
            if name == "table":
                tables.append(todo[-1])
            elif name in ("ul", "ol", "menu", "dir"):
                lists.append(todo[-1])
            continue
        todo.pop()
        name = node.name
        if name == "table":
            tables.pop()
        elif name in ("ul", "ol", "menu", "dir") and lists and lists[-1] is frame:
            lists.pop()
        if name in ("li", "table", "td", "th", "blockquote", "dd") and isinstance(data, dict) and out is not todo[-1][2]:
            nested -= 1
            out.end()
            outer = todo[-1][2]
            if name == "li":
                mark = marked(lists)
                if out.lines or node.visible:
                    outer.whole(out.lines, mark, " " * len(mark))
            elif name == "dd":
                outer.whole(out.lines, "    ", "    ")
            elif name == "blockquote":
                outer.whole(out.lines, "> ", "> ") if out.lines else None
            elif name == "table":
                before = out.lines  # a caption, or text outside of cells
                outer.whole(before + grid(data["rows"]))
            elif tables and tables[-1][3]["rows"] is not None:
                rows = tables[-1][3]["rows"]
                if not rows:
                    rows.append([])
                rows[-1].append((out.lines, *spans(node.attrs)))
            else:
                outer.whole(out.lines)
            out = outer
        elif name == "pre" and data is not None and out.now:
            out.lines.append("".join(out.now))
            out.now = []
        elif name == "text" and node.space:
            out.inline(" ")
        if name in BLOCK and not (name in ("td", "th") and tables and tables[-1][3]["rows"] is None):
            out.end(1 if name in SPACED and not (name in ("ul", "ol") and todo and todo[-1][0].name == "li") else 0)
    top.end()
    return "\n".join(top.lines).strip("\n")


def marked(lists: list[list]) -> str:
    """The mark of the next item of the innermost open list."""
    if not lists or not lists[-1][3][0]:
        return "- "
    number, lists[-1][3][1] = lists[-1][3][1], lists[-1][3][1] + 1
    return f"{number}. "


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the visible text of each page."""

    @F.arrow_udf("string")
    def rendered(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts:
            for part in slices(batch):
                yield pa.array([render(x) for x in part.to_pylist()], pa.string())

    return pages.withColumn(out, rendered(F.col(html)))
