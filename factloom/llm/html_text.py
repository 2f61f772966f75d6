"""Layout-aware rendering of HTML: a tree builder with implied tags, then a text renderer.

The builder closes what HTML closes by itself (p, li, dt/dd, option, table parts), drops unmatched
end tags and never fails on malformed input. The renderer emits all visible text: blocks get
their own lines, paragraphs and headings a blank line, list items a marker and indentation,
table rows aligned cells; ``pre`` keeps its white space. Hidden are head matter, scripts, styles,
templates, the ``hidden`` attribute, ``display:none``, closed dialogs, the body of closed details, options
not shown and what stands for embedded media (alt texts, fallbacks of iframe, audio, video, canvas).
``visibility`` is inherited, so what is made visible again inside a hidden part is shown.
Shown are the chosen options of a select, the values of inputs, svg labels and object fallbacks.
A column is padded to its longest cell; cells so long that this would take PADDING times the column's text stand out
of it, and the others stay aligned. Both parts take time in proportion to the page and its tables' padding, run without recursion over
depth, and render inner tables before outer ones; lines are indented by ``DEEPEST`` levels at most.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.shared import spread

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|[^<]+|<", re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_STOP = re.compile(r">|=\s*+[\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_GAP = re.compile(r"[ \t\n\r\f]+")
#: The value of a property in a style attribute; the last one counts.
_DISPLAY, _VISIBILITY = (re.compile(rf"(?:^|;)\s*{name}\s*:\s*([a-z-]+)", re.I) for name in ("display", "visibility"))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in "script style textarea title xmp iframe noembed noframes".split()}
UNSEEN = frozenset("head script style template title meta link noembed noframes iframe audio video canvas datalist area base param source track".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre figure form".split())
#: inputs whose value is not shown as text; parts of svg that are not drawn themselves; elements that end an svg left open
MUTE = frozenset("hidden password checkbox radio file color range image".split())
UNDRAWN = frozenset("defs symbol desc metadata title style script clippath mask pattern marker filter lineargradient radialgradient".split())
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_HTML_IN_SVG = ("foreignobject", "desc", "title")
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
#: start tag -> (open elements it closes, elements that bound the search)
_LISTS, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
IMPLIED: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), _LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLE), "th": (frozenset(["td", "th"]), _TABLE), "tr": (frozenset(["td", "th", "tr", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), _TABLE), "thead": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), _TABLE),
    "tfoot": (frozenset("td th tr tbody thead tfoot caption colgroup".split()), _TABLE),
}
_CLOSES_P = (BLOCK | {"hr"}) - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "body", "legend"}
_P = frozenset(["p"])
_P_BOUND = frozenset("table td th caption button object template".split())
_CELL_BOUND = ("td", "th", "table")
_ENDS_CELLS = frozenset("table tr tbody thead tfoot td th html body".split())
#: Padding of a column's cells may take so many times its text, and its share of PADDING_FREE characters.
PADDING, PADDING_FREE = 8, 1 << 16
#: Levels of lists and quotes that are indented.
DEEPEST = 40
#: Most columns and rows of one cell, as HTML has them.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "children", "text", "dim")

    def __init__(self, tag: str, attrs: str = ""):
        # text: of a table, once it is rendered; dim: its own text is not visible
        self.tag, self.attrs, self.children, self.text, self.dim = tag, attrs, [], "", False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


class _Open:
    """The open elements, and where in their stack those of each tag stand, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Close the element at i and all inside it."""
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Position of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: frozenset, bound: frozenset) -> None:
        """Close from the outermost open element of tags that bound does not shield."""
        shield = self.last(bound)
        first = []
        for t in tags:
            places = self.at.get(t)
            if places and places[-1] > shield:
                first.append(places[bisect_right(places, shield)])
        if first:
            self.cut(min(first))


class _Ends:
    """Ends of tags: the first ``>`` outside quoted values. Linear over a page: what was searched in vain is kept."""

    def __init__(self, html: str):
        self.html = html
        self.at, self.stop, self.last = 0, -1, -1  # the first stop from ``at`` on (the length of the page if there is none), its last character
        self.dead: set[int] = set()  # opening quotes from which no end was found

    def after(self, at: int) -> int:
        """The position behind the tag that starts here, 0 if it never ends."""
        html, opened = self.html, []
        while True:
            if not self.at <= at <= self.stop:
                m = _STOP.search(html, at)
                self.at, self.stop, self.last = at, *((m.start(), m.end() - 1) if m else (len(html), len(html)))
            i = self.last
            if i == len(html) or i in self.dead:
                break
            if html[i] == ">":
                return i + 1
            opened.append(i)
            at = html.find(html[i], i + 1) + 1
            if not at:
                break
        self.dead.update(opened)
        return 0


def parse(html: str) -> Node:
    """The element tree; every byte of text is somewhere in it."""
    root = Node("#root")
    now, at, n = _Open(root), 0, len(html)
    stack, places = now.stack, now.at
    ends = _Ends(html)
    while at < n:
        end = ends.after(at) if _TAG.match(html, at) else 0
        end = end or _TOKEN.match(html, at).end()
        token, at = html[at:end], end
        if token[0] != "<" or token == "<":
            stack[-1].children.append(token)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                stack[-1].children.append(token[9:-3].replace("&", "&amp;"))
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if name == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif places.get(name) and (name in _ENDS_CELLS or places[name][-1] > now.last(_CELL_BOUND)):
                now.cut(places[name][-1])
            continue
        if len(stack) > 1 and stack[-1].tag == "head" and name not in HEAD_ONLY:
            now.cut(len(stack) - 1)
        if name in _BREAKS and places.get("svg") and not any(places.get(x) for x in _HTML_IN_SVG):
            now.cut(places["svg"][0])
        if name in _CLOSES_P and places.get("p"):
            now.close(_P, _P_BOUND)
        if rule := IMPLIED.get(name):
            now.close(*rule)
        node = Node(name, token[len(name) + 1 : -1])
        stack[-1].children.append(node)
        if token.endswith("/>") and (name == "svg" or places.get("svg")) and not places.get("foreignobject"):
            continue
        if name in RAW:
            end = RAW[name].search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID:
            now.push(node)
    return root


def _styled(style: str, which: re.Pattern) -> str:
    found = which.findall(style)
    return found[-1].lower() if found else ""


def hidden(node: Node) -> bool:
    if node.tag in UNSEEN:
        return True
    a = node.attrs
    if not a or a.isspace():
        return node.tag == "dialog"
    low = a.lower()
    if "hidden" in low or "display" in low or node.tag == "dialog":
        found = _attributes(a)
        if "hidden" in found or _styled(found.get("style", ""), _DISPLAY) == "none":
            return True
        return node.tag == "dialog" and "open" not in found
    return False


def _shade(root: Node) -> list[Node]:
    """Settle what is visible: sets ``dim``, takes the body out of closed details. Returns the tables, outer ones first."""
    tables, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag == "table":
            tables.append(x)
        if x.tag == "details" and "open" not in _attributes(x.attrs):
            x.children = [c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1]
        for c in x.children:
            if isinstance(c, Node):
                c.dim = x.dim
                if "visib" in c.attrs.lower() and (seen := _styled(_attributes(c.attrs).get("style", ""), _VISIBILITY)) in ("visible", "hidden", "collapse"):
                    c.dim = seen != "visible"
                stack.append(c)
    return tables


class _Lines:
    """Text under construction: collapsed white space, block breaks, list indentation."""

    def __init__(self):
        self.out: list[str] = []  # finished lines
        self.now: list[str] = []
        self.space = False  # a collapsed gap is due
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if "&" in s:
            s = unescape(s)
        if pre:
            for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(force=True)
                if line:
                    self.now.append(line)
            return
        words = _GAP.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or (bool(words) and bool(self.now))
            return
        if words[0] == " ":
            self.space, words = bool(self.now), words[1:]
        if self.space and self.now:
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words[:-1] if self.space else words)

    def apart(self, texts: list[str]) -> None:
        """Plain texts, a gap around each."""
        for s in texts:
            if s.strip():
                self.space = bool(self.now)
                self.text(s.replace("&", "&amp;"), False)
                self.space = True

    def end(self, force: bool = False) -> None:
        if self.now or force or self.marker:
            lead = "".join(self.indent[:DEEPEST])
            if self.marker:
                lead, self.marker = "".join(self.indent[:-1][:DEEPEST]) + self.marker, ""
            line = (lead + "".join(self.now)).rstrip()
            self.out.append(line)
        self.now, self.space = [], False

    def gap(self) -> None:
        self.end() if self.now else None
        if self.out and self.out[-1] and not self.marker:
            self.out.append("")


def render(root: Node) -> str:
    """All visible text of the tree."""
    tables = _shade(root)
    for x in reversed(tables):  # a table comes after the tables around it
        x.text = _table(x)
    return _render(root)


def _render(root: Node) -> str:
    """The text of a tree whose inner tables are rendered."""
    lines = _Lines()
    pre = 0
    lists: list[list] = []
    stack: list[tuple] = [(0, root)]
    while stack:
        kind, x = stack.pop()
        if kind == 0:
            if isinstance(x, str):
                lines.text(x, pre > 0)
                continue
            tag = x.tag
            if hidden(x):
                continue
            if tag == "br":
                lines.end(force=True)
                continue
            if tag == "img":
                continue
            if x.dim and tag in ("input", "select"):
                continue
            if tag == "input":
                a = _attributes(x.attrs)
                if a.get("type", "").strip().lower() not in MUTE:
                    lines.apart([a.get("value", "")])
                continue
            if tag == "select":
                lines.apart(_chosen(x))
                continue
            if tag == "svg":
                stack.append((2, x))
                stack += [(0, c) for c in reversed(_drawn(x))]
                continue
            if tag == "table":
                lines.end()
                lines.gap()
                for line in x.text.split("\n"):
                    if line:
                        lines.now.append(line)
                        lines.end()
                lines.gap()
                continue
            if tag in SPACED and not (tag in _LISTS and lists):
                lines.gap()
            elif tag in BLOCK:
                lines.end() if lines.now else None
            if tag in _LISTS:
                lists.append([tag == "ol", _number(x, "start") if tag == "ol" else 1])
            elif tag == "li":
                own = lists[-1] if lists else [False, 1]
                if own[0]:
                    own[1] = _number(x, "value", own[1])
                marker = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
                if lines.marker:
                    lines.end()
                lines.marker = "" if x.dim else marker
                lines.indent.append(" " * len(marker))
            elif tag in ("dd", "blockquote"):
                lines.indent.append("  ")
            elif tag in ("pre", "listing", "plaintext"):
                pre += 1
            elif tag in ("td", "th"):
                lines.space = bool(lines.now)
            elif tag == "text":
                lines.space = bool(lines.now)
            stack.append((1, x))
            stack += [(0, c) for c in reversed(x.children) if not (x.dim and isinstance(c, str))]
        elif kind == 2:
            lines.space = bool(lines.now)
        else:
            tag = x.tag
            if tag in BLOCK:
                lines.end() if lines.now else None
            if tag in _LISTS:
                lists.pop()
            elif tag == "li":
                if lines.marker:
                    lines.end()
                lines.indent.pop()
            elif tag in ("dd", "blockquote"):
                lines.indent.pop()
            elif tag in ("pre", "listing", "plaintext"):
                pre -= 1
            if tag in SPACED and not (tag in _LISTS and lists):
                lines.gap()
    lines.end()
    while lines.out and not lines.out[-1]:
        lines.out.pop()
    return "\n".join(lines.out)


def _number(node: Node, name: str, default: int = 1) -> int:
    """A whole number in an attribute, as HTML reads it."""
    if name not in node.attrs.lower():
        return default
    m = re.match(r"\s*([+-]?\d{1,9})", _attributes(node.attrs).get(name, ""))
    return int(m[1]) if m else default


def _inner(node: Node) -> str:
    """The text under a node, character references resolved."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(unescape(x))
        elif x is node or not hidden(x):
            stack += reversed(x.children)
    return _GAP.sub(" ", "".join(out)).strip()


def _chosen(select: Node) -> list[str]:
    """Labels that a select shows: all of a list box, else the last selected option or the first one that can be."""
    a = _attributes(select.attrs)
    size = a.get("size", "").strip()
    box = "multiple" in a or (size.isdecimal() and int(size[:9]) > 1)
    shown: list[str] = []
    pick, first = None, None
    stack = [(c, False) for c in reversed(select.children)]
    while stack:
        x, off = stack.pop()
        if isinstance(x, str) or hidden(x):
            continue
        a = _attributes(x.attrs)
        if x.tag == "option":
            label = a.get("label") or _inner(x)
            shown.append(label)
            pick = label if "selected" in a else pick
            first = label if first is None and not off and "disabled" not in a else first
            continue
        if x.tag == "optgroup":
            off = off or "disabled" in a
            shown.append(a.get("label", ""))
        stack += [(c, off) for c in reversed(x.children)]
    return shown if box else [pick if pick is not None else first or ""]


def _drawn(svg: Node) -> list[Node]:
    """The labels (text) and embedded HTML of an svg, without those under parts that are not drawn."""
    out, stack = [], list(reversed(svg.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.tag in UNDRAWN or hidden(x):
            continue  # what is dim may hold visible parts
        if x.tag in ("text", "foreignobject"):
            out.append(x)
        else:
            stack += reversed(x.children)
    return out


def _rows(table: Node) -> tuple[list[Node], list[list[Node]]]:
    captions, rows, stack = [], [], list(reversed(table.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x.strip() and not table.dim:
                rows.append([_wrap(x)])
        elif x.tag == "caption":
            captions.append(x)
        elif x.tag == "tr":
            if not hidden(x):
                cells = [c if isinstance(c, Node) else _wrap(c) for c in x.children if isinstance(c, Node) or c.strip() and not x.dim]
                rows.append([c for c in cells if not hidden(c)])
        elif x.tag in ("thead", "tbody", "tfoot"):
            if not hidden(x):
                stack += reversed(x.children)
        elif x.tag not in ("colgroup", "col") and not hidden(x):
            rows.append([x])
    return captions, rows


def _wrap(text: str) -> Node:
    cell = Node("td")
    cell.children.append(text)
    return cell


def _inside(node: Node) -> str:
    box = Node("#cell")
    own = node.tag in ("td", "th", "caption")
    box.children, box.dim = (node.children, node.dim) if own else ([node], False)
    return _render(box)


def _span(cell: Node, name: str, most: int) -> int:
    """colspan or rowspan: 1 unless a whole number stands there; 0 means to the end, which only rows know."""
    if name not in cell.attrs.lower():
        return 1
    m = re.match(r"\s*\+?(\d+)", _attributes(cell.attrs).get(name, ""))
    n = int(m[1][:9]) if m else 1
    return min(n, most) if n else most if name == "rowspan" else 1


def _table(table: Node) -> str:
    """Rows with cells padded to their columns; a cell's own lines are joined by spaces, a cell over several rows stands in the first."""
    captions, rows = _rows(table)
    grid: list[list[str]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in rows:
        line: list[str] = []
        below: dict[int, int] = {}
        for cell in row:
            while taken.get(len(line), 0):
                line.append("")
            text = " ".join(s.strip() for s in _inside(cell).split("\n") if s.strip())
            wide, high = _span(cell, "colspan", MOST_COLUMNS), _span(cell, "rowspan", MOST_ROWS)
            if high > 1:
                below |= dict.fromkeys(range(len(line), len(line) + wide), high)
            line += [text] + [""] * (wide - 1)
        taken = {c: n - 1 for c, n in (taken | below).items() if n > 1}
        if any(line):
            grid.append(line)
    columns: dict[int, list[int]] = {}
    for line in grid:
        for i, s in enumerate(line[:-1]):
            columns.setdefault(i, []).append(len(s))
    width = {}
    for i, sizes in columns.items():
        room = (PADDING * (sum(sizes) + 3 * len(sizes)) + PADDING_FREE // len(columns)) // len(sizes)
        width[i] = max((n for n in sizes if n <= room), default=0)
    out = [_inside(c) for c in captions if not hidden(c)]
    out += [" | ".join(s.ljust(width.get(i, 0)) if i < len(line) - 1 else s for i, s in enumerate(line)).rstrip() for line in grid]
    return "\n".join(x for x in out if x)


def html_to_text(html: str | None) -> str:
    """Visible text of one page; null and empty give an empty string."""
    return render(parse(html)) if html else ""


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = [html_to_text(x.as_py()) for x in part.column(1)]
            yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) per row. Null or empty html gives an empty text; repeated rows give repeated results, a null id keeps its row.

    A page is handled whole, whatever its length; other columns, also one named ``text``, don't matter. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return spread(rows).mapInArrow(_extract, "id long, text string").withColumnRenamed("id", id_col)
