"""Layout-aware rendering of HTML as text.

A tree builder reads tags with their implied ends (a paragraph ends where a block begins, an item where the next begins, cells and rows
likewise), raw text elements, and broken or cut markup. A renderer then lays out every visible text: blocks stand apart by blank lines as
their margins say, list items have bullets or numbers and indentation, table cells are aligned in columns, preformatted text keeps its
spaces, and whatever a reader would not see (scripts, styles, hidden elements, the head) is left out.

Each page is rendered where it is read; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements nested deeper are children of the element at this depth, as in browsers. No text is lost.
DEPTH = 512
#: Calls that a level of the tree takes at most.
CALLS = 6
#: Cells are padded to at most this width; wider ones push the rest of their own row only. A line of a row is padded by four such widths and so many times its
#: own text at most; what would need more follows two spaces behind. No text is lost.
CELL, PADDING = 80, 16
#: Fixed value of the HTML standard: the most columns of a cell; rows are held to the same.
SPAN = 1000

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes object datalist meta link base area param source track audio video canvas".split())
#: Parts of drawings and formulas that are described or kept for reuse, not shown.
UNDRAWN = frozenset("defs symbol metadata desc clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup p pre search section summary table ul legend tr td th thead tbody tfoot caption".split())
#: Blocks that have a blank line before and after.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre figure table hr fieldset".split())
#: What ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An element's start ends these, up to the element that bounds them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""", re.S)
_DECLARATION = re.compile(r"""(?:[^;"']|"[^"]*"|'[^']*')+""")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children", "shown", "gone", "_values")

    def __init__(self, name: str, attributes: str = "", parent: Node | None = None):
        self.name, self.attributes, self.children, self._values = name, attributes, [], None
        #: Whether its own texts are visible, and whether it is left out with all that is in it.
        self.shown, self.gone = parent.shown if parent else True, False
        if attributes:
            style = self.style()
            self.gone = "hidden" in self.values() or style.get("display") == "none"
            self.shown = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), self.shown)

    def values(self) -> dict[str, str]:
        """Attributes by name; of a repeated name the first counts."""
        if self._values is None:
            self._values = {}
            for m in _ATTRIBUTE.finditer(self.attributes):
                self._values.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
        return self._values

    def attribute(self, name: str) -> str | None:
        return self.values().get(name) if self.attributes else None

    def style(self) -> dict[str, str]:
        """The declarations of the element's own style; the last of a name counts, important ones before others."""
        text = self.attribute("style")
        if not text:
            return {}
        last: dict[str, tuple[bool, str]] = {}
        for declaration in _DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", " ", text, flags=re.S)):
            name, _, value = declaration.partition(":")
            name, value = name.strip().lower(), " ".join(value.lower().split())
            force = value.replace(" ", "").endswith("!important")
            if value and (force or not last.get(name, (False, ""))[0]):
                last[name] = force, value.split("!")[0].strip()
        return {k: v for k, (_, v) in last.items()}


def parse(source: str) -> Node:
    """The tree of a page: nodes, and texts as strings."""
    root = Node("#root")
    stack = [root]
    at, size = 0, len(source)

    def close(names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in bounds:
                return
            if stack[i].name in names:
                del stack[i:]
                return close(names, bounds)

    while at < size:
        m = _TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at:
            stack[-1].children.append(html.unescape(source[at:stop]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not any(n.name == "p" for n in stack):
                stack[-1].children.append(Node("p", "", stack[-1]))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if name not in BLOCKS and stack[i].name in ("td", "th", "table"):
                    break  # a stray inline end does not leave its cell
            continue
        if name in ENDS_P:
            close({"p"}, {"td", "th", "li", "button", "table", "caption"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        node = Node(name, m[3], stack[-1])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else size])
            at = source.find(">", end.end()) + 1 if end else size
            at = at or size
        elif name not in VOID and not (m[3].endswith("/") and name not in BLOCKS) and len(stack) <= DEPTH:
            stack.append(node)
    return root


class Flow:
    """Lines of a block while they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.gap = 0

    def flush(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip(" ")
            self.text = []
            if line:
                self.add([line], 0)

    def add(self, lines: list[str], margin: int) -> None:
        """Lines of a block; margins of neighbours overlap."""
        if lines:
            if self.lines:
                self.lines += [""] * max(self.gap, margin)
            self.lines += lines
            self.gap = margin


def seen(node: Node) -> bool:
    return node.name not in UNSEEN and node.name not in UNDRAWN and not node.gone and not (node.name == "dialog" and node.attribute("open") is None)


def chosen(node: Node) -> list[Node]:
    """The options that a list shows: the last selected one, or else the first; all of them where it is a box of several rows."""
    found: list[Node] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node) and seen(c):
                if c.name == "option":
                    found.append(c)
                walk(c)

    walk(node)
    rows = node.attribute("size") or ""
    if node.attribute("multiple") is not None or (re.fullmatch(r"\d{1,6}", rows) and int(rows) > 1):
        return found
    # a disabled option is shown only if it is selected or nothing else is there
    picked = [c for c in found if c.attribute("selected") is not None]
    return picked[-1:] or ([c for c in found if c.attribute("disabled") is None] or found)[:1]


def _label(option: Node) -> str:
    return option.attribute("label") or "".join(_texts(option, []))


def _whole(text: str | None) -> int | None:
    return int(text) if re.fullmatch(r"\s*[+-]?\d{1,9}\s*", text or "") else None


def lay_out(node: Node, flow: Flow, nested: bool = False) -> Flow:
    step, number = 1, 1
    if node.name == "ol":
        number = 1
        if node.attribute("reversed") is not None:
            step, number = -1, sum(isinstance(c, Node) and c.name == "li" for c in node.children)
        start = _whole(node.attribute("start"))
        number = number if start is None else start
    for c in node.children:
        if isinstance(c, str):
            if node.shown:
                flow.text.append(c)
            continue
        if not seen(c):
            continue
        if c.name == "br":
            had = bool("".join(flow.text).strip())
            flow.flush()
            if not had and flow.lines and not flow.gap:
                flow.lines.append("")
        elif c.name == "hr":
            flow.flush()
            flow.add(["---"] if c.shown else [], 1)
        elif c.name == "img":
            if (alt := c.attribute("alt")) and c.shown:
                flow.text.append(f" {alt} ")
        elif c.name == "input":
            if c.shown and (c.attribute("type") or "text").lower() not in ("hidden", "password", "checkbox", "radio", "file", "image") and (value := c.attribute("value")):
                flow.text.append(f" {value} ")
        elif c.name == "select":
            for option in chosen(c):
                flow.text.append(f" {_label(option)} " if option.shown else "")
        elif c.name == "svg":
            for text in _drawn(c, []):
                flow.text.append(f" {text} ")
        elif c.name == "pre":
            flow.flush()
            flow.add(_preformatted(c), 1)
        elif c.name == "textarea":
            flow.flush()
            flow.add([x for x in html.unescape("".join(c.children)).split("\n") if x.strip() and c.shown], 0)
        elif c.name == "table":
            flow.flush()
            flow.add(_table(c), 1)
        elif c.name == "li":
            flow.flush()
            value = _whole(c.attribute("value"))
            number = number if value is None else value
            mark = f"{number}. " if node.name == "ol" else "* "
            number += step
            lines = lay_out(c, Flow(), True)
            lines.flush()
            flow.add([(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines.lines)], 0)
        elif c.name in BLOCKS:
            flow.flush()
            inner = lay_out(c, Flow(), nested)
            inner.flush()
            lines = inner.lines
            if c.name in ("blockquote", "dd"):
                lines = ["    " + x if x else x for x in lines]
            flow.add(lines, 0 if nested and c.name in ("ul", "ol") else int(c.name in APART))
        else:
            quoted = c.name == "q" and c.shown
            if quoted:
                flow.text.append('"')
            lay_out(c, flow, nested)
            if quoted:
                flow.text.append('"')
    return flow


def _drawn(node: Node, out: list[str]) -> list[str]:
    """The texts of a drawing; anything else between its elements is not shown."""
    for c in node.children:
        if isinstance(c, Node) and seen(c):
            if c.name == "text":
                out.append("".join(_texts(c, [])))
            elif c.name == "foreignobject":
                inner = lay_out(c, Flow())
                inner.flush()
                out.append(" ".join(inner.lines))
            else:
                _drawn(c, out)
    return out


def _texts(node: Node, out: list[str]) -> list[str]:
    for c in node.children:
        if isinstance(c, str):
            out.append(c if node.shown else "")
        elif c.name == "br":
            out.append("\n")
        elif c.name == "select":
            out += [f" {_label(o)} " for o in chosen(c) if o.shown] if seen(c) else []
        elif c.name == "svg":
            out += [f" {x} " for x in _drawn(c, [])] if seen(c) else []
        elif seen(c):
            _texts(c, out)
    return out


def _preformatted(node: Node) -> list[str]:
    lines = [x.rstrip() for x in "".join(_texts(node, [])).expandtabs(8).replace("\r\n", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _rows(node: Node, out: list[Node], captions: list[Node]) -> None:
    for c in node.children:
        if isinstance(c, Node) and seen(c):
            if c.name == "tr":
                out.append(c)
            elif c.name == "caption":
                captions.append(c)
            elif c.name in ("thead", "tbody", "tfoot"):
                _rows(c, out, captions)
            elif c.name not in ("col", "colgroup"):
                stray = Node("tr", "", node)
                stray.children = [c if c.name in ("td", "th") else _wrapped(c, node)]
                out.append(stray)
        elif isinstance(c, str) and c.strip():
            stray = Node("tr", "", node)
            stray.children = [_wrapped(c, node)]
            out.append(stray)


def _wrapped(child, parent: Node) -> Node:
    cell = Node("td", "", parent)
    cell.children = [child]
    return cell


def _span(cell: Node, name: str) -> int:
    value = cell.attribute(name) or "1"
    return min(max(int(value), 1), SPAN) if re.fullmatch(r"\d{1,6}", value) else 1


def _table(node: Node) -> list[str]:
    rows: list[Node] = []
    captions: list[Node] = []
    _rows(node, rows, captions)
    grid: list[dict[int, list[str]]] = []
    widths: dict[int, int] = {}
    taken: list[tuple[int, int, int]] = []  # stretches of columns (from, to) that cells from above hold before a row
    for number, row in enumerate(rows):
        cells: dict[int, list[str]] = {}
        column = at = 0
        taken = [t for t in taken if t[2] > number]
        held: list[tuple[int, int, int]] = []
        for c in row.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                c = _wrapped(c, row)
            elif not seen(c):
                continue
            elif c.name not in ("td", "th"):
                c = _wrapped(c, row)
            while at < len(taken) and taken[at][0] <= column:
                column, at = max(column, taken[at][1]), at + 1
            inner = lay_out(c, Flow())
            inner.flush()
            cells[column] = inner.lines
            across, down = _span(c, "colspan"), _span(c, "rowspan")
            if across == 1:
                widths[column] = min(CELL, max([widths.get(column, 0), *map(len, inner.lines)]))
            if down > 1:
                held.append((column, column + across, number + down))
            column += across
        if held:
            joined: list[tuple[int, int, int]] = []
            for t in sorted(taken + held):
                if joined and joined[-1][1] >= t[0] and joined[-1][2] == t[2]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], t[1]), t[2])
                else:
                    joined.append(t)
            taken = joined
        grid.append(cells)
    lines = []
    for c in captions:
        inner = lay_out(c, Flow())
        inner.flush()
        lines += inner.lines
    places, place = {}, 0
    for k in sorted({*widths, *(k for cells in grid for k in cells)}):
        places[k] = place
        place += widths[k] + 2 if widths.get(k) else 0
    for cells in grid:
        order = sorted(cells)
        for i in range(max(map(len, cells.values()), default=0)):
            mine = [(places[k], cells[k][i]) for k in order if i < len(cells[k]) and cells[k][i]]
            text, room = [], 4 * CELL + PADDING * sum(len(x) for _, x in mine)
            size = 0
            for where, x in mine:
                gap = max(where - size, 0)
                gap = 0 if gap > room else gap
                room -= gap
                if text and not gap and not text[-1].endswith("  "):
                    gap = 2
                text += [" " * gap, x]
                size += gap + len(x)
            lines.append("".join(text).rstrip())
    return lines


def render(source: str | None) -> str:
    """The visible text of a page; empty for null or empty pages. Blank lines are never doubled at the ends, and no line ends in spaces."""
    if sys.getrecursionlimit() < DEPTH * CALLS:
        sys.setrecursionlimit(DEPTH * CALLS)
    flow = lay_out(parse((source or "").replace("\x00", "")), Flow())
    flow.flush()
    return "\n".join(x.rstrip() for x in flow.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col``, ``text`` for every row; null and repeated ids stay as they are, an empty table gives an empty result, other columns are ignored. Pages
    of any length are rendered whole."""
    return common.computed(pages, id_col, html_col, lambda sources: {"text": list(map(render, sources))}, {"text": "string"})


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    found = extract(common.table(spark, sf_dir, "pages", "page_id", "html"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
