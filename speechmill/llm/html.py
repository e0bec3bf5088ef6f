"""HTML extraction by layout-aware rendering.

A builder follows the tags with the implied ends that HTML has (a new <li> ends the one before, a block ends a
paragraph, ...). An element is rendered when it ends, from what its children have rendered, so nesting needs no
recursion; elements nested deeper than ``DEEPEST`` stand beside each other, as in browsers. Text that is not visible
(scripts, styles, head, hidden attributes and styles) is left out; what only screen readers skip is not, nor what is
made visible again within an invisible element. Of drawings the text elements are kept, of formulas all but
annotations. Blocks stand on lines of their own, paragraphs and headings between blank lines, list items behind bullets
or numbers and indented, up to ``INDENT`` characters. A table's cells stand in columns as wide as their widest cell, and
a cell that spans columns or rows covers them; where that would take more than ``PADDING`` times what the cells hold,
cells are parted by bars only.

Defined cases: null or empty pages render as an empty text; unclosed, stray and misnested tags never fail; an empty
table of pages gives no rows, repeated rows one result each; a very long page takes time in proportion to its length and
depth (at most ``DEEPEST``), for tables to rows times the cells that reach over rows, and its text is at most a
few times the page; carried columns keep their names, and the result's name must not be among them (``fresh`` gives such).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices

#: Elements nested in each other at most, characters of indent at most, and what padding may add to a table.
DEEPEST, INDENT, PADDING = 512, 24, 4

#: Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object canvas audio video datalist noframes".split())
HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li main menu nav option optgroup search section summary tbody td tfoot th thead tr".split())

#: A start tag of the key ends open elements of these names, up to the given limits.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})), "body": ({"head"}, {"html"}),
}
_P_ENDERS = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
#: In svg and math: elements that hold HTML again, elements that show nothing, and start tags that end the drawing or formula.
_HOLDS_HTML = frozenset("foreignobject mi mo mn ms mtext".split())
_FOREIGN_UNSEEN = frozenset("desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split())
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_SCOPES = frozenset("table td th caption button object template html".split())
#: A quote opens a value after "=" only; elsewhere it is a character as others are. Nothing is tried twice.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+))?+)?+")
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+)>?)", re.S)
_HIDING = re.compile(r"hidden|style|type|start|value|span", re.I)
_UNSHOWN = re.compile(r"display\s*+:\s*+none", re.I)
_VISIBILITY = re.compile(r"visibility\s*+:\s*+(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class _Node:
    __slots__ = ("tag", "shown", "visible", "parts", "cells", "rows", "count", "pre", "foreign", "span")

    def __init__(self, tag: str, shown: bool, pre: bool, foreign: str = "", visible: bool = True):
        self.tag, self.shown, self.pre = tag, shown, pre
        self.visible = visible  # what is not shown hides all inside it; what is shown but invisible does not
        self.foreign = foreign  # "svg", "text" within a text element of it, "math", or "" for HTML
        self.parts: list = []  # str: inline text; (0, lines): a block; (1, lines): one between blank lines
        self.cells: list | None = None
        self.rows: list = []
        self.count = 1
        self.span = (1, 1)  # columns and rows of a cell


def _lines(parts: list, pre: bool = False) -> list[str]:
    """Lines of an element's content; '' stands for a blank line between spaced blocks. No list of lines is changed later."""
    solid = [p for p in parts[:4] if not isinstance(p, str) or p.strip(" \t\n\r\f")]
    if len(parts) <= 4 and len(solid) == 1 and not isinstance(solid[0], str):
        return solid[0][1]  # a block around a block: nothing to copy, however deep
    out: list[str] = []
    text: list[str] = []
    gap = False

    def flush() -> None:
        nonlocal gap
        joined = "".join(text)
        text.clear()
        rows = joined.split("\n") if pre else [_SPACE.sub(" ", x).strip(" ") for x in joined.split("\0")]
        if not pre:
            while rows and not rows[-1]:
                rows.pop()
        if not any(x.strip() for x in rows):
            return
        if gap and out:
            out.append("")
        gap = False
        out.extend(rows)

    for part in parts:
        if isinstance(part, str):
            text.append(part)
            continue
        spaced, lines = part
        flush()
        if lines:
            if out and (spaced or gap) and out[-1] != "":
                out.append("")
            out.extend(lines)
            gap = bool(spaced)
    flush()
    return out


def _indented(mark: str, lines: list[str]) -> list[str]:
    """Lines behind a mark; what is indented by ``INDENT`` already moves no further."""
    deep = " " * INDENT
    return [x if x.startswith(deep) else (mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(lines)]


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """Cells (first column, end, text) of each row; cells that reach over rows hold ranges of columns until a row."""
    placed = []
    held: list[tuple[int, int, int]] = []  # first column, end, row until which it is held; by column
    for number, row in enumerate(rows):
        held = [h for h in held if h[2] > number]
        at, k, cells, new = 0, 0, [], []
        for text, wide, tall in row:
            while k < len(held) and held[k][0] <= at:
                at = max(at, held[k][1])
                k += 1
            cells.append((at, at + wide, text))
            if tall > 1:
                new.append((at, at + wide, min(number + tall, len(rows))))
            at += wide
        if new:
            merged: list[tuple[int, int, int]] = []
            for h in sorted(held + new):
                if merged and merged[-1][1] == h[0] and merged[-1][2] == h[2]:
                    merged[-1] = (merged[-1][0], h[1], h[2])
                else:
                    merged.append(h)
            held = merged
        placed.append(cells)
    return placed


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Aligned lines of rows of cells (text, columns, rows). Columns in which no cell begins take no room."""
    placed = _placed(rows)
    starts = sorted({first for cells in placed for first, _, _ in cells})
    spans = [[(bisect_left(starts, first), bisect_left(starts, end), text) for first, end, text in cells] for cells in placed]
    widths = [0] * len(starts)
    every = sorted((x for cells in spans for x in cells), key=lambda x: x[1] - x[0])
    narrow = [x for x in every if x[1] - x[0] == 1]
    for first, _, text in narrow:
        widths[first] = max(widths[first], len(text))
    sums = [0, *accumulate(w + 3 for w in widths)]
    for first, end, text in every[len(narrow) :]:
        more = len(text) - (sums[end] - sums[first] - 3)
        if more > 0:
            widths[end - 1] += more
            sums[end:] = [x + more for x in sums[end:]]
    size = sum(sums[cells[-1][0]] + len(cells[-1][2]) for cells in spans if cells)
    if size > PADDING * sum(len(text) + 8 for cells in spans for _, _, text in cells):
        return [" | ".join(text for _, _, text in cells) for cells in spans]
    out = []
    for cells in spans:
        shown, at = [], 0
        for n, (first, end, text) in enumerate(cells):
            shown += [" " * w for w in widths[at:first]]
            shown.append(text if n == len(cells) - 1 else text.ljust(sums[end] - sums[first] - 3))
            at = end
        out.append(" | ".join(shown).rstrip())
    return out


class Renderer:
    def __init__(self):
        self.open: list[_Node] = [_Node("#", True, False)]
        self.names: Counter[str] = Counter()  # of open elements

    def text(self, raw: str) -> None:
        at = self.open[-1]
        if at.shown and at.visible or at.tag == "head":
            raw = html.unescape(raw) if "&" in raw else raw
            if at.tag == "head" and raw.strip(" \t\n\r\f\0"):
                self._close()
                at = self.open[-1]
        if at.shown and at.visible and at.foreign != "svg":
            at.parts.append(raw.replace("\0", "") if at.pre else _SPACE.sub(" ", raw.replace("\0", "")))

    def start(self, tag: str, attributes: str) -> bool:
        """Whether an element is open now for what follows."""
        while len(self.open) > DEEPEST:
            self._close()
        if self.open[-1].tag == "head" and tag not in HEAD:
            self._close()
        if tag in _BREAKS_OUT:
            while self.open[-1].foreign:
                self._close()
        foreign = self.open[-1].foreign
        if tag in ("svg", "math"):
            foreign = tag
        elif foreign and tag in _HOLDS_HTML:
            foreign = ""
        elif foreign == "svg" and tag == "text":
            foreign = tag
        if (foreign or self.open[-1].foreign) and attributes.endswith("/"):
            last = None
            for last in _ATTRIBUTE.finditer(attributes):
                pass
            if last is None or last.end() < len(attributes):  # else the slash ends an unquoted value
                return False
        if tag in _P_ENDERS:
            self._end_up_to({"p"}, _SCOPES)
        if tag in _ENDS:
            names, limits = _ENDS[tag]
            while self._end_up_to(names, limits):
                pass
        given = {}
        if attributes and _HIDING.search(attributes):
            for m in _ATTRIBUTE.finditer(attributes):
                given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        parent = self.open[-1]
        style = given.get("style", "")
        shown = parent.shown and tag not in UNSEEN and not (parent.foreign and tag in _FOREIGN_UNSEEN or "hidden" in given or _UNSHOWN.search(style) or tag == "dialog" and "open" not in attributes)
        said = _VISIBILITY.findall(style)
        visible = said[-1].lower() == "visible" if said else parent.visible
        seen = shown and visible
        if tag in VOID:
            if seen and tag == "br":
                parent.parts.append("\n" if parent.pre else "\0")
            elif seen and tag == "hr":
                parent.parts.append((0, ["---"]))
            elif seen and tag == "input" and given.get("type", "").lower() in ("submit", "button", "reset") and given.get("value"):
                parent.parts.append(f" {html.unescape(given['value'])} ")
            return False
        node = _Node(tag, shown, parent.pre or tag in ("pre", "textarea", "xmp"), foreign, visible)
        if tag == "ol":
            node.count = int(given["start"]) if re.fullmatch(r"-?\d{1,9}", given.get("start", "")) else 1
        if tag == "li" and re.fullmatch(r"-?\d{1,9}", given.get("value", "")):
            for up in reversed(self.open):
                if up.tag in ("ol", "ul"):
                    up.count = int(given["value"])
                    break
        if tag in ("td", "th"):
            wide, tall = (int(given.get(k, "1")) if re.fullmatch(r"\d{1,5}", given.get(k, "1")) else 1 for k in ("colspan", "rowspan"))
            node.span = (min(max(wide, 1), 1000), tall or 65534)
        self.open.append(node)
        self.names[tag] += 1
        return True

    def end(self, tag: str) -> None:
        if self.open[-1].tag == "head":
            if tag not in ("head", "body", "html", "br"):
                return
            self._close()
        if tag in ("p", "br") and not self.names[tag]:
            self.start(tag, "")
            if tag == "br":
                return
        self._end_up_to({tag}, {"table"} if tag not in ("table", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot") else frozenset(), always=True)

    def _end_up_to(self, names, limits, always: bool = False) -> bool:
        """Ends the innermost open element of ``names`` and all inside it, if no element of ``limits`` stands between."""
        if not any(self.names[n] for n in names):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                while len(self.open) > i:
                    self._close()
                return True
            if self.open[i].tag in limits:
                return False
        return False

    def _close(self) -> None:
        node, parent = self.open.pop(), self.open[-1]
        self.names[node.tag] -= 1
        if not node.shown:
            return
        tag = node.tag
        if tag in ("td", "th"):
            row = next((n for n in reversed(self.open) if n.tag in ("tr", "table")), None)
            if row is not None:
                if row.cells is None:
                    row.cells = []
                row.cells.append((" ".join(_SPACE.sub(" ", x).strip() for x in _lines(node.parts, node.pre) if x.strip()), *node.span))
                return
        elif tag in ("tr", "table") and (node.cells or tag == "table"):
            table = node if tag == "table" else next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None:
                loose = _lines(node.parts)
                if node.cells:
                    table.rows.append(node.cells)
                if tag == "tr":
                    if loose:
                        table.parts.append((0, loose))
                    return
                self.open[-1].parts.append((1, [*loose, *_table(table.rows)]))
                return
            node.parts.append((0, _table([node.cells])))
        elif tag == "li":
            box = next((n for n in reversed(self.open) if n.tag in ("ul", "ol", "menu", "dir")), None)
            mark = "- "
            if box is not None and box.tag == "ol":
                mark, box.count = f"{box.count}. ", box.count + 1
            lines = [x for x in _lines(node.parts, node.pre) if x.strip()]
            if lines:
                parent.parts.append((0, _indented(mark, lines)))
            return
        elif tag == "dd":
            parent.parts.append((0, _indented("  ", [x for x in _lines(node.parts, node.pre) if x.strip()])))
            return
        elif tag in ("tbody", "thead", "tfoot"):
            parent.parts.append((0, _lines(node.parts)))
            return
        if tag in BLOCK:
            nested = tag in ("ul", "ol") and self.names["li"] > 0
            lines = _lines(node.parts, node.pre)
            parent.parts.append((int(tag in SPACED and not nested), lines))
        elif tag == "text" and node.foreign:
            parent.parts.extend([" ", *node.parts, " "])
        else:
            parent.parts.extend(node.parts)

    def finish(self) -> str:
        while len(self.open) > 1:
            self._close()
        return "\n".join(_lines(self.open[0].parts))


def render(page: str | None) -> str:
    """The visible text of a page."""
    page = page or ""
    made, at = Renderer(), 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            made.text(page[at:])
            break
        if m.start() > at:
            made.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            made.end(tag)
            continue
        opened = made.start(tag, m[3])
        if opened and tag in ("pre", "textarea", "listing"):  # a newline right behind the tag is not part of the text
            at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
        if opened and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            made.text(page[at : close.start() if close else len(page)])
            at = close.start() if close else len(page)
            if not close:
                break
    return made.finish()


def extract_text(pages: DataFrame, carry: list[str], name: str = "text", source: str = "html") -> DataFrame:
    """The columns ``carry`` of every page and its visible text under ``name``."""

    def rendered(batches):
        for batch in slices(batches, 200):
            texts = [render(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*carry, name])

    given = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(source).cast("string").alias(fresh(pages, "page")))
    return given.mapInArrow(rendered, T.StructType([*given.schema.fields[:-1], T.StructField(name, T.StringType())]))
