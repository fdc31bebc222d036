"""HTML to text as it is laid out: all visible text, block spacing, lists and aligned tables.

Markup is cut into tags and text; a tree builder supplies implied end tags (paragraphs before blocks, list items,
definition terms, rows, cells, options) and ignores stray ones. Scripts, styles, templates, fallback content of
media, the document head, and elements that are ``hidden`` or styled ``display:none`` are not rendered; text
under ``visibility:hidden`` neither, unless a descendant turns it visible again.

White space collapses outside ``pre``. Paragraph-like blocks are set off by an empty line, others by a line end.
List items are marked and indented by depth; ordered lists count from ``start`` and take ``value``. Table
cells become columns padded to the widest cell, over as many lines as the highest cell of a row has; column and row
spans are honoured. Columns are parted by `` | ``. A table is set unaligned, the cells of a row parted but not padded, if its aligned text
would hold more than ``PAD`` times the characters of its cells and separators and ``FREE`` besides, or if its rows pass that many columns that cells
from above reach into: text and time stay in proportion to the page.

Nulls: a null page gives null text, an empty one an empty text. Elements nested deeper than ``DEPTH`` hide what they
hide and break lines where they would, but are not indented or aligned: an indent a level would make the text grow with the square of the depth. A page is scanned once from front to end, whatever
it holds: unclosed tags and quotes cost no second look. Very long pages are rendered whole. Repeated rows are rendered
each. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

#: Depth of the tree; what alignment may add to a table, in proportion to it and besides.
DEPTH, PAD, FREE = 200, 16, 20_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
SET_OFF = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu".split())
BLOCK = SET_OFF | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option section summary search tr thead tbody tfoot td th hr".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt li option optgroup tr thead tbody tfoot td th legend".split())
#: Start tags, the open elements they end, and the elements at which the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
_LISTS = ("ul", "ol", "menu")
_WALLS = frozenset({"table", "td", "th", "caption", "button", "html", "template", "object", "marquee"})


def _next_tag(html: str, at: int, last: int) -> re.Match | None:
    """The next tag or declaration from ``at`` on. After the last ``>`` only declarations can begin, so no tag is tried there."""
    at = html.find("<", at)
    while at >= 0:
        if (at < last or html.startswith(("<!", "<?"), at)) and (found := _TAG.match(html, at)):
            return found
        at = html.find("<", at + 1)
    return None


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def attribute(self, name: str) -> str | None:
        """None where it is absent; empty where it has no value."""
        for found in _ATTRIBUTE.finditer(self.attributes) if name in self.attributes.lower() else ():
            if found[1].lower() == name:
                return unescape(found[2] or found[3] or found[4] or "")
        return None


def parse(html: str) -> Element:
    """The element tree: children are elements and strings."""
    root = Element("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of open elements by tag, the root left out
    deep: list[tuple[str, bool]] = []  # open elements beyond DEPTH: tag, and whether they hide their content
    below: dict[str, int] = {}  # how many of them have a tag
    hiding = 0

    def push(element: Element) -> None:
        places.setdefault(element.tag, []).append(len(stack))
        stack.append(element)

    def pop() -> None:
        places[stack.pop().tag].pop()

    def nearest(tags: set[str] | frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(tag: str) -> None:
        nonlocal hiding
        while deep:
            name, hides = deep.pop()
            below[name] -= 1
            hiding -= hides
            if name in BLOCK and not hiding:
                stack[-1].children.append(Element("div"))
            if name == tag:
                break

    def close(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> bool:
        """End the nearest open element of ``tags`` that lies above every wall."""
        at = nearest(tags)
        if not at or at < nearest(walls):
            return False
        while len(stack) > at:
            pop()
        return True

    at, lower, n, last = 0, None, len(html), html.rfind(">")
    while at < n:
        found = _next_tag(html, at, last)
        text = html[at : found.start()] if found else html[at:]
        if text and not hiding:
            if stack[-1].tag == "head" and not text.isspace():
                pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            if found[0].startswith("<![CDATA[") and not hiding:
                stack[-1].children.append(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag in ("html", "body"):
                continue
            if deep:
                if below.get(tag):
                    leave(tag)
                    continue
                if hiding or not places.get(tag):
                    continue
                leave("")
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Element("p"))
            elif tag == "br":
                stack[-1].children.append(Element("br"))
            else:
                close({tag}, _WALLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                pop()
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            pop()
        element = Element(tag, found[3])
        if deep and tag not in RAW and tag not in VOID:
            hides = not _seen(element, True)[0]
            if tag in BLOCK and not hiding:
                stack[-1].children.append(Element("div"))
            deep.append((tag, hides))
            below[tag] = below.get(tag, 0) + 1
            hiding += hides
            continue
        if not deep and tag in CLOSES_P:
            close({"p"}, _WALLS)
        if not deep and tag in ENDS:
            while close(*ENDS[tag]) and tag not in ("li", "dt", "dd", "option"):
                pass
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        if not hiding:
            stack[-1].children.append(element)
        if tag in RAW:
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at)
            end = n if end < 0 else end
            content = html[at:end]
            element.children.append(unescape(content) if tag in ("textarea", "title") else content)
            after = html.find(">", end)
            at = n if after < 0 else after + 1
        elif tag not in VOID:
            if len(stack) < DEPTH:
                push(element)
            else:
                stack[-1].children[-1] = Element("div" if tag in BLOCK else "wbr")
                deep.append((tag, not _seen(element, True)[0]))
                below[tag] = below.get(tag, 0) + 1
                hiding += deep[-1][1]
    return root


class _Lines:
    """Lines of one flow, with collapsed white space and pending breaks."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False
        self.prefix = ""

    def text(self, text: str) -> None:
        parts = _SPACE.split(text)
        for i, part in enumerate(parts):
            if i:
                self.space = bool(self.line)
            if part:
                self._put(part)

    def _put(self, part: str) -> None:
        if not self.line and self.gap:
            if self.done and self.done[-1] != "":
                self.done.append("")
            self.gap = False
        if self.prefix:
            self.line.append(self.prefix)
            self.prefix = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(part.replace("\xa0", " "))

    def end(self) -> None:
        """End the line, if it holds anything."""
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def brk(self) -> None:
        """A forced line end."""
        if self.line:
            self.end()
        elif self.done and not self.gap:
            self.done.append("")

    def literal(self, lines: list[str]) -> None:
        self.end()
        for i, line in enumerate(lines):
            if i == 0 and line:
                self._put("")
                self.line = []
            self.done.append(line)

    def result(self) -> list[str]:
        self.end()
        while self.done and not self.done[-1]:
            self.done.pop()
        while self.done and not self.done[0]:
            self.done.pop(0)
        return self.done


def _number(value: str | None, default: int, most: int = 1_000_000) -> int:
    value = (value or "").strip()
    return min(int(value), most) if value.lstrip("-").isdecimal() and value.isascii() and len(value) < 9 and value.count("-") < 2 else default


def _seen(element: Element, visible: bool) -> tuple[bool, bool]:
    """Whether the element is rendered, and whether its text is visible."""
    if element.tag in UNSEEN:
        return False, False
    if not element.attributes:
        return True, visible
    if element.attribute("hidden") is not None or (element.tag == "input" and (element.attribute("type") or "").lower() == "hidden"):
        return False, False
    for name, value in _STYLE.findall((element.attribute("style") or "").lower()):
        if name == "display" and value == "none":
            return False, False
        if name == "visibility":
            visible = value not in ("hidden", "collapse")
    return True, visible


def _flow(node: Element, out: _Lines, visible: bool, pre: bool) -> None:
    counter = _number(node.attribute("start"), 1) if node.tag == "ol" else 0
    for child in node.children:
        if isinstance(child, str):
            if visible and pre:
                for i, line in enumerate(child.split("\n")):
                    if i:
                        out.brk()
                    if line:
                        out._put(line.expandtabs(8))
            elif visible:
                out.text(child)
            continue
        shown, seen = _seen(child, visible)
        if not shown:
            continue
        tag = child.tag
        if tag == "br":
            out.brk()
        elif tag == "input":
            if seen and (child.attribute("type") or "").lower() in ("submit", "button", "reset") and (label := child.attribute("value")):
                out.text(label)
        elif tag == "wbr":
            pass
        elif tag == "table":
            out.end()
            out.gap = True
            caption = [x for x in child.children if isinstance(x, Element) and x.tag == "caption"]
            lines = [line for x in caption if _seen(x, seen)[0] for line in _rendered(x, _seen(x, seen)[1], pre)] + _table(child, seen, pre)
            if lines:
                out.literal(lines)
            out.gap = True
        elif tag == "li":
            out.end()
            if node.tag == "ol":
                counter = _number(child.attribute("value"), counter)
                mark, counter = f"{counter}. ", counter + 1
            else:
                mark = "- "
            lines = _rendered(child, seen, pre)
            if lines:
                out.literal([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])
        elif tag in BLOCK:
            out.end()
            off = tag in SET_OFF and not (tag in _LISTS and node.tag in ("li", *_LISTS))
            out.gap |= off
            if tag in ("blockquote", "dd"):
                lines = _rendered(child, seen, pre)
                if lines:
                    out.literal(["  " + x if x else "" for x in lines])
            else:
                _flow(child, out, seen, pre or tag == "pre")
            out.end()
            out.gap |= off
        else:
            _flow(child, out, seen, pre or tag == "textarea")


def _rendered(node: Element, visible: bool, pre: bool) -> list[str]:
    out = _Lines()
    _flow(node, out, visible, pre)
    return out.result()


def _rows(node: Element, visible: bool) -> Iterator[tuple[Element, bool]]:
    """Rows in order; what stands in a table outside rows comes as a row of its own."""
    loose: list = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                loose.append(child)
            continue
        if child.tag in ("caption", "colgroup", "col"):
            continue
        shown, seen = _seen(child, visible)
        if not shown:
            continue
        if child.tag in ("tr", "thead", "tbody", "tfoot"):
            if loose:
                yield _wrapped(loose), visible
                loose = []
            if child.tag == "tr":
                yield child, seen
            else:
                yield from _rows(child, seen)
        else:
            loose.append(child)
    if loose:
        yield _wrapped(loose), visible


def _wrapped(children: list) -> Element:
    if all(isinstance(x, Element) and x.tag in ("td", "th") for x in children):
        row = Element("tr")
        row.children = children
        return row
    row, cell = Element("tr"), Element("td")
    cell.children, row.children = children, [cell]
    return row


def _table(node: Element, visible: bool, pre: bool) -> list[str]:
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: list[tuple[int, int, int]] = []  # first column, end and rows left of cells that reach down
    aligned, passed, size = True, 0, 0  # columns passed that cells from above reach into; characters of cells and separators
    for row, row_visible in _rows(node, visible):
        cells, column = {}, 0
        blocked = sorted(taken) if aligned else []
        passed += len(blocked)
        taken = [(a, b, left - 1) for a, b, left in taken if left > 1] if aligned else []
        groups = [x if isinstance(x, Element) and x.tag in ("td", "th") else _cell(x) for x in row.children if not (isinstance(x, str) and not x.strip())]
        for cell in groups:
            shown, seen = _seen(cell, row_visible)
            if not shown:
                continue
            while blocked and blocked[0][0] <= column:
                column = max(column, blocked.pop(0)[1])
            width = max(1, _number(cell.attribute("colspan"), 1, 1000))
            height = max(1, _number(cell.attribute("rowspan"), 1, 65534))
            cells[column] = (_rendered(cell, seen, pre), width)
            size += 3 + sum(map(len, cells[column][0]))
            aligned &= passed <= PAD * size + FREE
            if height > 1 and aligned:
                taken.append((column, column + width, height - 1))
            column += width
        if cells:
            grid.append(cells)

    def widest(lines: list[str]) -> int:
        return max(map(len, lines), default=0)

    if not aligned:
        return _unaligned(grid)
    widths: dict[int, int] = {}
    for cells in grid:
        for c, (lines, span) in cells.items():
            if span == 1:
                widths[c] = max(widths.get(c, 0), widest(lines))
    for cells in grid:  # what a spanning cell needs beyond its columns goes to the last of them
        for c, (lines, span) in cells.items():
            if span > 1 and lines:
                have = sum(widths.get(x, 0) for x in range(c, c + span)) + 3 * (span - 1)
                widths[c + span - 1] = widths.get(c + span - 1, 0) + max(0, widest(lines) - have)
    used = sorted({c for cells in grid for c in cells} | {c for c, n in widths.items() if n})
    ends = list(accumulate(widths.get(c, 0) + 3 for c in used))
    if sum(ends[bisect_left(used, max(cells))] * max(len(lines) for lines, _ in cells.values()) for cells in grid) > PAD * size + FREE:
        return _unaligned(grid)
    out = []
    for cells in grid:
        row, end = [], -1  # (lines, width) of each column or run of columns, up to the row's last cell
        filled = max(cells)
        for k, c in enumerate(used):
            if c > filled:
                break
            if c < end:
                continue
            lines, span = cells.get(c, ([], 1))
            end = c + span
            covered = used[k : bisect_left(used, end)]
            row.append((lines, sum(widths.get(x, 0) for x in covered) + 3 * (len(covered) - 1)))
        for i in range(max(len(lines) for lines, _ in row)):
            text = " | ".join((lines[i] if i < len(lines) else "").ljust(width) for lines, width in row)
            out.append(text.rstrip().removesuffix(" |").rstrip() if text.strip(" |") else "")
    return [x for x in out if x.strip(" |")]


def _unaligned(grid: list[dict[int, tuple[list[str], int]]]) -> list[str]:
    """Rows as they come, their cells parted."""
    out = []
    for cells in grid:
        columns = [cells[c][0] for c in sorted(cells)]
        for i in range(max(map(len, columns))):
            text = " | ".join(lines[i] if i < len(lines) else "" for lines in columns)
            out.append(text.rstrip().removesuffix(" |").rstrip() if text.strip(" |") else "")
    return [x for x in out if x.strip(" |")]


def _cell(child: Element | str) -> Element:
    cell = Element("td")
    cell.children = [child]
    return cell


def layout(html: str | None) -> str | None:
    return None if html is None else "\n".join(_rendered(parse(html), True, False))


def extracted(df: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """page_id, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [layout(x) for x in part[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[0], pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])

    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, text string, n_chars long")


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
