"""Layout-aware text of HTML pages.

A tree builder with implied tags (a new list item closes the last one, a block closes an
open paragraph, cells and rows close each other, a table gets its body, a head ends where its
page begins) makes a tree; what
is not shown (scripts, styles, heads, ``hidden``, ``display: none`` and the like) is left out; the rest
is rendered as text: blocks stand apart by lines, paragraphs and headings by an empty
line, list items have a marker and an indent, table columns are aligned (also beside cells that span
columns or rows), and preformatted text keeps its spaces.

Pages may be nested to any depth: nothing here calls itself. The rendering functions are
generators that yield the calls they need to ``_run``, which keeps them in a list.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = lambda text: frozenset(text.split())

# Element classes of HTML.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style")
PLAIN = _words("title textarea")
NOT_SHOWN = _words(
    "head title script style template noscript iframe object audio video canvas svg math select datalist option "
    "textarea base meta link param source track"
)
BLOCKS = _words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr caption ul"
)
SPACED = _words("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset")
LISTS = _words("ul ol menu dir")
CELLS = _words("td th")
TABLE_PARTS = _words("thead tbody tfoot")
# A start tag closes these open elements, up to the nearest of the elements that bound the search.
CLOSES_PARAGRAPH = BLOCKS - _words("html body li dd dt tr td th tbody thead tfoot caption legend summary")
IMPLIED_END = {
    "li": (_words("li"), LISTS),
    "dd": (_words("dd dt"), _words("dl")),
    "dt": (_words("dd dt"), _words("dl")),
    "tr": (_words("tr td th caption"), _words("table")),
    "td": (CELLS, _words("tr table")),
    "th": (CELLS, _words("tr table")),
    "tbody": (_words("thead tbody tfoot tr td th caption"), _words("table")),
    "thead": (_words("thead tbody tfoot tr td th caption"), _words("table")),
    "tfoot": (_words("thead tbody tfoot tr td th caption"), _words("table")),
    "option": (_words("option"), _words("select")),
}
# All that may stand in these; anything else but blank text closes them.
HOLDS_ONLY = {"head": _words("base link meta noframes noscript script style template title"), "colgroup": _words("col template")}
# A start tag of a part of a table also closes what stands open inside of the nearest of these.
TABLE_PLACES = {
    "tr": TABLE_PARTS | {"table"},
    "td": TABLE_PARTS | {"table", "tr"},
    "th": TABLE_PARTS | {"table", "tr"},
    "tbody": _words("table"),
    "thead": _words("table"),
    "tfoot": _words("table"),
}
# Elements whose content has no such tags.
APART = _words("template noscript noframes iframe svg math")
# An end tag is not matched with a start tag outside of these.
SCOPE = CELLS | _words("table caption html body")
THROUGH_SCOPE = SCOPE | TABLE_PARTS | _words("tr template")

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_BLANK = " \t\n\r\f"


@dataclass
class Element:
    name: str
    shown: bool = True
    start: int = 1
    content: list = field(default_factory=list)  # elements and texts
    spans: tuple[int, int] = (1, 1)  # columns and rows of a cell; 0 rows: all that follow


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _span(value: str | None, least: int, most: int) -> int:
    digits = re.match(r"[ \t\n\r\f]*\+?([0-9]{1,9})", value or "")
    number = int(digits[1]) if digits else 1
    return 1 if number < least else min(number, most)


def _element(name: str, attributes: str) -> Element:
    shown, start, spans = name not in NOT_SHOWN, 1, (1, 1)
    if attributes and not attributes.isspace():
        values = _attributes(attributes)
        if "hidden" in values or (name == "dialog" and "open" not in values):
            shown = False
        if name == "input" or _HIDING.search(values.get("style", "")):
            shown = False
        if name == "ol" and values.get("start", "").strip().lstrip("-").isdigit():
            start = int(values["start"])
        if name in CELLS:
            spans = _span(values.get("colspan"), 1, 1000), _span(values.get("rowspan"), 0, 65534)
    elif name == "dialog" or name == "input":
        shown = False
    return Element(name, shown, start, spans=spans)


class _Builder:
    def __init__(self):
        self.root = Element("html")
        self.open = [self.root]
        self.places = defaultdict(list)  # by name: where in ``open`` such elements are, without the root

    def _push(self, element: Element) -> None:
        self.places[element.name].append(len(self.open))
        self.open.append(element)

    def _cut(self, length: int) -> None:
        while len(self.open) > length:
            self.places[self.open.pop().name].pop()

    def _last(self, names: frozenset) -> int:
        """The place of the innermost open element of ``names``, 0 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def text(self, value: str) -> None:
        if value:
            if self.open[-1].name in HOLDS_ONLY and value.strip(_BLANK):
                self._cut(len(self.open) - 1)
            self.open[-1].content.append(value)

    def _close_to(self, names: frozenset, bounds: frozenset) -> None:
        """Close the outermost open element of ``names`` that no element of ``bounds`` encloses more closely."""
        found = [places for n in names if (places := self.places.get(n))]
        if not found:
            return
        bound = self._last(bounds)
        cuts = [places[at] for places in found if (at := bisect_right(places, bound)) < len(places)]
        if cuts:
            self._cut(min(cuts))

    def _clear_to(self, names: frozenset) -> None:
        """Close all inside of the nearest open element of ``names``; without one, nothing."""
        place = self._last(names)
        if place and place >= self._last(APART | SCOPE):
            self._cut(place + 1)

    def begin(self, name: str, attributes: str) -> None:
        if name == "html":  # there is one already
            return
        if name not in HOLDS_ONLY.get(self.open[-1].name, (name,)):
            self._cut(len(self.open) - 1)
        if name == "body":  # it changes nothing else
            return
        if name in CLOSES_PARAGRAPH:
            self._close_to(frozenset(("p",)), SCOPE | LISTS)
        if name in IMPLIED_END:
            self._close_to(*IMPLIED_END[name])
        if name in TABLE_PLACES:
            self._clear_to(TABLE_PLACES[name])
        top = self.open[-1].name
        if name == "tr" and top == "table":
            self._begin_implied("tbody")
        elif name in CELLS and top in TABLE_PARTS | {"table"}:
            if top == "table":
                self._begin_implied("tbody")
            self._begin_implied("tr")
        element = _element(name, attributes)
        self.open[-1].content.append(element)
        if name == "form" and top in TABLE_PARTS | {"table", "tr"}:  # rows and cells are not inside of it
            return
        if name not in VOID:
            self._push(element)

    def _begin_implied(self, name: str) -> None:
        element = Element(name)
        self.open[-1].content.append(element)
        self._push(element)

    def end(self, name: str) -> None:
        if name == "br":
            if self.open[-1].name in HOLDS_ONLY:
                self._cut(len(self.open) - 1)
            self.open[-1].content.append(Element("br"))
            return
        places = self.places.get(name)
        if places and (name in THROUGH_SCOPE or places[-1] > self._last(SCOPE)):
            self._cut(places[-1])


def build_tree(page: str) -> Element:
    """The element tree of a page, however broken it is."""
    builder, at = _Builder(), 0
    while match := _MARKUP.search(page, at):
        builder.text(html.unescape(page[at : match.start()]) if "&" in page[at : match.start()] else page[at : match.start()])
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        if match[1]:
            builder.end(name)
            continue
        builder.begin(name, match[3])
        if name in RAW or name in PLAIN:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            end = stop.start() if stop else len(page)
            builder.text(page[at:end] if name in RAW else html.unescape(page[at:end]))
            at = end
    builder.text(html.unescape(page[at:]))
    return builder.root


class _Lines:
    """Text that is being laid out: words run on, blocks begin new lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space before the next word
        self.gap = False  # an empty line before the next text

    def words(self, text: str) -> None:
        parts = _SPACES.sub(" ", text)
        if parts.startswith(" "):
            self.space, parts = True, parts[1:]
        if not parts:
            return
        self._begin()
        if self.space and self.line:
            self.line.append(" ")
        self.space = parts.endswith(" ")
        self.line.append(parts[:-1] if self.space else parts)

    def _begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False

    def break_line(self) -> None:
        """A line break of its own: also ends an empty line."""
        self._begin()
        self.lines.append("".join(self.line))
        self.line, self.space = [], False

    def block(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            self._begin()
            self.lines += lines

    def empty_line(self) -> None:
        self.end_line()
        self.gap = True

    def done(self) -> list[str]:
        self.end_line()
        first, end = 0, len(self.lines)
        while first < end and not self.lines[first].strip():
            first += 1
        while first < end and not self.lines[end - 1].strip():
            end -= 1
        return self.lines[first:end]


def _texts(element: Element) -> Iterator[str]:
    stack = [iter(element.content)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                yield part
            elif part.name == "br":
                yield "\n"
            elif part.shown:
                stack.append(iter(part.content))
                break
        else:
            stack.pop()


def _run(call: Generator):
    """The result of a rendering function, with all the calls that it yields."""
    calls, result = [call], None
    while calls:
        try:
            call = calls[-1].send(result)
        except StopIteration as stop:
            calls.pop()
            result = stop.value
        else:
            calls.append(call)
            result = None
    return result


def _lines(element: Element) -> Generator:
    out = _Lines()
    yield _flow(element, out)
    return out.done()


def _indented(lines: list[str], first: str, rest: str) -> list[str]:
    return [(first if i == 0 else rest) + line if line or i == 0 else "" for i, line in enumerate(lines)]


def _list(element: Element) -> Generator:
    out, number = [], element.start
    for part in element.content:
        if isinstance(part, str):
            if part.strip():
                out += _indented((yield _lines(Element("div", content=[part]))), "  ", "  ")
            continue
        if not part.shown:
            continue
        lines = yield _lines(part)
        if part.name != "li":
            out += _indented(lines, "  ", "  ")
            continue
        marker = f"{number}. " if element.name == "ol" else "- "
        number += 1
        if lines:
            out += _indented(lines, marker, " " * len(marker))
    return out


def _in_table(table: Element) -> Iterator[Element | str]:
    """What is shown of a table and of its sections: rows, and what stands between them."""
    for part in table.content:
        if isinstance(part, str):
            yield part
        elif part.shown and part.name in TABLE_PARTS:
            yield from (inner for inner in part.content if isinstance(inner, str) or inner.shown)
        elif part.shown:
            yield part


@dataclass
class _Cell:
    lines: list[str]
    columns: int = 1
    rows: int = 1
    column: int = 0


def _place(grid: list[list[_Cell]]) -> None:
    """Each cell gets its column: the next one of its row that no cell from above reaches into."""
    taken: list[tuple[int, int, int]] = []  # (first column, end column, end row) of cells that reach into further rows
    for r, cells in enumerate(grid):
        taken = [t for t in taken if t[2] > r]
        column, k, new = 0, 0, []
        for cell in cells:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            cell.column = column
            column += cell.columns
            end = min(r + cell.rows, len(grid)) if cell.rows else len(grid)
            if end > r + 1:
                new.append((cell.column, column, end))
        merged: list[tuple[int, int, int]] = []
        for first, last, end in sorted(taken + new):
            # Neighbours that end in the same row are one, so a page of long cells stays linear.
            if merged and merged[-1][1] == first and merged[-1][2] == end:
                merged[-1] = (merged[-1][0], last, end)
            else:
                merged.append((first, last, end))
        taken = merged


def _aligned(grid: list[list[_Cell]]) -> list[str]:
    """The rows as text, cells of one column one below the other."""
    starts = sorted({cell.column for cells in grid for cell in cells})
    number = {column: i for i, column in enumerate(starts)}
    widths = [0] * len(starts)
    wide: list[tuple[int, int, int]] = []  # (columns in use that a cell spans, the first of them, its width)
    for cells in grid:
        # The last cell of a row sets no width: nothing stands behind it.
        for cell in cells[:-1]:
            first, width = number[cell.column], max(map(len, cell.lines), default=0)
            spanned = bisect_left(starts, cell.column + cell.columns) - first
            if spanned == 1:
                widths[first] = max(widths[first], width)
            else:
                wide.append((spanned, first, width))
    for spanned, first, width in sorted(wide):
        own = sum(widths[first : first + spanned]) + 2 * (spanned - 1)
        widths[first + spanned - 1] += max(0, width - own)
    offsets = [0, *accumulate(width + 2 for width in widths)]
    out = []
    for cells in grid:
        for k in range(max((len(cell.lines) for cell in cells), default=0)):
            line = ""
            for cell in cells:
                if k < len(cell.lines):
                    line = line.ljust(offsets[number[cell.column]]) + cell.lines[k]
            out.append(line.rstrip())
    return out


def _table(element: Element) -> Generator:
    """Captions and what stands outside of cells first, then the rows with aligned columns.

    Cells that span columns or rows keep the others in their columns.
    """
    out, grid = [], []
    for row in _in_table(element):
        if isinstance(row, str):
            if row.strip():
                out.append(_SPACES.sub(" ", row).strip())
            continue
        if row.name != "tr":
            if row.name not in ("colgroup", "col"):
                out += yield _lines(row)
            continue
        cells = []
        for part in row.content:
            if isinstance(part, str):
                if part.strip():
                    cells.append(_Cell([_SPACES.sub(" ", part).strip()]))
            elif part.shown:
                cells.append(_Cell((yield _lines(part)), *part.spans))
        grid.append(cells)
    _place(grid)
    grid = [cells for cells in grid if any(cell.lines for cell in cells)]
    if all(len(cells) == 1 for cells in grid):  # one column: layout, nothing to align
        return out + [line for cells in grid for line in cells[0].lines]
    return out + _aligned(grid)


def _flow(element: Element, out: _Lines) -> Generator:
    for part in element.content:
        if isinstance(part, str):
            out.words(part)
            continue
        name = part.name
        if not part.shown:
            continue
        if name == "br":
            out.break_line()
        elif name == "wbr" or name == "img":
            continue
        elif name == "hr":
            out.empty_line()
        elif name not in BLOCKS:
            yield _flow(part, out)
        else:
            apart = out.empty_line if name in SPACED else out.end_line
            apart()
            if name == "pre":
                out.block("".join(_texts(part)).strip("\n").split("\n"))
            elif name in LISTS:
                out.block((yield _list(part)))
            elif name == "table":
                out.block((yield _table(part)))
            elif name in ("blockquote", "dd"):
                out.block(_indented((yield _lines(part)), "  ", "  "))
            else:
                yield _flow(part, out)
            apart()


def page_text(page: str | None) -> str | None:
    """All visible text of a page; null for null."""
    if page is None:
        return None
    return "\n".join(line.rstrip() for line in _run(_lines(build_tree(page))))


def extract_text(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """One row per row: page_id, text. A null page has a null text, one without visible text an empty one.

    Ids may be null or repeat; other columns are not read. No shuffle; an empty table gives
    an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(value) for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    columns = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(page).alias("html"))
    return columns.mapInArrow(run, "page_id bigint, text string")
