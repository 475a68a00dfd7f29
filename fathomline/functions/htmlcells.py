"""Cells of HTML tables with their places, spans, links, images and nested tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

MOST_SPAN = 256
BLOCKS = frozenset({"p", "pre", "blockquote", "ul", "ol", "table"})


@dataclass
class Cell:
    table: str
    row: int
    column: int
    row_span: int
    column_span: int
    header: bool
    parts: list[str] = field(default_factory=list)
    images: list[str] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    nested: list[str] = field(default_factory=list)
    blocks: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class _Table:
    name: str
    row: int = -1
    column: int = 0
    taken: set[tuple[int, int]] = field(default_factory=set)
    children: int = 0
    cell: Cell | None = None
    depth: int = 0  # of elements inside the open cell
    link: list | None = None


def _span(value: str | None) -> int:
    return min(MOST_SPAN, max(1, int(value))) if value and value.strip().isdigit() else 1


class _Cells(HTMLParser):
    """Tables are named table-001, table-002 in order, and their nested ones table-001-001 and so on."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[Cell] = []
        self.open: list[_Table] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a, top = dict(attrs), self.open[-1] if self.open else None
        if top and top.cell and tag in BLOCKS and top.depth == 0:
            top.cell.blocks += 1
        if tag == "table":
            if top and top.cell:
                top.children += 1
                name = f"{top.name}-{top.children:03d}"
                top.cell.nested.append(name)
            else:
                self.count += 1
                name = f"table-{self.count:03d}"
            self.open.append(_Table(name))
        elif top is None:
            return
        elif tag == "tr":
            top.cell, top.row, top.column = None, top.row + 1, 0
        elif tag in ("td", "th"):
            top.row = max(top.row, 0)
            while (top.row, top.column) in top.taken:
                top.column += 1
            cell = Cell(top.name, top.row, top.column, _span(a.get("rowspan")), _span(a.get("colspan")), tag == "th")
            top.taken |= {(cell.row + r, cell.column + c) for r in range(cell.row_span) for c in range(cell.column_span)}
            top.column += cell.column_span
            top.cell, top.depth = cell, 0
            self.cells.append(cell)
        elif top.cell:
            if tag == "img" and a.get("src"):
                top.cell.images.append(a["src"])
            elif tag == "a" and a.get("href"):
                top.link = [a["href"], len(top.cell.parts)]
            if tag in BLOCKS or tag in ("br", "li", "div"):
                top.cell.parts.append(" ")
            top.depth += tag in BLOCKS

    def handle_endtag(self, tag: str) -> None:
        top = self.open[-1] if self.open else None
        if top is None:
            return
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th", "tr"):
            top.cell = None
        elif top.cell:
            if tag == "a" and top.link:
                href, at = top.link
                top.cell.links.append((" ".join("".join(top.cell.parts[at:]).split()), href))
                top.link = None
            if tag in BLOCKS:
                top.depth = max(0, top.depth - 1)
                top.cell.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell:
            self.open[-1].cell.parts.append(data)


def table_cells(source: str | None) -> list[Cell]:
    """The cells of all tables of a page, in document order."""
    parser = _Cells()
    parser.feed(source or "")
    parser.close()
    return parser.cells
