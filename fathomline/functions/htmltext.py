"""HTML to Markdown: headings, paragraphs, lists, quotes, code, links, images and tables, without hidden parts."""

from __future__ import annotations

from html.parser import HTMLParser

from fathomline.functions.text import _span, table_grids

HIDDEN = frozenset("script style noscript template iframe nav footer aside form svg head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main header ul ol li blockquote pre table tr h1 h2 h3 h4 h5 h6 figure figcaption dl dt dd".split())


class Renderer(HTMLParser):
    """Collects Markdown blocks; a table is kept as source and rendered from its grid."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.hidden: list[str] = []
        self.lists: list[list] = []
        self.code = 0
        self.table: list[str] | None = None
        self.deep = 0
        self.links: list[str] = []

    def flush(self) -> None:
        text = "".join(self.line)
        text = text.strip("\n") if self.code else " ".join(text.split())
        if text:
            self.blocks.append(f"```\n{text}\n```" if self.code else self.prefix + text)
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if self.table is not None:
            self.deep += tag == "table"
            if tag in ("table", "tr", "td", "th"):
                self.table.append(f'<{tag} rowspan="{_span(a.get("rowspan"))}" colspan="{_span(a.get("colspan"))}">')
            return
        gone = tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true"
        if self.hidden or gone:
            if tag not in VOID:
                self.hidden.append(tag)
            return
        if tag == "table":
            self.flush()
            self.table = ["<table>"]
            return
        if tag in BLOCKS:
            self.flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "
            self.prefix = "  " * (len(self.lists) - 1) + mark
        elif tag == "blockquote":
            self.prefix = "> "
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "pre":
            self.code += 1
        elif tag == "br":
            self.line.append("\n" if self.code else " ")
        elif tag in ("b", "strong"):
            self.line.append("**")
        elif tag == "a":
            self.links.append(a.get("href") or "")
            self.line.append("[")
        elif tag == "img" and a.get("src"):
            self.line.append(f"![{a.get('alt') or ''}]({a['src']})")

    def handle_endtag(self, tag: str) -> None:
        if self.table is not None:
            if tag == "table" and not self.deep:
                self._table()
            else:
                self.deep -= tag == "table"
                if tag in ("table", "tr", "td", "th"):
                    self.table.append(f"</{tag}>")
            return
        if self.hidden:
            if tag in self.hidden:
                while self.hidden.pop() != tag:
                    pass
            return
        if tag in BLOCKS:
            self.flush()
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre":
            self.code = max(0, self.code - 1)
        elif tag in ("b", "strong"):
            self.line.append("**")
        elif tag == "a" and self.links:
            self.line.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if self.table is not None:
            self.table.append(data.replace("&", "&amp;").replace("<", "&lt;"))
        elif not self.hidden:
            self.line.append(data)

    def _table(self) -> None:
        for grid in table_grids("".join(self.table or []) + "</table>"):
            if grid and grid[0]:
                rows = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in grid]
                self.blocks.append("\n".join([rows[0], "|" + " --- |" * len(grid[0]), *rows[1:]]))
        self.table, self.deep = None, 0


def to_markdown(source: str | None) -> str:
    """Markdown of a page; blocks are parted by an empty line."""
    r = Renderer()
    r.feed(source or "")
    r.close()
    if r.table is not None:
        r._table()
    r.flush()
    return "\n\n".join(r.blocks)


def cells(markdown_table: str) -> list[list[str]]:
    """Cells of a pipe table without its rule line."""
    rows = [line.strip().strip("|") for line in markdown_table.split("\n")]
    return [[c.strip().replace("\\|", "|") for c in row.replace("\\|", "\0").replace("|", "\n").replace("\0", "\\|").split("\n")] for k, row in enumerate(rows) if k != 1]
