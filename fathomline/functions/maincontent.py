"""The main container of a page: the shortest one that holds most of an extracted main text.

Containment is measured by grams of twelve characters. Counting every container's distinct grams one by one would cost
depth times length; here each place of a gram is counted at the smallest container around it, and where a gram comes
again, at the container that both places share once less, so that sums from the leaves up are the distinct counts of all
containers at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

GRAM, CONTAINED, LEAST_SHARE = 12, 0.6, 0.5
# What is removed, what may be a container, what marks a container as noise, what a content container has.
REMOVED = frozenset("script style noscript template iframe svg canvas form input button select textarea aside nav".split())
CONTAINERS = frozenset("article main section div".split())
NOISE_HINTS = ("reflist", "references", "refbegin", "navbox", "vertical-navbox", "sidebar", "infobox", "metadata", "mw-editsection", "mw-jump", "catlinks", "printfooter", "toc", "navigation", "breadcrumb", "comment", "reply", "related", "footer")
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 p pre li table".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that an opening tag closes if they are open inside the named ones.
_BLOCK = frozenset("address article aside blockquote dl div fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPACE = re.compile(r"\s+")


@dataclass
class Container:
    tag: str
    parent: int
    depth: int
    noise: bool
    semantic: bool
    begin: int
    end: int = 0
    structure: int = 0


@dataclass
class Page:
    """A page's text without white space, its containers in document order (the first is the whole body), and each character's smallest container."""

    text: str = ""
    containers: list[Container] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page(containers=[Container("body", -1, 0, False, False, 0)])
        self.open: list[tuple[str, int, bool]] = []  # tag, its container (or the one around it), removed
        self.parts: list[str] = []
        self.size = 0
        self.paragraphs: list[list] = []  # [text parts, characters, linked characters]
        self.linked = 0

    def _at(self) -> tuple[int, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (0, False)

    def _pop(self) -> None:
        tag, k, removed = self.open.pop()
        if tag == "a":
            self.linked -= 1
        if self._at()[0] != k:
            self.page.containers[k].end = self.size

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._implied(tag)
        a = {k: v or "" for k, v in attrs}
        k, removed = self._at()
        names = f"{a.get('class', '')} {a.get('id', '')}".lower()
        removed = removed or tag in REMOVED or "hidden" in a or a.get("aria-hidden") == "true" or "mw-editsection" in names.split()
        if tag in VOID:
            return
        if not removed:
            if tag in STRUCTURE:
                self.page.containers[k].structure += 1
            if tag in CONTAINERS or a.get("role") == "main":
                self.page.containers.append(Container(tag, k, self.page.containers[k].depth + 1, any(h in names for h in NOISE_HINTS), tag in ("article", "main") or a.get("role") == "main", self.size))
                k = len(self.page.containers) - 1
            if tag == "p":
                self.paragraphs.append([[], 0, 0])
        if tag == "a":
            self.linked += 1
        self.open.append((tag, k, removed))

    def _implied(self, tag: str) -> None:
        if tag in _BLOCK:
            closed, inside = {"p"}, CONTAINERS | {"td", "th", "li", "blockquote"}
        elif tag in _CLOSES:
            closed, inside = _CLOSES[tag]
        else:
            return
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] in closed:
                while len(self.open) > n:
                    self._pop()
            elif self.open[n][0] in inside or self.open[n][0] in REMOVED:  # nothing leaves a removed part
                return

    def handle_endtag(self, tag: str) -> None:
        for n in range(len(self.open) - 1, -1, -1):
            if self.open[n][0] == tag:
                while len(self.open) > n:
                    self._pop()
                return

    def handle_data(self, data: str) -> None:
        k, removed = self._at()
        text = _SPACE.sub("", data)
        if removed or not text or any(t in ("head", "title") for t, _, _ in self.open):
            return
        self.parts.append(text)
        self.size += len(text)
        self.page.owner += [k] * len(text)
        if any(t == "p" for t, _, _ in self.open):
            held = self.paragraphs[-1]
            held[0].append(text)
            held[1] += len(text)
            held[2] += len(text) if self.linked else 0


def read_page(source: str | None) -> tuple[Page, str]:
    """The page, and its paragraphs' text where less than half of a paragraph is links: a stand-in for an extractor's main text."""
    r = _Reader()
    r.feed(source or "")
    r.close()
    while r.open:
        r._pop()
    page = r.page
    page.text, page.containers[0].end = "".join(r.parts), r.size
    for k in range(len(page.containers) - 1, 0, -1):
        page.containers[page.containers[k].parent].structure += page.containers[k].structure
    return page, "".join("".join(parts) for parts, n, linked in r.paragraphs if 2 * linked < n)


def shared(page: Page, a: int, b: int) -> int:
    """The smallest container around both."""
    c = page.containers
    while a != b:
        if c[a].depth >= c[b].depth:
            a = c[a].parent
        else:
            b = c[b].parent
    return a


def contained(page: Page, target: str) -> list[int]:
    """How many of ``target``'s distinct grams each container holds."""
    counts = [0] * len(page.containers)
    if len(target) < GRAM:  # its only gram is itself, which is one of a text of the same length
        return [int(bool(target) and page.text[c.begin : c.end] == target) for c in page.containers]
    wanted = {target[k : k + GRAM] for k in range(len(target) - GRAM + 1)}
    places: dict[str, set[int]] = {}
    text, owner = page.text, page.owner
    for k in range(len(text) - GRAM + 1):
        gram = text[k : k + GRAM]
        if gram in wanted:
            a, b = owner[k], owner[k + GRAM - 1]
            places.setdefault(gram, set()).add(a if a == b else shared(page, a, b))
    for held in places.values():
        before = None
        for k in sorted(held):  # document order
            counts[k] += 1
            if before is not None:
                counts[shared(page, before, k)] -= 1
            before = k
    for k in range(len(counts) - 1, 0, -1):
        counts[page.containers[k].parent] += counts[k]
    return counts


@dataclass
class Located:
    level: str
    tag: str
    begin: int
    end: int
    grams: int
    wanted: int


def locate(page: Page, target: str) -> Located:
    """``matched``: the shortest container that is no noise, has content elements, at least half the target's length and 0.6
    of its grams (the first among equals); else ``semantic_container``, the first article, main or role main with text; else ``full_body``."""
    target = _SPACE.sub("", target)
    counts = contained(page, target)
    wanted = len({target[k : k + GRAM] for k in range(max(1, len(target) - GRAM + 1))}) if target else 0
    best = None
    for k, c in enumerate(page.containers[1:], 1):
        size = c.end - c.begin
        if not c.noise and wanted and c.structure and size >= int(len(target) * LEAST_SHARE) and counts[k] / wanted >= CONTAINED and (best is None or size < page.containers[best].end - page.containers[best].begin):
            best = k
    level = "matched"
    if best is None:
        named = [k for k, c in enumerate(page.containers) if c.semantic and c.end > c.begin]
        best = min(named, key=lambda k: ({"article": 0, "main": 1}.get(page.containers[k].tag, 2), k), default=0)
        level = "semantic_container" if named else "full_body"
    c = page.containers[best]
    return Located(level, c.tag, c.begin, c.end, counts[best], wanted)
