"""HTML extraction: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, by weights from labelled pages: the log
ratio of how often a kind of token occurs inside and outside the content there. Names that mark an element (classes, ids and
roles, whole or word by word) have such weights too, learned from the words under them: the score of a word is its own and
its element's. A linear scan finds the contiguous run with the largest sum. The content is the article or main element around that run,
or else the run's own blocks, widened to their container where the container scores nearly as much. Inside it an element whose names
turn the score of its words negative is left out, and so are menus, footers, sidebars, forms, scripts and styles by their elements.

Defined results: a null or empty page, and a page without a word outside such parts, has an empty text. Unclosed and
wrongly nested tags end with the element around them; a comment, tag, script or style that never closes lasts to the end. Quotes
count in a tag only after an equals sign. Hidden elements, formulas and fallback texts are content. Repeated rows, and rows without an id,
have a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import arrow_map

#: Elements that are menus, footers, sidebars, forms, notices, scripts, styles or nothing to read, wherever they stand.
DROPPED = frozenset("nav footer aside form script style template iframe svg select textarea button dialog menu head title option datalist".split())
#: Read to their end tag without looking for tags inside.
RAW = frozenset("script style textarea title template iframe svg".split())
#: Their end tags, searched in the page itself: lower-casing it first can change its length.
_ENDS = {name: re.compile(f"</(?i:{name})", re.ASCII) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body td html".split())
BLOCKS = (CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption header hr address hgroup details summary fieldset center".split()) | DROPPED)
#: Elements that only hold text: what they are named counts as a whole, since such names mostly head sections.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figure figcaption table tr td th caption details summary hgroup".split())
_TOKENS = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.DOTALL)
_MARKS = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Closed by another of the same group in the same parent.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES |= {b: {"p"} for b in BLOCKS - set(_CLOSES) - {"head", "title", "script", "style", "template", "button", "option", "body", "html"}}
#: Elements inside which another element's end tag looks no further, but for the ends of those that hold such elements.
_CELLS, _ACROSS = frozenset({"td", "th", "table"}), frozenset("table tr tbody thead body html article div".split())
_BOXES = CONTAINERS | {"ul", "ol", "dl", "table", "blockquote"}

#: Labelled pages: the content stands between the two marks. Written for this module.
LABELLED_PAGES = [
    "<html><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul></nav><article>[[<h1>River levels fall after a dry spring</h1><p>Water levels along the lower valley fell again this week, and farmers have begun to pump from the older wells.</p><p>Officials said that a rule on garden hoses may follow in the summer if no rain comes.</p>]]</article><footer><p>Contact us</p><a href=4>Privacy</a></footer></body></html>",
    "<body><div class=menu><a href=1>Start</a> <a href=2>Shop</a> <a href=3>Help</a></div><div class=content>[[<p>Bread needs four things: flour, water, salt and time. The last of them is what most kitchens lack.</p><ul><li>Mix the flour and the water and leave them for an hour.</li><li>Add salt and fold the dough until it is smooth.</li></ul><p>Bake it hot and let it cool before you cut it.</p>]]</div><div class=sidebar><h3>Popular</h3><ul><li><a href=5>Soup</a></li><li><a href=6>Cake</a></li></ul></div></body>",
    "<body><div id=cookie><p>We use cookies. <button>Accept</button></p></div><main>[[<h2>How the tower was moved</h2><p>In the autumn the whole tower was lifted on two hundred jacks and drawn along rails for a distance of forty metres.</p><blockquote>Nobody thought that the clock would keep going, but it did.</blockquote><p>The work took nine days and cost less than a new tower would have.</p>]]</main><div class=ad><a href=9>Cheap flights</a></div><footer>2020</footer></body>",
    "<body><header><a href=1><img src=x></a><form><input><button>Search</button></form></header><section>[[<p>The committee met on Tuesday and agreed on the budget for the next three years, with two members against it.</p><table><tr><td>Roads and bridges take the largest share</td><td>forty percent</td></tr></table><p>A second reading follows in March.</p>]]</section><div class=comments><h3>Comments</h3><p>First!</p><p>Nice one</p></div><aside><a href=2>More</a></aside></body>",
    "<body><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul><div>[[<p>A short walk leads from the station to the lake, where boats can be hired by the hour in the warmer months of the year.<br>Dogs are welcome <b>on the lower path</b> only.</p>]]</div><ul><li><a href=3>Map</a></li><li><a href=4>Prices</a></li></ul><script>track()</script></body>",
    "<body><nav><a href=1>One</a><a href=2>Two</a></nav><article>[[<h1>Notes on winter birds</h1><p>The siskin comes to the alders by the stream in small flocks and hangs head down from the cones like a tit.</p><p>See the <a href=3>list of birds</a> for the others that stay.</p>]]<div class=share><a href=4>Share</a><a href=5>Mail</a></div></article><footer>All rights reserved</footer></body>",
]
#: Names that the labelled pages give to elements around the content, one page each, and to elements of the content.
NAMES_AROUND = (
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side widget "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "disqus respond reply replies discussion related recommended recommendations share sharing social pagination pager skip search tagcloud copyright disclaimer complementary contentinfo"
).split()
NAMES_INSIDE = (
    'class="content" class="post" class="entry" class="entry-content" class="article-body" class="story" class="body" class="text" class="abstract" class="lead" class="alert-level" class="title" class="note" class="quote" '
    'class="section" class="article-header" class="entry-header" class="post-header" role="main" role="article" id="content" id="main" id="discussion" id="related-work" id="introduction" id="methods" id="results" id="conclusion" id="references" id="notes"'
).split(" ")


def labelled_pages() -> list[str]:
    """LABELLED_PAGES, and a page for each of the names: a part of that name beside or inside a short article."""
    words = "words of that part, as many as such parts tend to have on a page like this one"
    text = "<p>What the page is about stands here, in whole sentences of some length, and goes on for a while.</p>"
    pages = list(LABELLED_PAGES)
    for name in NAMES_AROUND:
        kind = "role" if name in ("complementary", "contentinfo", "navigation", "search", "banner") else "class"
        pages.append(f'<body><div {kind}="{name}"><p>{words}</p></div><article>[[<h1>Title of it</h1>{text}]]</article></body>')
        if name != "discussion":
            pages.append(f'<body><article>[[{text}]]</article><div id="{name}"><p>{words}</p></div></body>')
    return pages + [f"<body><article>[[<div {name}><p>{words}</p></div>{text}]]</article></body>" for name in NAMES_INSIDE]


def names(attributes: str) -> list[tuple[str, str]]:
    """(attribute, name) of every class, id and role in a tag's attributes."""
    return [(m[1].lower(), word) for m in _MARKS.finditer(attributes) for word in m[2].strip("\"'").split()] if "=" in attributes else []


def features(element: str, marks: list[tuple[str, str]], known: dict[str, float] | None, inside: bool) -> list[str]:
    """What an element's names count as: each name as a whole where the labelled pages know it so (``known``), and else its
    words, but not those of a text's name or of a section's or header's id. ``inside`` an article a header is its own title."""
    out = []
    for attribute, name in marks:
        whole = f"{'id' if attribute == 'id' else 'name'} {name.lower()}"
        words = _WORDS.findall(_HUMP.sub(" ", name).lower())
        if known is None or whole in known:
            out.append(whole)
        if known is None or whole not in known and element not in TEXTS and not (attribute == "id" and element in ("section", "header", "article", "main")):
            out += [f"word {w}" for w in words if not (inside and w in HEADER_WORDS)]
    return out


#: These say header of the page outside an article, and the article's own title inside.
HEADER_WORDS = frozenset({"header", "masthead"})
_LINK, _WORD, _OUT = "link word", "word", "dropped word"


class Page:
    """The tokens of a page: runs of text with their element, and tags.

    ``kinds`` and ``amounts`` are the scored sequence (kind of token, words in it); ``runs[k]`` is (text, element) or
    None for a tag. An element is [parent, name, dropped, own score of its words or None, inside an article or main].
    With ``weights`` elements are judged by their names; without, ``marked`` gathers what the names count as.
    """

    def __init__(self, source: str, weights: dict[str, float] | None = None) -> None:
        self.weights = weights
        self.runs: list[tuple[str, list] | None] = []
        self.kinds: list[str] = []
        self.amounts: list[int] = []
        self.own: list[float | None] = []
        self.breaks: list[int] = []  # tokens before which a block ends
        self.marked: list[frozenset] = []
        root: list = [None, "html", False, None, False, frozenset()]
        self.stack = [root]
        self.open_in_cell, self.open_in_box = [Counter()], [Counter()]
        self.open = Counter()
        close_raw = ""
        at, n = 0, len(source)
        while at < n:
            if close_raw:
                stop = _ENDS[close_raw].search(source, at)
                at, close_raw = (stop.start() if stop else n), ""
                continue
            m = _TOKENS.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                self._text(source[at:begin], self.stack[-1])
            if not m:
                break
            at = m.end()
            if not m[1]:
                continue
            name = m[1].lower()
            if name in BLOCKS:
                self.breaks.append(len(self.runs))
            self._token(None, "tag " + name, 1, None)
            if source[begin + 1] == "/":
                self._end(name)
            elif self._start(name, m[2]):
                close_raw = name

    def _start(self, name: str, attributes: str) -> bool:
        """Open an element; whether it is read raw from here."""
        if name == "br":
            self._token((" ", self.stack[-1]), "space", 0, None)
        if name in VOID:
            return False
        if shut := _CLOSES.get(name):
            while True:
                found = next((x for x in shut if self.open_in_box[-1][x]), None)
                if found:
                    self._pop_to(shut)
                elif len(self.open_in_box) > 1 and (opener := self._box()) in shut:
                    self._pop_to({opener})
                else:
                    break
                if name != "tr":
                    break
        outer = self.stack[-1]
        inside = outer[4] or name in ("article", "main")
        marks = names(attributes) if name not in ("html", "body", "article", "main") else []
        own, gathered = outer[3], outer[5]
        dropped = outer[2] or name in DROPPED or name == "header" and not outer[4]
        if marks:
            what = features(name, marks, self.weights, outer[4])
            if self.weights is None:
                gathered = outer[5] | frozenset(what)
            elif what:
                score = self.weights[_WORD] + sum(self.weights.get(f, 0.0) for f in what)
                if score < 0:
                    own, dropped = min(score, own or 0.0), True
        if attributes.endswith("/") and name in ("svg", "iframe"):
            return False
        self.stack.append([outer, name, dropped, own, inside, gathered])
        self.open[name] += 1
        self.open_in_cell[-1][name] += 1
        self.open_in_box[-1][name] += 1
        if name in _CELLS:
            self.open_in_cell.append(Counter())
        if name in _BOXES:
            self.open_in_box.append(Counter())
        return name in RAW

    def _box(self) -> str:
        return next(e[1] for e in reversed(self.stack) if e[1] in _BOXES)

    def _pop(self) -> str:
        name = self.stack.pop()[1]
        if name in _CELLS:
            self.open_in_cell.pop()
        if name in _BOXES:
            self.open_in_box.pop()
        self.open[name] -= 1
        self.open_in_cell[-1][name] -= 1
        self.open_in_box[-1][name] -= 1
        return name

    def _pop_to(self, wanted: set[str]) -> None:
        while self._pop() not in wanted:
            pass

    def _end(self, name: str) -> None:
        if (self.open if name in _ACROSS else self.open_in_cell[-1])[name] or name in _CELLS and self.open[name]:
            self._pop_to({name})

    def _token(self, run: tuple[str, list] | None, kind: str, amount: int, own: float | None) -> None:
        self.runs.append(run)
        self.kinds.append(kind)
        self.amounts.append(amount)
        self.own.append(own)
        if self.weights is None:
            self.marked.append(run[1][5] if run else frozenset())

    def _text(self, text: str, element: list) -> None:
        words = text.count(" ") + text.count("\n") + 1 if not text.isspace() else 0
        linked = self.open["a"] > 0 and self._linked(element)
        self._token((text, element), _OUT if element[2] else _LINK if linked else _WORD, words, element[3])

    @staticmethod
    def _linked(element: list) -> bool:
        while element[0] is not None and element[1] not in BLOCKS:
            if element[1] == "a":
                return True
            element = element[0]
        return False


def fit_weights(pages: list[str]) -> dict[str, float]:
    """Score of every kind of token: add-half log ratios, kept above zero for words and below for tags and for link
    words and words of dropped parts, which the labelled pages hold outside the content. Names weigh as the words under them lie."""
    inside, outside, named_in, named_out = Counter(), Counter(), Counter(), Counter()
    for source in pages:
        page = Page(source.replace("[[", "<mark-on>").replace("]]", "<mark-off>"))
        into, names_into = outside, named_out
        for kind, amount, marks in zip(page.kinds, page.amounts, page.marked, strict=True):
            if kind in ("tag mark-on", "tag mark-off"):
                into, names_into = (inside, named_in) if kind == "tag mark-on" else (outside, named_out)
                continue
            into[kind] += amount
            for f in marks:
                names_into[f] += amount
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    ratio = {k: math.log((inside[k] + 0.5) / n_in) - math.log((outside[k] + 0.5) / n_out) for k in {*inside, *outside}}
    out = {k: 0.0 if k == "space" else max(0.1, v) if k == _WORD else min(-0.05, v) for k, v in ratio.items()}
    return out | {f: math.log((named_in[f] + 0.5) / (named_out[f] + 0.5)) for f in {*named_in, *named_out}}


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """First and last index of the contiguous run with the largest sum, the earliest and then shortest among equals; (0, -1) if no
    score is positive. One linear scan: a run starts after the smallest prefix sum before its end."""
    if not len(scores) or scores.max() <= 0:
        return 0, -1
    ends = np.cumsum(scores)
    before = np.concatenate([[0.0], ends[:-1]])
    least = np.minimum.accumulate(before)
    z = int(np.argmax(ends - least))
    return int(np.argmin(before[: z + 1])), z


class Extractor:
    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        tags = [v for k, v in weights.items() if k.startswith("tag ")]
        self.unknown_tag = float(np.mean(tags)) if tags else -1.0

    def scores(self, page: Page) -> np.ndarray:
        weight = {k: self.weights.get(k, self.unknown_tag if k.startswith("tag ") else 0.0) for k in set(page.kinds)}
        return np.asarray([(weight[k] if own is None else min(own, weight[k])) * n for k, n, own in zip(page.kinds, page.amounts, page.own, strict=True)])

    def text(self, source: str | None) -> str:
        """The main text of one page."""
        if not source:
            return ""
        page = Page(source, self.weights)
        scores = self.scores(page)
        first, last = best_run(scores)
        ends = [page.runs[k][1] for k in range(first, last + 1) if page.runs[k] and page.kinds[k] == _WORD and page.amounts[k]]
        if not ends:
            return ""
        first, last = self._content(page, scores, first, last, ends)
        blocks: list[str] = []
        parts: list[str] = []
        breaks = set(page.breaks)
        for k in range(first, last + 1):
            if k in breaks and parts:
                blocks.append("".join(parts))
                parts = []
            if (run := page.runs[k]) and not run[1][2]:
                parts.append(run[0])
        blocks.append("".join(parts))
        clean = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)

    @staticmethod
    def _content(page: Page, scores: np.ndarray, first: int, last: int, ends: list[list]) -> tuple[int, int]:
        """First and last token of the content around the best run: an article or main at or above the nearest element around the
        run; else its nearest container if that scores nine tenths of the run or more; else the run's whole blocks."""
        chain, e = [], ends[0]
        while e is not None:
            chain.append(e)
            e = e[0]
        place = {id(x): k for k, x in enumerate(chain)}
        top, seen = 0, set()
        for e in ends[1:]:
            while id(e) not in place and id(e) not in seen:
                seen.add(id(e))
                e = e[0]
            top = max(top, place.get(id(e), 0))
        box = next((e for e in chain[top:] if e[1] in ("article", "main")), None)
        near = box or next((e for e in chain[top:] if e[1] in CONTAINERS), chain[-1])
        within: dict[int, bool] = {id(near): True}

        def held(e: list | None) -> bool:
            path = []
            while e is not None and id(e) not in within:
                path.append(e)
                e = e[0]
            found = e is not None and within[id(e)]
            within.update((id(x), found) for x in path)
            return found

        spots = [k for k, run in enumerate(page.runs) if run and held(run[1])]
        if box is not None or scores[spots[0] : spots[-1] + 1].sum() >= 0.9 * scores[first : last + 1].sum():
            return spots[0], spots[-1]
        edges = np.asarray([0, *page.breaks, len(page.runs)])
        return int(edges[np.searchsorted(edges, first, side="right") - 1]), int(edges[np.searchsorted(edges, last, side="right")]) - 1


def default_extractor() -> Extractor:
    return Extractor(fit_weights(labelled_pages()))


def extract_pages(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    extractor = Extractor(fit_weights(labelled or labelled_pages()))

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extractor.text(x) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.selectExpr("cast(page_id as long) as page_id", "url", "html"), "page_id long, url string, text string, n_chars long", rows)
