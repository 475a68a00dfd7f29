"""URL filters: host word segmentation by a unigram Viterbi, then multinomial naive Bayes over host and path tokens.

``Segmenter`` splits names that are written together into the likeliest words; ``NaiveBayes`` scores the words of the
host and the path; ``Rules`` are host and path prefixes, the longest of which overrides the score.

The unigrams are counted over the running text of all pages (``corpus_counts``), of which the LEXICON_WORDS most frequent words are
kept, with the words of the labelled examples below. The classifier is fitted on those examples, whose number is fixed. Unknown
words say nothing, so that a host without a known word follows the prior: allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed; a URL of any length
is split whole; of two rules that are equally long the first wins, and of two equally likely splits the one whose last word
begins first; repeated rows, and rows without an id, have a row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map

#: Labelled examples, written for this module: hosts and paths of unwanted and of ordinary sites.
BLOCKED_EXAMPLES = """
cheap-pills.example/buy cheappills.example/offer pharmacy-pills-online.example/cheap/viagra discount-pills.example/rx
buypillsonline.example/no-prescription best-casino.example/bonus casino-bets.example/play online-casino-bonus.example/free/spins
freebets.example/bet free-bets.example/win sportsbets.example/odds/bonus bets-win.example/jackpot winbigjackpot.example/casino
spam-farm.example/links spamfarm.example/links/page linkfarm.example/seo link-spam.example/backlinks seo-backlinks-farm.example/buy
adult-cams.example/live freeporn.example/videos sexchat.example/adult xxx-videos.example/free hotsinglesnearyou.example/dating/adult
fast-loans.example/payday paydayloans.example/apply cheap-loans-now.example/credit get-rich-quick.example/money cryptodoubler.example/win
free-prizes.example/win/iphone luckywinner.example/prize claim-your-prize.example/free malware-download.example/crack crackedsoftware.example/keygen
warez-downloads.example/torrent free-keygen.example/crack fakewatches.example/replica cheap-replica-watches.example/sale weight-loss-miracle.example/pills
ad-tracker.example/pixel ads-server.example/track/click banner-ads.example/track trackads.example/pixel/click best-ads-network.example/track
click-bait-ads.example/click popupads.example/adclick doorway-pages.example/spam scamdeals.example/win phishing-login.example/verify/account
""".split()
ALLOWED_EXAMPLES = """
www.weather.example/forecast/today blog.garden-notes.example/2019/spring news.citypaper.example/politics/article library.university.example/catalog
docs.software-project.example/guide/install www.cookbook.example/recipes/soup history-museum.example/exhibits/roman m.sportsnews.example/football/results
www.railwaytimes.example/timetable en.encyclopedia.example/wiki/physics travelguide.example/italy/rome blog.startup.example/about/team
shop.bookstore.example/item/novel school.district.example/calendar www.healthservice.example/conditions/flu science-journal.example/issue/paper
forum.photography.example/thread/lens www.musicschool.example/lessons/piano town-council.example/meetings/minutes birdwatchers.example/species/robin
www.openstreet.example/map/view code.repository.example/project/source maths-help.example/algebra/lesson m.localradio.example/program/morning
www.nationalpark.example/trails/map film-review.example/archive/drama blog.knitting.example/pattern/scarf housing-association.example/rent/info
www.bakery.example/menu/bread gardenplants.example/roses/care de.woerterbuch.example/wort fr.journal.example/article/culture es.noticias.example/mundo
www.government.example/forms/tax farm-museum.example/visit the-daily-paper.example/opinion/letters freesoftware.example/download/source www.cheap-travel-tips.example/trains
machine-learning.example/tutorial/python better-homes.example/garden learn-python.example/course/lists race-track.example/results/season
the.example/en/page blog.example/de/index m.example/fr/index www.example/es/index online-courses.example/lessons/history credit-union.example/branches
""".split()
#: Other frequent words, with the examples' words the whole lexicon of the segmenter.
COMMON_WORDS = "the of and to in is that for with on as at by from it this are be an or was not you all can has have new more one about home our out up what who how when where your my we world web site online page info net data time day year life best good top free book food art work team city land water health home house".split()
#: (rule, verdict); the part before the first slash is the host.
DEFAULT_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Parts of a name that only say where a site is, not what it holds.
PLACES = frozenset("www m blog com net org example en de fr es html".split())

#: Words of the pages' texts that the segmenter knows: the most frequent, ties by the word.
LEXICON_WORDS = 20_000

_TOKEN = re.compile(r"[a-z]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path, as the module's text defines them; only A-Z of the host is lower-cased."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


class Rules:
    """Host and path-prefix rules; the longest that fits wins, the earlier one among equals."""

    def __init__(self, rules: tuple[tuple[str, str], ...]) -> None:
        self.rules = [(r, *r.partition("/")[::2], v) for r, v in rules]
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for r, host, path, v in self.rules:
            self.by_host.setdefault(host, []).append((r, "/" + path, v))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        name = host
        while True:
            for rule, prefix, verdict in self.by_host.get(name, ()):
                if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            _, dot, name = name.partition(".")
            if not dot:
                return best


#: Cost of each letter of an unknown word: a tenth of the probability.
UNKNOWN_LETTER = math.log(10)


class Segmenter:
    """The likeliest words of a run of letters under independent word probabilities.

    An unknown word of n letters has the probability 1 / (total * 10 ** n), so that known words win over longer unknown
    ones and one unknown word over two.
    """

    def __init__(self, counts: Counter) -> None:
        total = sum(counts.values())
        self.cost = {w: math.log(total / c) for w, c in counts.items()}
        self.base, self.longest = math.log(total), max(map(len, counts), default=1)

    def price(self, word: str) -> float:
        return self.cost.get(word, self.base + UNKNOWN_LETTER * len(word))

    def split(self, run: str) -> list[str]:
        """Viterbi over the cut positions. A word ends at a position as a known one, or as an unknown one that began anywhere: the
        cheapest such beginning is carried along, so that a run of any length takes linear time."""
        best, back = [0.0], [0]
        unknown, begun = math.inf, 0  # cheapest unknown word so far, not ended
        for z in range(1, len(run) + 1):
            if best[z - 1] + self.base < unknown:
                unknown, begun = best[z - 1] + self.base, z - 1
            unknown += UNKNOWN_LETTER
            known = min(((best[a] + c, a) for a in range(max(0, z - self.longest), z) if (c := self.cost.get(run[a:z])) is not None), default=(math.inf, 0))
            cost, a = min(known, (unknown, begun))
            best.append(cost)
            back.append(a)
        out, z = [], len(run)
        while z:
            out.append(run[back[z] : z])
            z = back[z]
        return out[::-1]


#: Share of URLs taken to be unwanted before their words are seen: one unwanted word in an otherwise unknown URL isn't enough.
BLOCK_PRIOR = 0.08


class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing over words known from the examples."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], block_prior: float = BLOCK_PRIOR) -> None:
        b, a = Counter(w for x in blocked for w in x), Counter(w for x in allowed for w in x)
        words = set(b) | set(a)
        nb, na = sum(b.values()) + len(words), sum(a.values()) + len(words)
        self.weight = {w: math.log((b[w] + 1) / nb) - math.log((a[w] + 1) / na) for w in words}
        self.start = math.log(block_prior / (1 - block_prior))

    def score(self, words: list[str]) -> float:
        """Log odds of being blocked."""
        return self.start + sum(self.weight.get(w, 0.0) for w in words)


class UrlJudge:
    """Everything that judging a URL takes, fitted on the examples."""

    def __init__(self, rules: tuple[tuple[str, str], ...] = DEFAULT_RULES, blocked: list[str] | None = None, allowed: list[str] | None = None, counts: dict[str, int] | None = None) -> None:
        blocked, allowed = blocked or BLOCKED_EXAMPLES, allowed or ALLOWED_EXAMPLES
        self.rules = Rules(rules)
        plain = [w for u in [*blocked, *allowed] for w in _TOKEN.findall(u) if w not in PLACES]
        seeds = Counter({w: 20 for w in COMMON_WORDS})
        # names written together are not words: those that others can be put together to are split by the rest
        short = Counter(w for w in plain if len(w) <= 9)
        first = Segmenter(seeds + short)
        known = set(seeds) | set(short)
        whole = Counter()
        for w in plain:
            own = first.cost.pop(w, None)
            others = first.split(w) if len(w) > 5 else [w]
            if own is not None:
                first.cost[w] = own
            whole.update(others if len(others) > 1 and all(x in known and len(x) > 2 for x in others) else [w])
        mean = sum(counts.values()) / len(counts) if counts else 1
        known = Counter({w: math.ceil(c * max(1.0, mean)) for w, c in (seeds + whole).items()})  # examples weigh as frequent words do
        self.segmenter = Segmenter(known + Counter({w: c for w, c in (counts or {}).items() if w not in PLACES}))
        self.host_words = lru_cache(100_000)(self._host_words)
        self.model = NaiveBayes(*([self.words(*parts("x://" + u)) for u in us] for us in (blocked, allowed)))

    def _host_words(self, host: str) -> list[str]:
        return [w for run in _TOKEN.findall(host) if run not in PLACES for w in self.segmenter.split(run)]

    def words(self, host: str, path: str) -> list[str]:
        runs = _TOKEN.findall(path.translate(_FOLD))
        return [*self.host_words(host), *(w for run in runs if run not in PLACES for w in self.segmenter.split(run))]

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, float, str]:
        """host, path, rule, verdict, score and the words, joined by spaces."""
        host, path = parts(url)
        rule, verdict = self.rules.find(host, path)
        words = self.words(host, path)
        score = self.model.score(words)
        return host, path, rule, verdict or ("block" if score > 0 else "allow"), score, " ".join(words)


def corpus_counts(pages: DataFrame, most: int = LEXICON_WORDS) -> dict[str, int]:
    """How often the ``most`` most frequent words (a-z, three letters or more, A-Z folded) stand in the texts of all pages, counted over
    the whole table; words are combined before the shuffle."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})[a-z]{3,24}(?!\p{L})"), 0)).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return {r.word: r.n for r in top.collect()}  # at most `most` rows


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = DEFAULT_RULES, counts: dict[str, int] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score and words of every row of ``pages``; ``counts`` are the segmenter's unigrams."""
    made: list[UrlJudge] = []

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(UrlJudge(rules, counts=counts))
        columns = zip(*map(made[0].judge, b.column(1).to_pylist()), strict=True)
        kinds = [pa.string()] * 4 + [pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "score", "words"])

    return arrow_map(pages.selectExpr("cast(page_id as long) as page_id", "url"), "page_id long, host string, path string, rule string, verdict string, score double, words string", rows)
