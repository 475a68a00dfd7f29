"""Text functions: Columns where the engine has the words for it, Arrow-batched Python where it has not."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


#: Characters whose upper case has several characters, and the one character that stands for them in single mappings: often themselves.
_LONG_UPPER = "".join(c for c in map(chr, range(0x80, 0xD800)) if len(c.upper()) > 1) + "".join(c for c in map(chr, range(0xE000, 0x10000)) if len(c.upper()) > 1)
_SHORT_UPPER = "".join("\u1e9e" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _LONG_UPPER)


def upper_each(text: Column) -> Column:
    """Upper case by single mappings: every character stays one, as in SQL engines that don't make SS of ß."""
    each = F.transform(F.split(text, ""), lambda c: F.when(F.lit(_LONG_UPPER).contains(c), F.translate(c, _LONG_UPPER, _SHORT_UPPER)).otherwise(F.upper(c)))
    return F.when(text.rlike(f"[{_LONG_UPPER}]"), F.array_join(each, "")).otherwise(F.upper(text))


def to_number(text: Column) -> Column:
    """A finite number, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def skeleton(text: Column) -> Column:
    """What an excerpt is compared by: letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, "[^\\p{L}\\p{Nd}]+", ""))


def valid_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(url.rlike("^https?://[^/?#\\s]+"), F.lit(False))


def repair_mojibake(text: str | None) -> str | None:
    """UTF-8 that was read as Windows-1252, put right; left alone where that can't be undone or makes it no better."""
    if not text or not re.search("[ÃÂâäåæçèé][\x80-\xff€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]", text):
        return text
    try:
        fixed = b"".join(c.encode("cp1252") if not 0x80 <= ord(c) <= 0x9F else bytes([ord(c)]) for c in text).decode("utf-8")
    except UnicodeError:
        return text
    return fixed if len(fixed) < len(text) else text


_MARKER, _IMAGE = re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"!\[[^\]]*\]\([^)]*\)")


def normal_body(text: str | None) -> str:
    """NFC without comments, images and white space, as accuracy is counted on."""
    return re.sub(r"\s+", "", _IMAGE.sub("", _MARKER.sub("", unicodedata.normalize("NFC", text or ""))))


def composed(text: str | None) -> str | None:
    """NFC: letters and their marks as one character where there is one."""
    return None if text is None else unicodedata.normalize("NFC", text)


def canonical_hash(text: str | None) -> str | None:
    """SHA-256 of a JSON text in canonical form: keys sorted at every level, no white space, non-ASCII letters as they are."""
    return None if text is None else hashlib.sha256(json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _window_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers modulo 2**64, from which any window's hash is a difference."""
    base = 0x9E3779B97F4A7C15
    powers, sums, h, p = [1], [0], 0, 1
    for c in text:
        h, p = (h * base + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF, p * base & 0xFFFFFFFFFFFFFFFF
        sums.append(h)
        powers.append(p)
    return np.array(sums, np.uint64), np.array(powers, np.uint64)


def _equal_after(a: str, i: int, b: str, j: int, room: int) -> int:
    """How many characters from ``a[i]`` and ``b[j]`` on are equal, up to ``room``."""
    at, step = i, 16
    while room > 0:
        step = min(step, room)
        if a[at : at + step] == b[j + at - i : j + at - i + step]:
            at, room, step = at + step, room - step, 2 * step
        else:  # the first difference is among these
            room, step = step - 1, (step + 1) // 2
    return at - i


def _equal_before(a: str, i: int, b: str, j: int, room: int) -> int:
    """How many characters before ``a[i]`` and ``b[j]`` are equal, up to ``room``."""
    at, step = i, 16
    while room > 0:
        step = min(step, room)
        if a[at - step : at] == b[j + at - i - step : j + at - i]:
            at, room, step = at - step, room - step, 2 * step
        else:
            room, step = step - 1, (step + 1) // 2
    return i - at


class _Runs:
    """Longest common runs of parts of two texts.

    A run of 2s - 1 characters or more holds one of b's blocks of s characters that follow each other, whatever its place: each block is
    looked up in a, and each place found grows over its equal neighbours. Blocks begin long, as long as the caller's bound allows, and
    become shorter until the runs found are as long as they ask. Where blocks repeat so often that this costs more than hashes of all
    windows, the length is found by binary search over these, and runs are compared before they count. The results are the same.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b
        self.hashes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def longest(self, x: int, y: int, u: int, v: int, most: int) -> tuple[int, list[tuple[int, int]]]:
        """The length of the longest runs of ``a[x:y]`` and ``b[u:v]``, which is ``most`` or less, and their places: the leftmost in a, then
        in b, and from its end on again, as long as there is one of this length."""
        a, b = self.a, self.b
        best, found, size = 0, [], (most + 1) // 2
        left = 8 * (y - x + v - u) + 8000  # of the cost of a short look-up, and what the hashes cost
        while size:
            asked, q, back = size, u, 0
            while q + size <= v:
                block = b[q : q + size]
                p = a.find(block, x, y)
                left -= 1 + (y - x >> 10)
                while p >= 0:
                    before = _equal_before(a, p, b, q, min(p - x, back))  # a run from further back was found at the block before
                    after = _equal_after(a, p + size, b, q + size, min(y - p, v - q) - size)
                    left -= 40 + (before + after >> 10)
                    if (n := before + size + after) > best:
                        best, found = n, []
                    if n == best:
                        found.append((p - before, q - before))
                    p = a.find(block, p + 1, y) if left > 0 else -1
                if left <= 0:
                    return self._hashed(x, y, u, v, best, most)
                q, back = q + size, size
                size = max(size, (best + 1) // 2)
            if best >= 2 * asked - 1:
                break
            size = (best + 1) // 2 if best else asked // 2
        places = []
        for i, j in sorted(found):
            if i >= x and j >= u:
                places.append((i, j))
                x, u = i + best, j + best
        return best, places

    def _hashed(self, x: int, y: int, u: int, v: int, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
        """The same by binary search over the length, from ``low`` (there is such a run, or it is 0) to ``high``."""
        a, b = self.a, self.b
        if self.hashes is None:
            (ha, pa), (hb, pb) = _window_hashes(a), _window_hashes(b)
            self.hashes = ha, hb, pa if len(pa) >= len(pb) else pb
        ha, hb, power = self.hashes

        def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
            return ha[x + n : y + 1] - ha[x : y - n + 1] * power[n], hb[u + n : v + 1] - hb[u : v - n + 1] * power[n]

        while low < high:
            n = (low + high + 1) // 2
            if any(b.find(a[x + i : x + i + n], u, v) >= 0 for i in np.flatnonzero(np.isin(*windows(n))).tolist()):
                low = n
            else:
                high = n - 1
        places: list[tuple[int, int]] = []
        if not low:
            return 0, places
        left, right = windows(low)
        order = np.argsort(right, kind="stable")  # equal windows of b from left to right
        at = np.flatnonzero(np.isin(left, right))
        first, last = (np.searchsorted(right[order], left[at], side).tolist() for side in ("left", "right"))
        i = j = 0  # where the next run may begin, as the places in ``at`` and ``order`` from x and u on
        for k, p in enumerate(at.tolist()):
            if p >= i:
                same = order[first[k] : last[k]]
                for q in map(int, same[np.searchsorted(same, j) :]):
                    if a[x + p : x + p + low] == b[u + q : u + q + low]:
                        places.append((x + p, u + q))
                        i, j = p + low, q + low
                        break
        return low, places


def matched_chars(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common run (leftmost in a, then in b), then the same on both sides of it.

    To the right of a run, which has none that is longer, the next one as long is known already; so that each step inward has shorter runs.
    """
    runs = _Runs(a, b)
    total, todo = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    while todo:
        x, y, u, v, most = todo.pop()
        if x == y or u == v:
            continue
        if (b.find(a[x:y], u, v) if y - x <= v - u else a.find(b[u:v], x, y)) >= 0:  # one side is all in the other
            total += min(y - x, v - u)
            continue
        n, places = runs.longest(x, y, u, v, min(most, y - x, v - u))
        for i, j in places:
            total += n
            todo.append((x, i, u, j, n - 1))
            x, u = i + n, j + n
        if n > 1:
            todo.append((x, y, u, v, n - 1))
    return total


#: Runs of infrequent characters up to this length are searched by the strings in them.
RARE_RUN = 64


def matched_from_rare(a: str, b: str) -> int:
    """Characters in the matching blocks of ``difflib`` with its rule for frequent characters: a match begins at the longest run
    of infrequent ones (leftmost in a, then in b) and grows over any equal neighbours; then the same on both sides of it.

    Strings of infrequent characters are listed once for each length, and a side never has a longer one than the whole or, on the
    left, one as long: each place is looked up once a length, so that long texts stay near-linear.
    """
    counts = Counter(b)
    rare = {c for c, n in counts.items() if len(b) < 200 or n <= len(b) // 100 + 1}
    runs = re.compile("[" + "".join(map(re.escape, sorted(rare))) + "]+") if rare else re.compile("(?!)")
    spans = [[m.span() for m in runs.finditer(t)] for t in (a, b)]
    longest = [max((z - x for x, z in s), default=0) for s in spans]
    if max(longest) > RARE_RUN:
        return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=True).get_matching_blocks())
    starts: dict[int, list[int]] = {}
    places: dict[int, dict[str, list[int]]] = {}
    for n in range(1, min(longest) + 1):
        starts[n] = [i for x, z in spans[0] for i in range(x, z - n + 1)]
        places[n] = {}
        for x, z in spans[1]:
            for j in range(x, z - n + 1):
                places[n].setdefault(b[j : j + n], []).append(j)

    def found(x: int, y: int, u: int, v: int, n: int) -> tuple[int, int, int]:
        for n in range(n, 0, -1):
            at, held = starts[n], places[n]
            for k in range(bisect_left(at, x), len(at)):
                i = at[k]
                if i + n > y:
                    break
                where = held.get(a[i : i + n])
                if where and (p := bisect_left(where, u)) < len(where) and where[p] + n <= v:
                    return i, where[p], n
        return x, u, 0

    total, todo = 0, [(0, len(a), 0, len(b), min(longest))]
    while todo:
        x, y, u, v, n = todo.pop()
        i, j, n = found(x, y, u, v, n)
        p, q = i + n, j + n
        while n and i > x and j > u and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while p < y and q < v and a[p] == b[q]:
            p, q = p + 1, q + 1
        if p > i:
            total += p - i
            if x < i and u < j:
                todo.append((x, i, u, j, max(n - 1, 0)))
            if p < y and q < v:
                todo.append((p, y, q, v, n))
    return total


def fidelity(source: str, output: str) -> tuple[float, float]:
    """(recall, precision) of the characters that matching blocks share, every character of texts of any size; a contained source counts whole."""
    if not source:
        return 1.0, 1.0 if not output else 0.0
    if not output:
        return 0.0, 0.0
    if source in output:
        matched = len(source)
    else:
        matched = matched_chars(source, output)
    return matched / len(source), matched / len(output)


def best_candidate(source: str, outputs: list[str]) -> int:
    """The candidate with the best weaker side, then F1, recall and precision."""

    def rank(o: str) -> tuple:
        r, p = fidelity(source, o)
        return min(r, p), 2 * r * p / (r + p) if r + p else 0.0, r, p

    return max(range(len(outputs)), key=lambda i: (*rank(outputs[i]), -i))


def _within(short: str, long: str) -> bool:
    """Whether ``long`` holds the characters of ``short`` in their order."""
    at = 0
    for c in short:
        at = long.find(c, at) + 1
        if not at:
            return False
    return True


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance over code points, by Myers' bit vectors in whole integers.

    Where one text is the other with characters left out, their lengths' difference is the distance: no fewer edits can do.
    """
    if not a or not b:
        return len(a) + len(b)
    if _within(a, b) if len(a) < len(b) else _within(b, a):
        return abs(len(a) - len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        across = ((eq & up) + up ^ up) | eq | down
        plus, minus = down | ~(across | up) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~((eq | down) | plus) & full, plus & (eq | down)
    return score


class _Tables(HTMLParser):
    """Tables of a page as rows of (text, rowspan, colspan)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            a = dict(attrs)
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = ["", _span(a.get("rowspan")), _span(a.get("colspan"))]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table":
            self.depth = max(0, self.depth - 1)

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0] += data

    def _close(self) -> None:
        if self.cell is not None and self.depth == 1:
            self.tables[-1][-1].append((" ".join(self.cell[0].split()), self.cell[1], self.cell[2]))
            self.cell = None


def _span(value: str | None) -> int:
    return min(1000, max(1, int(value))) if value and value.strip().isdigit() else 1


def table_grids(source: str | None) -> list[list[list[str]]]:
    """Every table of a page as a full grid: spanning cells repeat in all places that they cover."""
    parser = _Tables()
    parser.feed(source or "")
    parser.close()
    out = []
    for rows in parser.tables:
        grid: dict[tuple[int, int], str] = {}
        for r, cells in enumerate(rows):
            c = 0
            for text, down, across in cells:
                while (r, c) in grid:
                    c += 1
                for dr in range(min(down, len(rows) - r)):
                    for dc in range(across):
                        grid[r + dr, c + dc] = text
                c += across
        width = 1 + max((c for _, c in grid), default=-1)
        out.append([[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))])
    return out


def flat_headers(rows: list[list[str]]) -> list[str]:
    """Header rows joined column by column by ' / ', without repeats; empty columns are numbered."""
    return [" / ".join(dict.fromkeys(x for x in column if x)) or f"列{n}" for n, column in enumerate(zip(*rows, strict=True), 1)]


def records(grid: list[list[str]], headers: int = 1) -> list[str]:
    """Rows below the headers as 'name: value' lines."""
    names = flat_headers(grid[:headers])
    return ["; ".join(f"{n}: {v}" for n, v in zip(names, row, strict=True) if v) for row in grid[headers:]]


def series(function):
    """A pandas UDF over one text column from a plain function of one text."""

    def over(kind: str):
        @F.pandas_udf(kind)
        def apply(texts: pd.Series) -> pd.Series:
            return texts.map(function)

        return apply

    return over


def edits():
    """A pandas UDF over two text columns: their edit distance, null as the empty text."""

    @F.pandas_udf("int")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edit_distance(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")

    return apply
