"""Markdown: typed elements with line spans, heading trails, coarse chunks and semantic segments, all per document."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

KINDS = ("front_matter", "horizontal_rule", "heading", "code_block", "math_block", "table", "list", "block_quote", "image", "html", "paragraph")
SOFT_MIN, TARGET, HARD_MAX, WINDOW_TOKENS = 128, 512, 1024, 128
_HEADING, _FENCE = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"\s{0,3}(```+|~~~+)")
_RULE = re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*")
_LIST, _IMAGE = re.compile(r"\s{0,3}([-*+]|\d+[.)])\s+"), re.compile(r"\s*!\[[^\]]*\]\([^)]*\)\s*$")
_CHAPTER = (re.compile(r"第[一二三四五六七八九十百0-9]+[章节条编]"), re.compile(r"\d+(?:\.\d+)+\s"), re.compile(r"[一二三四五六七八九十]+、"), re.compile(r"(?i)(?:annex|appendix|附录)\s*[A-Z0-9]"))


@dataclass
class Element:
    kind: str
    start: int
    end: int
    text: str
    level: int = 0
    trail: list[str] = field(default_factory=list)


def tokens(text: str) -> int:
    """Estimated tokens: two for each character beyond ASCII, a quarter for any other."""
    wide = sum(ord(c) > 127 for c in text)
    return max(1, int(2 * wide + 0.25 * (len(text) - wide))) if text else 0


def elements(text: str | None) -> list[Element]:
    """Elements of a document in order; lines count from 1 and every line that isn't blank lies in exactly one element."""
    lines = (text or "").split("\n")
    out: list[Element] = []
    i, n = 0, len(lines)

    def add(kind: str, last: int, level: int = 0) -> None:
        nonlocal i
        out.append(Element(kind, i + 1, last + 1, "\n".join(lines[i : last + 1]), level))
        i = last + 1

    def until(test) -> int:
        j = i
        while j + 1 < n and test(lines[j + 1]):
            j += 1
        return j

    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif i == 0 and line.strip() == "---" and "---" in (x.strip() for x in lines[1:]):
            add("front_matter", next(j for j in range(1, n) if lines[j].strip() == "---"))
        elif _RULE.fullmatch(line):
            add("horizontal_rule", i)
        elif m := _HEADING.match(line):
            add("heading", i, len(m[1]))
        elif m := _FENCE.match(line):
            mark = m[1]
            add("code_block", next((j for j in range(i + 1, n) if lines[j].strip().startswith(mark)), n - 1))
        elif line.strip().startswith("$$"):
            closed = line.strip().endswith("$$") and len(line.strip()) > 3
            add("math_block", i if closed else next((j for j in range(i + 1, n) if lines[j].strip().endswith("$$")), n - 1))
        elif "|" in line and i + 1 < n and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*", lines[i + 1]) and "|" in lines[i + 1]:
            add("table", until(lambda x: "|" in x))
        elif _IMAGE.match(line):
            add("image", i)
        elif line.lstrip().startswith(">"):
            add("block_quote", until(lambda x: x.lstrip().startswith(">")))
        elif _LIST.match(line):
            add("list", until(lambda x: bool(_LIST.match(x)) or x.startswith("  ") and bool(x.strip())))
        elif re.match(r"\s{0,3}<(?:[a-zA-Z/!])", line):
            add("html", until(lambda x: bool(x.strip())))
        else:
            add("paragraph", until(lambda x: bool(x.strip()) and not _RULE.fullmatch(x) and not _HEADING.match(x) and not _FENCE.match(x) and not _LIST.match(x) and not x.lstrip().startswith((">", "$$", "|"))))
    return trails(out)


def trails(found: list[Element]) -> list[Element]:
    """Each element with the titles of the headings above it; a heading's own trail ends with itself."""
    stack: list[tuple[int, str]] = []
    for e in found:
        if e.kind == "heading":
            while stack and stack[-1][0] >= e.level:
                stack.pop()
            stack.append((e.level, _HEADING.match(e.text)[2]))
        e.trail = [t for _, t in stack]
    return found


def structural_boundary(line: str) -> int:
    """The kind (from 1) of numbered clause or appendix that a line opens; 0 for none."""
    return next((k for k, p in enumerate(_CHAPTER, 1) if p.match(line.strip())), 0)


def coarse_chunks(found: list[Element], soft_min: int = SOFT_MIN) -> list[tuple[int, int, str]]:
    """(start, end, text): elements gathered up to the next heading or clause once they reach the soft minimum.

    Headings go with what follows them; a tail of headings alone joins the chunk before it.
    """
    out: list[list[Element]] = []
    held: list[Element] = []
    for e in found:
        opens = e.kind == "heading" or e.kind == "paragraph" and structural_boundary(e.text) > 0
        if opens and held and any(x.kind != "heading" for x in held) and sum(tokens(x.text) for x in held) >= soft_min:
            out.append(held)
            held = []
        held.append(e)
    if held:
        if out and all(x.kind == "heading" for x in held):
            out[-1] += held
        else:
            out.append(held)
    return [(c[0].start, c[-1].end, "\n\n".join(x.text for x in c)) for c in out]


def atoms(text: str, most: int = TARGET) -> list[str]:
    """Lossless pieces: lines, then sentences, then cuts of at most ``most`` tokens."""
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        for s in re.findall(r".+?(?:[.!?。！？；]+\s*|$)", line, re.DOTALL) if tokens(line) > most else [line]:
            while tokens(s) > most:
                cut = max(1, len(s) * most // (tokens(s) + 1))
                out.append(s[:cut])
                s = s[cut:]
            out.append(s)
    return [s for s in out if s]


def stub_vector(text: str, size: int = 32) -> list[float]:
    """A deterministic stand-in for an embedding: counts of hashed words."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower()):
        h = 0
        for c in w:
            h = (h * 31 + ord(c)) % 1_000_003
        v[h % size] += 1.0
    return v


def cosine(a: list[float], b: list[float]) -> float:
    d = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / d if d else 0.0


def cohesion(vectors: list[list[float]], sizes: list[int], window: int = WINDOW_TOKENS) -> list[float]:
    """For every gap, the cosine of the mean vectors of both sides; a side grows until it has ``window`` tokens and a vector."""

    def side(places: range) -> list[float]:
        got, total = [], 0
        for k in places:
            got.append(vectors[k])
            total += sizes[k]
            if total >= window:
                break
        return [sum(c) / len(got) for c in zip(*got, strict=True)]

    return [cosine(side(range(g - 1, -1, -1)), side(range(g, len(vectors)))) for g in range(1, len(vectors))]


def depths(c: list[float]) -> list[float]:
    """Valley depth of every gap: how far the peaks on both sides, climbed without a fall, rise above it."""
    out = []
    for i, x in enumerate(c):
        peaks = []
        for step in (-1, 1):
            j = i
            while 0 <= j + step < len(c) and c[j + step] >= c[j]:
                j += step
            peaks.append(c[j])
        out.append(peaks[0] - x + peaks[1] - x)
    return out


def segments(text: str, target: int = TARGET, hard_max: int = HARD_MAX, vector=stub_vector) -> list[str]:
    """Pieces filled to ``target`` tokens and cut at the deepest gap inside; fragments join a neighbour, none passes ``hard_max``."""
    parts = atoms(text, target)
    if not parts:
        return []
    sizes = [tokens(p) for p in parts]
    depth = depths(cohesion([vector(p) for p in parts], sizes)) if len(parts) > 1 else []
    out: list[list[int]] = []
    at = 0
    while at < len(parts):
        end, total = at, 0
        while end < len(parts) and (end == at or total + sizes[end] <= target):
            total += sizes[end]
            end += 1
        if end < len(parts):
            gaps = range(at + 1, end + 1)
            end = max(gaps, key=lambda g: (round(depth[g - 1], 12), g))
        out.append(list(range(at, end)))
        at = end
    merged: list[list[int]] = []
    for s in out:
        small = sum(sizes[k] for k in s) < target // 8
        if merged and small and sum(sizes[k] for k in merged[-1] + s) <= hard_max:
            merged[-1] += s
        else:
            merged.append(s)
    return ["".join(parts[k] for k in s) for s in merged]
