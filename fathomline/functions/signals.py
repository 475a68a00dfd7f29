"""What a page's Markdown holds: tables as canonical matrices, images, picture descriptions, formulas by their tokens; and its effective text.

Code never counts. A formula that isn't closed hides the rest of its page from the search for plain equations, so that no
part of it passes for one.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from html import unescape

from fathomline.functions.htmlcells import table_cells

#: Letters and digits that a picture's description needs to count as one.
DESCRIPTION_CHARS = 8

# Spellings of operators, signs that effective text keeps, what a formula's tokens are.
OPERATORS = {"times": "×", "cdot": "×", "div": "÷", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "pm": "±"}
SYMBOLS = OPERATORS | {"sum": "∑", "int": "∫", "sqrt": "√"}
KEPT = frozenset("=≈≠≤≥±×÷∑∫√+-*/^%")
TOKEN = re.compile(r"\(\d+(?:[.\-]\d+)*\)|[A-Za-z]+(?:[_^](?:\{?[A-Za-z0-9]+\}?))?|\d+(?:\.\d+)?|[=≈≠≤≥±×÷∑∫√+\-*/^_()]")
SAME = {"*": "×", "/": "÷"}
#: Commands that only space or size a formula.
_LAYOUT = re.compile(r"\\(?:left|right|displaystyle|textstyle|quad|qquad|limits)(?![A-Za-z])|\\[,;:!]")
_COMMAND = re.compile(r"\\([A-Za-z]+)")

_COMMENT, _TAG = re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"</?[A-Za-z][^>]*>")
_IMAGE, _NAMED_IMAGE, _HTML_IMAGE = re.compile(r"!\[[^\]\r\n]*\]\(([^)\r\n]*)\)"), re.compile(r"!\[([^\]\r\n]*)\]\s*\[([^\]\r\n]*)\]"), re.compile(r"<img\b[^>]*>", re.IGNORECASE)
_DEFINED = re.compile(r"^[\t ]{0,3}\[([^\]\r\n]+)\]:[\t ]*(\S+)[^\r\n]*$", re.MULTILINE)
_LINK, _NAMED_LINK = re.compile(r"(?<!!)\[([^\]\r\n]*)\]\([^)\r\n]+\)"), re.compile(r"(?<!!)\[([^\]\r\n]+)\]\s*\[[^\]\r\n]*\]")
#: What leaves a text before its letters are counted, in this order, and characters of which a text needs one for it; links leave their labels.
_MARKUP = (
    (_COMMENT, "", "<"), (re.compile(r"<(script|style|noscript)\b[^>]*>.*?</\1\s*>", re.IGNORECASE | re.DOTALL), "", "<"), (_HTML_IMAGE, "", "<"), (_IMAGE, "", "["), (_NAMED_IMAGE, "", "["), (_DEFINED, "", "["),
    (_LINK, r"\1", "["), (_NAMED_LINK, r"\1", "["), (_TAG, "", "<"),
    (re.compile(r"^[\t ]*\|?[\t ]*:?-{3,}:?(?:[\t ]*\|[\t ]*:?-{3,}:?)+[\t ]*\|?[\t ]*$", re.MULTILINE), "", "|"), (re.compile(r"^[\t ]{0,3}(?:([*_-])[\t ]*)(?:\1[\t ]*){2,}$", re.MULTILINE), "", "*_-"),
    (re.compile(r"^[\t ]{0,3}(?:#{1,6}[\t ]+|>[\t ]?|[-+*][\t ]+|\d+[.)][\t ]+)", re.MULTILINE), "", "#>-+*.)"), (re.compile(r"(?<!\w)(?:\*{1,3}|_{1,3})(?=\w)|(?<=\w)(?:\*{1,3}|_{1,3})(?!\w)"), "", "*_"), (re.compile("`|~~"), "", "`~"),
)


class _Folded(dict):
    """What a character counts as: folded if it is a letter, digit or kept sign, nothing (None) otherwise; found once each."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = unicodedata.normalize("NFKC", c).casefold() if c.isalnum() or c in KEPT else None
        return self[code]


_FOLDED = _Folded()


def effective_text(text: str | None) -> str:
    """Letters, digits and signs of value that a reader sees, folded: markup, images, link targets and table rules are gone, and operators spelt alike."""
    text = text or ""
    for pattern, new, marks in _MARKUP:
        if any(c in text for c in marks):
            text = pattern.sub(new, text)
    plain = unescape(text)
    if "\\" in plain:
        plain = _COMMAND.sub(lambda m: OPERATORS.get(m[1], m[0]), plain)
    plain = plain.replace("·", "×").replace("*", "×")
    return plain.translate(_FOLDED)


def formula_signature(formula: str | None) -> list[str]:
    """Variables with their indexes, numbers, operators and the formula's number, in order.

    Spellings of an operator count as one, and so do layout commands, braces and fonts; prose around a formula doesn't count.
    """
    text = unicodedata.normalize("NFKC", unescape(formula or ""))
    text = re.sub(r"\\tag\s*\{\s*([^{}]+)\s*\}", r"(\1)", text)
    text = re.sub(r"\\(?:mathrm|mathbf|text|operatorname)\s*\{([^{}]*)\}", r"\1", _LAYOUT.sub(" ", text))
    text = _TAG.sub("", _COMMAND.sub(lambda m: SYMBOLS.get(m[1], m[0]), text))
    text = re.sub(r"\(\s*(\d+(?:[.\-–]\d+)*)\s*\)", r"(\1)", text)
    tokens = (t.replace("{", "").replace("}", "") for t in TOKEN.findall(text))
    return [SAME.get(t, t) for t in tokens]


_FENCE = re.compile(r"^[\t ]{0,3}(`{3,}|~{3,})[^\r\n]*\r?\n(?:.*?^[\t ]{0,3}\1[\t ]*$|.*\Z)", re.MULTILINE | re.DOTALL)
_CODE = re.compile(r"(?<!`)`+[^`\r\n]*`+(?!`)")
_ENVIRONMENT = r"(?:equation\*?|align\*?|gather\*?|multline\*?)"
_DISPLAY = re.compile(rf"<math\b[^>]*>(.*?)</math>|\\begin\{{({_ENVIRONMENT})\}}(.*?)\\end\{{\2\}}|\$\$(.*?)\$\$|\\\[(.*?)\\\]|\\\((.*?)\\\)", re.IGNORECASE | re.DOTALL)
_INLINE = re.compile(r"(?<!\$)\$(?!\$)([^$\r\n]+?)\$(?!\$)")
_BROKEN = re.compile(rf"(?:<math\b[^>]*>|\\begin\{{{_ENVIRONMENT}\}}|\$\$|\\\[|\\\().*\Z", re.IGNORECASE | re.DOTALL)
_CLOSING = re.compile(rf"^.*(?:</math\s*>|\\end\{{{_ENVIRONMENT}\}}).*$", re.IGNORECASE | re.MULTILINE)
_SAYS = re.compile(r"[A-Za-z0-9㐀-鿿]|[∑∫√∞π]")
_SIDE = re.compile(r"[A-Za-z0-9㐀-鿿_{}()[\]+\-*/×÷·.,%^\\]+")


def _inline(body: str) -> bool:
    """Not an amount of money: a command, an operator or an index is in it, or it is one letter."""
    body = "".join(body.split())
    return bool(body) and not re.fullmatch(r"[\d.,]+", body) and bool(re.search(r"\\[A-Za-z]+|[=^_{}+*/×÷≤≥∑∫√]", body) or re.fullmatch("[A-Za-z]", body))


def _equation(line: str) -> bool:
    """A plain line that equates two sides of formula characters, and shows by an operator, spaces or a short name that it means it."""
    line = line.strip()
    sides = "".join(line.split()).split("=")
    if len(sides) != 2 or not 3 <= len(sides[0]) + len(sides[1]) + 1 <= 200 or re.search(r"[<>\"'`:$]", line):
        return False
    return all(map(_SIDE.fullmatch, sides)) and bool(re.search(r"[_{}()[\]+\-*/×÷·%^\\]", "".join(sides)) or re.search(r"\s=\s", line) or re.fullmatch(r"[A-Za-z][A-Za-z0-9_]?", sides[0]))


def formulas(markdown: str) -> list[list[str]]:
    """Signatures of the formulas of a page without code: display forms, inline ones, then plain equations."""
    bodies = [next(x for x in (m[1], m[3], m[4], m[5], m[6]) if x is not None) for m in _DISPLAY.finditer(markdown)]
    bodies = [b for b in bodies if _SAYS.search(re.sub("<[^>]+>", " ", b))]
    rest = _DISPLAY.sub(" ", markdown)
    bodies += [m[1] for m in _INLINE.finditer(rest) if _inline(m[1])]
    rest = _CLOSING.sub(" ", _BROKEN.sub(" ", _INLINE.sub(" ", rest)))
    for pattern in (_COMMENT, _IMAGE, _NAMED_IMAGE, _LINK, re.compile("<[^>]+>"), _DEFINED):
        rest = pattern.sub(" ", rest)
    bodies += [line for line in rest.splitlines() if _equation(line)]
    return [s for s in map(formula_signature, bodies) if s]


def canonical_cell(value: str | None) -> str:
    """Visible text of a cell without markup, link targets and white space."""
    text = unescape(re.sub("<[^>]+>", " ", _LINK.sub(r"\1", _COMMENT.sub(" ", value or ""))))
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def _rectangle(rows: list[list[str]]) -> list[list[str]] | None:
    """Rows of canonical cells, if all have one length and something is in them."""
    return rows if rows and rows[0] and len(set(map(len, rows))) == 1 and any(map(any, rows)) else None


def pipe_row(line: str) -> list[str]:
    """Cells of a pipe table's row; pipes that are escaped or inside code part nothing."""
    line = line.strip()
    if "|" not in line:
        return []
    line = re.sub(r"\\.|(`+).*?\1(?!`)", lambda m: m[0].replace("|", "\0"), line)
    return [c.strip().replace("\0", "|") for c in line.removeprefix("|").removesuffix("|").split("|")]


def pipe_tables(markdown: str) -> list[list[list[str]]]:
    """Canonical matrices of pipe tables: a header over a rule and rows of the rule's width with something in them."""
    lines, found, k = markdown.splitlines(), [], 1
    while k < len(lines):
        rule = pipe_row(lines[k])
        if not rule or not all(re.fullmatch(r":?-{3,}:?", c) for c in rule):
            k += 1
            continue
        last = k + 1
        while last < len(lines) and "|" in lines[last]:
            last += 1
        rows = [pipe_row(lines[k - 1]), *map(pipe_row, lines[k + 1 : last])]
        if len(rows) > 1 and all(len(r) == len(rule) for r in rows) and any(c.isalnum() for r in rows[1:] for x in r for c in x):
            found.append(_rectangle([list(map(canonical_cell, r)) for r in rows]))
        k = last
    return [m for m in found if m]


def html_tables(markdown: str) -> list[list[list[str]]]:
    """Canonical matrices of outer HTML tables; a spanning cell's text stands at its first place, its other places are empty."""
    tables: dict[str, list] = {}
    for cell in table_cells(markdown):
        if cell.table.count("-") == 1:
            tables.setdefault(cell.table, []).append(cell)
    found = []
    for cells in tables.values():
        height = max(c.row for c in cells) + 1
        grid: dict[tuple[int, int], str] = {}
        for c in cells:
            spanned = [(c.row + r, c.column + k) for r in range(min(c.row_span, height - c.row)) for k in range(c.column_span)]
            grid |= dict.fromkeys((p for p in spanned if p not in grid), "") | {(c.row, c.column): canonical_cell(c.text)}
        widths = [1 + max((k for r, k in grid if r == row), default=-1) for row in range(height)]
        if any(not c.header and c.text for c in cells):
            found.append(_rectangle([[grid.get((r, k), "") for k in range(w)] for r, w in enumerate(widths)]))
    return [m for m in found if m]


def images(markdown: str) -> int:
    """References to images that lead somewhere: inline ones, ones by a defined name, and image elements with a source."""
    name = lambda x: " ".join(x.split()).casefold()
    defined = {name(m[1]) for m in _DEFINED.finditer(markdown) if m[2].strip("<>").strip()}
    inline = sum(bool(m[1].strip().removeprefix("<").removesuffix(">").strip()) for m in _IMAGE.finditer(markdown))
    sourced = sum(bool(re.search(r"""\bsrc\s*=\s*(?:"[^"]*[^"\s][^"]*"|'[^']*[^'\s][^']*'|[^\s"'=<>`]+)""", m[0], re.IGNORECASE)) for m in _HTML_IMAGE.finditer(markdown))
    return inline + sum(name(m[2] or m[1]) in defined for m in _NAMED_IMAGE.finditer(markdown)) + sourced


# How a page describes a picture in words.
DESCRIPTIONS = (r"\[视觉描述\|src=\S+?:\s*([^\]\r\n]+)\]", r"^\s*图片说明[：:]\s*(.+)$", r"^\s*>\s*\[图片\]\s*(.+)$", r"<figcaption\b[^>]*>((?s:.*?))</figcaption>")
_DESCRIPTIONS = [re.compile(p, re.MULTILINE | (re.IGNORECASE if "figcaption" in p else 0)) for p in DESCRIPTIONS]


def descriptions(markdown: str, least: int = DESCRIPTION_CHARS) -> int:
    """Descriptions of pictures with at least ``least`` letters and digits."""
    return sum(sum(c.isalnum() for c in re.sub("<[^>]+>", "", m[1])) >= least for p in _DESCRIPTIONS for m in p.finditer(markdown))


@dataclass(frozen=True)
class Signals:
    tables: list[list[list[str]]]
    images: int
    descriptions: int
    formulas: list[list[str]]


def signals(markdown: str | None, least: int = DESCRIPTION_CHARS) -> Signals:
    """Everything that a page's Markdown shows; null as empty."""
    text = _CODE.sub(" ", _FENCE.sub(" ", markdown or ""))
    return Signals(pipe_tables(text) + html_tables(text), images(text), descriptions(text, least), formulas(text))
