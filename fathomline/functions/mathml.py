"""Office mathematics to LaTeX, by the elements of the Office Open XML standard."""

from __future__ import annotations

from xml.etree import ElementTree

#: Big operators, accents and function names by their characters.
OPERATORS = {"∑": "\\sum", "∏": "\\prod", "∐": "\\coprod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap"}
ACCENTS = {"̂": "\\hat", "̃": "\\tilde", "̄": "\\bar", "̅": "\\overline", "̇": "\\dot", "̈": "\\ddot", "⃗": "\\vec", "̌": "\\check"}
SYMBOLS = {"×": "\\times ", "÷": "\\div ", "·": "\\cdot ", "±": "\\pm ", "≤": "\\le ", "≥": "\\ge ", "≠": "\\ne ", "≈": "\\approx ", "→": "\\to ", "∞": "\\infty ", "∂": "\\partial ", "α": "\\alpha ", "β": "\\beta ", "γ": "\\gamma ", "δ": "\\delta ", "ε": "\\epsilon ", "η": "\\eta ", "θ": "\\theta ", "λ": "\\lambda ", "μ": "\\mu ", "π": "\\pi ", "ρ": "\\rho ", "σ": "\\sigma ", "τ": "\\tau ", "φ": "\\phi ", "ω": "\\omega ", "Δ": "\\Delta ", "Σ": "\\Sigma ", "Ω": "\\Omega "}
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "sinh", "cosh", "tanh", "ln", "log", "exp", "lim", "max", "min", "det", "gcd")


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _child(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in e if _name(c) == name), None)


def _setting(e: ElementTree.Element, name: str) -> str | None:
    """The value of a property of ``e``; None where it isn't given."""
    for props in e:
        if _name(props).endswith("Pr") and (found := _child(props, name)) is not None:
            return next((v for k, v in found.attrib.items() if k.rsplit("}", 1)[-1] == "val"), "")
    return None


def _part(e: ElementTree.Element, name: str) -> str:
    found = _child(e, name)
    return "" if found is None else _row(found)


def _row(e: ElementTree.Element) -> str:
    return "".join(map(latex, e))


def _on(setting: str | None) -> bool:
    """Whether a switch is set: given without a value or with a true one."""
    return setting is not None and setting.lower() not in ("0", "off", "false")


def latex(e: ElementTree.Element) -> str:
    """LaTeX of one element; elements that aren't known show what they hold."""
    name = _name(e)
    if name.endswith("Pr"):
        return ""
    if name == "t":
        return "".join(SYMBOLS.get(c, "\\" + c if c in "#$%&_{}" else c) for c in e.text or "")
    base = _part(e, "e")
    if name == "f":
        kind = _setting(e, "type")
        up, down = _part(e, "num"), _part(e, "den")
        return f"{up}/{down}" if kind == "lin" else f"\\binom{{{up}}}{{{down}}}" if kind == "noBar" else f"\\frac{{{up}}}{{{down}}}"
    if name in ("sSup", "sSub", "sSubSup"):
        low = f"_{{{_part(e, 'sub')}}}" if name != "sSup" else ""
        return f"{{{base}}}{low}" + (f"^{{{_part(e, 'sup')}}}" if name != "sSub" else "")
    if name == "sPre":
        return f"{{}}_{{{_part(e, 'sub')}}}^{{{_part(e, 'sup')}}}{{{base}}}"
    if name == "rad":
        degree = "" if _on(_setting(e, "degHide")) else _part(e, "deg")
        return f"\\sqrt[{degree}]{{{base}}}" if degree else f"\\sqrt{{{base}}}"
    if name == "nary":
        sign = OPERATORS.get(_setting(e, "chr") or "∫", _setting(e, "chr") or "\\int")
        low = "" if _on(_setting(e, "subHide")) else _part(e, "sub")
        high = "" if _on(_setting(e, "supHide")) else _part(e, "sup")
        return sign + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{base}}}"
    if name == "d":
        opens, closes, bar = (_setting(e, k) for k in ("begChr", "endChr", "sepChr"))
        inside = (bar or "|").join(_row(c) for c in e if _name(c) == "e")
        edge = {None: "", "": ".", "{": "\\{", "}": "\\}", "⟨": "\\langle", "⟩": "\\rangle", "‖": "\\|"}
        left, right = (s if s is None else edge.get(s, s) for s in (opens, closes))
        return f"\\left{'(' if left is None else left}{inside}\\right{')' if right is None else right}"
    if name in ("m", "eqArr"):
        lines = [" & ".join(_row(c) for c in r if _name(c) == "e") for r in e if _name(r) == "mr"] if name == "m" else [_row(c) for c in e if _name(c) == "e"]
        kind = "matrix" if name == "m" else "aligned"
        return f"\\begin{{{kind}}}" + " \\\\ ".join(lines) + f"\\end{{{kind}}}"
    if name == "func":
        called = _part(e, "fName")
        return (f"\\{called}" if called in FUNCTIONS else called) + f"{{{base}}}"
    if name == "acc":
        return f"{ACCENTS.get(_setting(e, 'chr') or chr(0x302), chr(92) + 'hat')}{{{base}}}"
    if name in ("bar", "groupChr"):
        top = _setting(e, "pos") == "top"
        return ("\\over" if top else "\\under") + ("line" if name == "bar" else "brace") + f"{{{base}}}"
    if name in ("limLow", "limUpp"):
        inner = f"\\{base}" if base in FUNCTIONS else f"{{{base}}}"
        return f"{inner}{'_' if name == 'limLow' else '^'}{{{_part(e, 'lim')}}}"
    return _row(e)
