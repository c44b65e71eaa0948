"""Whether a formula parses: groups, environments, paired delimiters and arguments, in one pass with a stack."""

from __future__ import annotations

import re

#: Arguments in braces, or single tokens, that macros must have.
ARGUMENTS = {
    "frac": 2, "dfrac": 2, "tfrac": 2, "binom": 2, "sqrt": 1, "mathrm": 1, "mathbf": 1, "mathit": 1, "mathcal": 1, "mathbb": 1, "mathsf": 1,
    "text": 1, "textbf": 1, "textit": 1, "textrm": 1, "operatorname": 1, "overline": 1, "underline": 1, "hat": 1, "bar": 1, "vec": 1,
    "tilde": 1, "dot": 1, "ddot": 1, "overset": 2, "underset": 2, "stackrel": 2, "label": 1, "ref": 1, "begin": 1, "end": 1,
}
#: Macros that may have an argument in brackets before the others.
OPTIONAL = ("sqrt",)

_TOKEN = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\([A-Za-z]+)\*?|\\.|%[^\n]*\n?|\s+|.", re.S)


def fault(formula: str) -> tuple[int, str] | None:
    """(place, what) of the first fault of a formula; None if it parses.

    A closing token must close the group, environment or ``\\left`` that was
    opened last, nothing stays open, and arguments that macros owe come before
    the next closing token, ``&`` or row end.  Comments are left out.
    """
    frames: list[tuple[str, str, int, list]] = [("", "", 0, [])]
    delimiter: tuple[str, int] | None = None
    for m in _TOKEN.finditer(formula):
        token, at, (side, env, macro) = m[0], m.start(), m.groups()
        if token[0] == "%" or token.isspace():
            continue
        kind, name, start, owed = frames[-1]
        if delimiter:
            if token in ("{", "}", "&", "\\\\") or side:
                break
            if delimiter[0] == "\\left":
                frames.append(("left", "\\left", delimiter[1], []))
            delimiter = None
            continue
        closing = "{" if token == "}" else "left" if macro == "right" else f"begin {env}" if side == "end" else "[" if token == "]" and kind == "[" else None
        if owed and (closing or token in ("&", "\\\\")):
            break
        if closing:
            if closing != kind:
                what = {"{": "} without {", "left": "\\right without \\left"}.get(closing, f"\\end{{{env}}} without \\begin{{{env}}}")
                return (start, f"{name} is not closed") if kind else (at, what)
            frames.pop()
            if macro == "right":
                delimiter = ("\\right", at)
            continue
        if token == "\\":
            return at, "\\ without a name"
        if owed:
            if token == "[" and owed[-1][3]:
                owed[-1][3] = False
                frames.append(("[", "[", at, []))
                continue
            owed[-1][2] -= 1
            owed[-1][3] = False
            if not owed[-1][2]:
                owed.pop()
        if token == "{":
            frames.append(("{", "{", at, []))
        elif side == "begin":
            frames.append((f"begin {env}", f"\\begin{{{env}}}", at, []))
        elif macro == "left":
            delimiter = ("\\left", at)
        elif macro in ARGUMENTS:
            owed.append([f"\\{macro}", at, ARGUMENTS[macro], macro in OPTIONAL])
    if delimiter:
        return delimiter[1], f"{delimiter[0]} lacks a delimiter"
    _, name, start, owed = frames[-1]
    if owed:
        return owed[-1][1], f"{owed[-1][0]} lacks an argument"
    return (start, f"{name} is not closed") if name else None
