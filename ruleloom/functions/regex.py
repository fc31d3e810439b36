"""Regular expressions of a portable subset, run by Spark's own engine.

A pattern is a literal. It is checked piece by piece against what all hosts agree on and rewritten for Java: dot matches
everything, ``^`` and ``$`` are the ends of the subject only, ``\\d \\w \\s`` are ASCII. Anything else is E_REGEX_SYNTAX,
raised where the function is reached.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from .terms import BOOL, LIST, NUM, TEXT, Term, as_text, failing, made, term

#: Largest bound of a quantifier (fixed value).
MOST = 65_535
#: ASCII classes (fixed values).
CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r" \t\n\r\f\x0b"}
_CONTROL = "nrtf"
_META = r".^$*+?()[]{}|\/-"
_PIECE = re.compile(
    r"""(?P<escape>\\.)|(?P<set>\[\^?(?:\\.|[^\]\\])*\])|(?P<open>\((?:\?:|(?!\?)))|(?P<close>\))"""
    r"""|(?P<quantifier>(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??(?![*+?{]))|(?P<anchor>[\^$])|(?P<plain>[^\\\[\](){}*+?])""",
    re.S | re.A,
)
_MEMBER = re.compile(r"\\.|[^\\]", re.S)
#: Letters that simple case folding maps to an ASCII letter (fixed values).
FOLDED = {"k": "\u212a", "s": "\u017f"}


class Syntax(ValueError):
    """A pattern outside the subset."""


def _escaped(c: str, inside: bool) -> str:
    if c in CLASSES:
        return CLASSES[c] if inside else f"[{CLASSES[c]}]"
    if c.lower() in CLASSES and not inside:
        return f"[^{CLASSES[c.lower()]}]"
    if c in _CONTROL or c in _META:
        return "\\" + c
    raise Syntax(f"\\{c} is not portable")


def _set(text: str, fold: bool) -> str:
    inverted = text[1] == "^"
    body = text[2 if inverted else 1 : -1]
    if not body:
        raise Syntax("an empty class")
    out, extra = [], set()
    members = _MEMBER.findall(body)
    for i, m in enumerate(members):
        if m == "[" and body[body.index("[") + 1 : body.index("[") + 2] in (":", ".", "="):
            raise Syntax("a POSIX class")
        out.append(_escaped(m[1], True) if m[0] == "\\" else "\\" + m if m in "[&" else m)
        if fold:
            low, high = m[-1], members[i + 2][-1] if members[i + 1 : i + 2] == ["-"] and i + 2 < len(members) else m[-1]
            extra |= {f for c, f in FOLDED.items() if m[0] != "\\" and (low <= c <= high or low <= c.upper() <= high)}
    return "[" + "^" * inverted + "".join(out) + "".join(sorted(extra)) + "]"


def portable(pattern: str, flags: str = "") -> tuple[str, int]:
    """(Java pattern, number of groups)."""
    if flags not in ("", "i"):
        raise Syntax("only the flag i is known")
    fold = flags == "i"
    if fold and not pattern.isascii():
        raise Syntax("the flag i needs an ASCII pattern")
    at, out, depth, groups, can_repeat = 0, [], 0, 0, False
    while at < len(pattern):
        m = _PIECE.match(pattern, at)
        if not m:
            raise Syntax(f"not portable at {at + 1}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind == "quantifier":
            bounds = [int(x) for x in re.findall("[0-9]+", text)]
            if not can_repeat or any(b > MOST for b in bounds) or bounds != sorted(bounds):
                raise Syntax("a quantifier that cannot be")
            out.append(text)
        elif kind == "escape":
            out.append(_escaped(text[1], False))
        elif kind == "set":
            out.append(_set(text, fold))
        elif kind == "open":
            depth, groups = depth + 1, groups + (text == "(")
            out.append(text)
        elif kind == "close":
            if not depth:
                raise Syntax("a group that was not opened")
            depth -= 1
            out.append(text)
        elif text == "$":
            out.append(r"\z")
        elif fold and text.lower() in FOLDED:
            out.append(f"[{text}{FOLDED[text.lower()]}]")
        else:
            out.append(text)
        can_repeat = kind not in ("quantifier", "open", "anchor") and text != "|"
    if depth:
        raise Syntax("a group that was not closed")
    return ("(?si)" if fold else "(?s)") + "".join(out), groups


def _with(pattern: str, flags: str, kind: str, subject: Term, build) -> Term:
    try:
        java, groups = portable(pattern, flags)
    except Syntax:
        return failing("E_BAD_ARG" if flags not in ("", "i") or (flags and not pattern.isascii()) else "E_REGEX_SYNTAX", kind, subject)
    return build(java, groups)


def rmatch(pattern: str, subject, flags: str = "") -> Term:
    x = as_text(subject)
    return _with(pattern, flags, BOOL, x, lambda p, g: made(BOOL, x.value.rlike(p), x))


def rfind(pattern: str, subject, flags: str = "") -> Term:
    """Code-point position of the first match, 0 if there is none."""
    x = as_text(subject)

    def build(p, g):
        found = F.regexp_instr(x.value, F.lit(p))  # in UTF-16 units
        before = F.decode(F.substring(F.encode(x.value, "UTF-16BE"), F.lit(1), (found - 1) * 2), "UTF-16BE")
        at = F.when(found > 0, F.char_length(before) + 1).otherwise(found)
        return made(NUM, at.cast("decimal(10,0)"), x, precision=10)

    return _with(pattern, flags, NUM, x, build)


def rgroups(pattern: str, subject, flags: str = "") -> Term:
    """List of the whole match and its groups; empty without a match."""
    from ..operators.lists import of_array

    x = as_text(subject)

    def build(p, g):
        found = F.array(*(F.regexp_extract(x.value, p, i) for i in range(g + 1)))
        return of_array(made(LIST, F.when(x.value.rlike(p), found).otherwise(F.array().cast("array<string>")), x), lambda c: Term(TEXT, c))

    return _with(pattern, flags, LIST, x, build)


def rreplace(pattern: str, by: str, subject, flags: str = "") -> Term:
    """All matches replaced; in the literal ``by``, $0 to $9 are the match and its groups and $$ is a dollar."""
    x = as_text(subject)

    def build(p, g):
        out, at, missing = [], 0, False
        for m in re.finditer(r"\$(\$|[0-9])|\\|\$", by):
            out.append(by[at : m.start()])
            at = m.end()
            if m[1] == "$":
                out.append(r"\$")
            elif m[1]:
                missing |= int(m[1]) > g
                out.append(f"${m[1]}" + ("\\" if by[at : at + 1].isdigit() else ""))
            else:
                out.append("\\" + m[0])
        java = "".join([*out, by[at:]])
        if missing:
            return made(TEXT, x.value, x, errors=(F.when(x.value.rlike(p), F.lit("E_BAD_ARG")),))
        return made(TEXT, F.regexp_replace(x.value, F.lit(p), F.lit(java)), x)

    return _with(pattern, flags, TEXT, x, build)


def matches_any(subject, *patterns: str) -> Term:
    """Whether one of several patterns matches."""
    from .logic import or_

    return reduce(or_, (rmatch(p, subject) for p in patterns), term(False))
