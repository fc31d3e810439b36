"""Control and logic: only booleans decide, and what is not reached does not fail."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import BIN, BOOL, DIGITS, LIST, NUM, TEXT, Term, as_bool, as_bytes, as_text, failed, failing, first_error, let, made, term


def _none() -> Column:
    return F.lit(None).cast("string")


def _err(x: Term) -> Column:
    return _none() if x.error is None else x.error


def _merged(a: Term, b: Term) -> tuple[Term, Term, dict]:
    """Two branches brought to one type."""
    if a.kind == b.kind == NUM:
        scale = max(a.scale, b.scale)
        p = min(DIGITS, max(a.precision - a.scale, b.precision - b.scale) + scale)
        shown = [F.lit(x.scale) if x.shown is None else x.shown for x in (a, b)]
        same = a.shown is None and b.shown is None and a.scale == b.scale
        a, b = (replace(x, value=x.value.try_cast(f"decimal({p},{scale})"), shown=None if same else s) for x, s in zip((a, b), shown, strict=True))
        return a, b, {"precision": p, "scale": scale}
    if a.kind == b.kind:
        return a, b, {"of": a.of} if a.kind == LIST else {}
    if {a.kind, b.kind} == {NUM, TEXT}:  # a number and a text: both are texts, each in its canonical form
        return as_text(a), as_text(b), {}
    raise TypeError(f"branches of kinds {a.kind} and {b.kind}")


def if_(cond, then, otherwise="") -> Term:
    """The branch that is taken; the other one cannot fail."""
    c, t, e = as_bool(cond), term(then), term(otherwise)
    t, e, more = _merged(t, e)
    if t.kind == NUM and t.shown is not None:
        more["shown"] = F.when(c.value, t.shown).otherwise(e.shown)
    error = None if c.error is None and t.error is None and e.error is None else F.coalesce(_err(c), F.when(c.value, _err(t)).otherwise(_err(e)))
    value = F.when(c.value, t.value).when(~c.value, e.value)
    return Term(t.kind, value, error, c.deps | t.deps | e.deps, **more)


def cond(*args) -> Term:
    """cond(c1, r1, c2, r2, ..., default): the first true condition decides."""
    if len(args) < 3 or len(args) % 2 == 0:
        raise TypeError("cond takes pairs and a default")
    pairs = list(zip(args[:-1:2], args[1:-1:2], strict=True))
    return reduce(lambda rest, p: if_(p[0], p[1], rest), reversed(pairs), term(args[-1]))


def abort(message, kind: str = TEXT) -> Term:
    """Fails with the given message wherever it is reached."""
    m = as_text(message)
    code = F.concat(F.lit("E_ABORT: "), m.value)
    return replace(failing("E_ABORT", kind, m), error=first_error(m.error, code))


def and_(a, b) -> Term:
    a, b = as_bool(a), as_bool(b)
    error = None if a.error is None and b.error is None else F.coalesce(_err(a), F.when(a.value, _err(b)))
    return Term(BOOL, F.when(~a.value, False).when(a.value, b.value), error, a.deps | b.deps)


def or_(a, b) -> Term:
    a, b = as_bool(a), as_bool(b)
    error = None if a.error is None and b.error is None else F.coalesce(_err(a), F.when(~a.value, _err(b)))
    return Term(BOOL, F.when(a.value, True).when(~a.value, b.value), error, a.deps | b.deps)


def xor(a, b) -> Term:
    a, b = as_bool(a), as_bool(b)
    return made(BOOL, a.value != b.value, a, b)


def not_(a) -> Term:
    a = as_bool(a)
    return made(BOOL, ~a.value, a)


# text comparison: bytewise on UTF-8


def _scalars(a, b) -> tuple[Term, Term]:
    a, b = term(a), term(b)
    return (as_bytes(a), as_bytes(b)) if BIN in (a.kind, b.kind) else (as_text(a), as_text(b))


def text_eq(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value == b.value, a, b)


def text_ne(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value != b.value, a, b)


def text_lt(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value < b.value, a, b)


def text_le(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value <= b.value, a, b)


def text_gt(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value > b.value, a, b)


def text_ge(a, b) -> Term:
    a, b = _scalars(a, b)
    return made(BOOL, a.value >= b.value, a, b)


def eql(a, b) -> Term:
    """Same kind and same value: 2 and 2.0 differ, a number and its text do not (numbers are texts)."""
    a, b = term(a), term(b)
    if {a.kind, b.kind} <= {TEXT, NUM}:
        a, b = as_text(a), as_text(b)
    elif a.kind != b.kind:
        return made(BOOL, F.lit(False), a, b)
    return made(BOOL, a.value.eqNullSafe(b.value) if a.kind == LIST else a.value == b.value, a, b)


def in_(needle, *choices) -> Term:
    """Whether some choice is eql to the needle. A single list Term is searched by element."""
    needle = term(needle)
    if len(choices) == 1 and isinstance(choices[0], Term) and choices[0].kind == LIST:
        from ..operators import lists

        return lists.any_(choices[0], lambda x, k: eql(x, needle))
    terms = [eql(needle, c) for c in choices]
    error = first_error(*(t.error for t in terms))
    value = reduce(lambda x, y: x | y, (t.value for t in terms), F.lit(False))
    return Term(BOOL, value, error, needle.deps.union(*(t.deps for t in terms)))


def concat(*parts) -> Term:
    """Texts joined; with bytes among them, bytes. Booleans are not text."""
    terms = [term(p) for p in parts]
    if any(t.kind == BIN for t in terms):
        terms = [as_bytes(t) if t.kind != BOOL else failing("E_NOT_TEXT", BIN, t) for t in terms]
        return made(BIN, F.concat(*(t.value for t in terms)), *terms)
    terms = [as_text(t) for t in terms]
    return made(TEXT, F.concat(*(t.value for t in terms)), *terms)


# bitwise, on byte strings of one length

#: Bytes that are combined at once: as many as a bigint holds below its sign.
WORD = 7


def _bits(a, b, op) -> Term:
    a, b = as_bytes(a), as_bytes(b)
    uneven = failed(F.octet_length(a.value) != F.octet_length(b.value), "E_LEN_MISMATCH")

    def combined(x, y):
        number = lambda v, at: F.conv(F.hex(F.substring(v, at, F.lit(WORD))), 16, 10).cast("bigint")
        word = lambda at: F.lpad(F.hex(op(number(x, at), number(y, at))), 2 * WORD, "0")
        size = F.octet_length(x)
        digits = F.array_join(F.transform(F.sequence(F.lit(1), size, F.lit(WORD)), word), "")
        rest = size % WORD  # the last word holds so many bytes, at its end
        whole = F.lit(2) * (size - rest)
        tail = F.when(rest == 0, "").otherwise(F.right(digits, F.lit(2) * rest))
        return F.unhex(F.when(size == 0, "").otherwise(F.concat(F.substring(digits, F.lit(1), whole), tail)))

    value = let(lambda x, y: F.when(F.octet_length(x) == F.octet_length(y), combined(x, y)), a.value, b.value)
    return made(BIN, value, a, b, errors=(uneven,))


def band(a, b) -> Term:
    return _bits(a, b, lambda x, y: x.bitwiseAND(y))


def bor(a, b) -> Term:
    return _bits(a, b, lambda x, y: x.bitwiseOR(y))


def bxor(a, b) -> Term:
    return _bits(a, b, lambda x, y: x.bitwiseXOR(y))
