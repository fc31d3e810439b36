"""Terms: what a rule is made of.

A Term pairs a value column with an error column. Operators compose both, so a whole rule is one pair of Catalyst
expressions. The error is the code of the first failure in evaluation order, null if there is none; a value is null
wherever its error is not. Kinds are fixed when the rule is built: ``num``, ``text``, ``bin``, ``bool`` and ``list``.

Numbers are exact. The column is a decimal whose type bounds precision and scale; ``shown`` holds the number of fraction
digits of each row where that differs from the type (2.5 and 2.50 are equal numbers and different texts).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUM, TEXT, BIN, BOOL, LIST = "num", "text", "bin", "bool", "list"
DIGITS = 38


@dataclass(frozen=True)
class Term:
    kind: str
    value: Column
    error: Column | None = None
    deps: frozenset[str] = frozenset()
    precision: int = 0
    scale: int = 0
    shown: Column | None = None
    of: Callable[[Column], Term] | None = None  # lists: how an element column becomes a Term
    literal: object = field(default=None, compare=False)
    both: Column | None = field(default=None, compare=False)  # struct(value, error) that value and error read, where it is costly

    # arithmetic
    def __add__(self, other): return _num("add", self, other)
    def __radd__(self, other): return _num("add", term(other), self)
    def __sub__(self, other): return _num("sub", self, other)
    def __rsub__(self, other): return _num("sub", term(other), self)
    def __mul__(self, other): return _num("mul", self, other)
    def __rmul__(self, other): return _num("mul", term(other), self)
    def __truediv__(self, other): return _num("div", self, other)
    def __rtruediv__(self, other): return _num("div", term(other), self)
    def __mod__(self, other): return _num("mod", self, other)
    def __rmod__(self, other): return _num("mod", term(other), self)
    def __neg__(self): return _num("neg", self)

    # numeric comparison
    def __eq__(self, other): return _compare(self, other, lambda a, b: a == b)
    def __ne__(self, other): return _compare(self, other, lambda a, b: a != b)
    def __lt__(self, other): return _compare(self, other, lambda a, b: a < b)
    def __le__(self, other): return _compare(self, other, lambda a, b: a <= b)
    def __gt__(self, other): return _compare(self, other, lambda a, b: a > b)
    def __ge__(self, other): return _compare(self, other, lambda a, b: a >= b)
    __hash__ = None

    # logic on booleans, as on Spark columns
    def __and__(self, other): return _logic("and_", self, other)
    def __or__(self, other): return _logic("or_", self, other)
    def __xor__(self, other): return _logic("xor", self, other)
    def __invert__(self): return _logic("not_", self)

    def __bool__(self):
        raise TypeError("a Term has no truth value; use &, |, ~ and if_()")

    def __getitem__(self, key: str | int) -> Term:
        from ..operators import lists

        return lists.index(self, key)


def _num(name, *args):
    from . import numbers

    return getattr(numbers, name)(*map(term, args))


def _logic(name, *args):
    from . import logic

    return getattr(logic, name)(*map(term, args))


def _compare(a, b, op):
    from . import numbers

    return numbers.compare(term(a), term(b), op)


# building


def first_error(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return F.coalesce(*some) if len(some) > 1 else some[0] if some else None


def failed(when: Column, code: str) -> Column:
    return F.when(when, F.lit(code))


def made(kind: str, value: Column, *args: Term, errors: tuple[Column | None, ...] = (), **more) -> Term:
    """A Term computed from args; own errors come after the arguments' errors. The value is null where anything failed."""
    error = first_error(*(a.error for a in args), *errors)
    own = first_error(*errors)
    return Term(kind, value if own is None else F.when(own.isNull(), value), error, frozenset().union(*(a.deps for a in args)), **more)


def let(build: Callable[..., Column], *cols: Column) -> Column:
    """build(*cols) with each column computed once, however often build uses it."""
    names = [f"c{i}" for i in range(len(cols))]
    row = F.array(F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True))))
    return F.get(F.transform(row, lambda r: build(*(r[n] for n in names))), F.lit(0))


def failing(code: str, kind: str = TEXT, *args: Term) -> Term:
    """An error at this place, raised only where evaluation reaches it."""
    types = {NUM: f"decimal({DIGITS},0)", TEXT: "string", BIN: "binary", BOOL: "boolean", LIST: "array<string>"}
    more = {"precision": DIGITS} if kind == NUM else {}
    return Term(kind, F.lit(None).cast(types[kind]), first_error(*(a.error for a in args), F.lit(code)), frozenset().union(*(a.deps for a in args)), **more)


_NUMBER = re.compile(r"-?[0-9]+(\.[0-9]+)?\Z", re.A)
#: Form of a number in a text, for Spark.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"


def number(x: int | str | Decimal) -> Term:
    """An exact literal; its fraction digits are kept."""
    s = str(x)
    if not _NUMBER.match(s):
        raise ValueError(f"not a number: {x!r}")
    d = Decimal(s)
    scale = max(0, -d.as_tuple().exponent)
    precision = max(1, scale, len(d.as_tuple().digits))
    if precision > DIGITS:
        return failing("E_RANGE", NUM)
    return Term(NUM, F.lit(s).cast(f"decimal({precision},{scale})"), precision=precision, scale=scale, literal=d)


def term(x) -> Term:
    """Term of a Python literal: bool, int, Decimal, str (a text), bytes. Floats are refused: they are not exact."""
    if isinstance(x, Term):
        return x
    if isinstance(x, bool):
        return Term(BOOL, F.lit(x), literal=x)
    if isinstance(x, int | Decimal):
        return number(x)
    if isinstance(x, str):
        return Term(TEXT, F.lit(x), literal=x)
    if isinstance(x, bytes | bytearray):
        return Term(BIN, F.lit(bytearray(x)), literal=bytes(x))
    raise TypeError(f"no exact literal: {x!r}")


def text_col(name: str | Column, dep: str | None = None) -> Term:
    return _column(name, TEXT, dep)


def bin_col(name: str | Column, dep: str | None = None) -> Term:
    return _column(name, BIN, dep)


def bool_col(name: str | Column, dep: str | None = None) -> Term:
    return _column(name, BOOL, dep)


def num_col(name: str | Column, precision: int, scale: int, dep: str | None = None) -> Term:
    """A DECIMAL(precision, scale) column."""
    return replace(_column(name, NUM, dep), precision=precision, scale=scale)


def _column(name: str | Column, kind: str, dep: str | None) -> Term:
    col = F.col(name) if isinstance(name, str) else name
    deps = frozenset({dep or name}) if dep or isinstance(name, str) else frozenset()
    missing = {TEXT: "E_NOT_TEXT", NUM: "E_NOT_NUM", BIN: "E_NOT_BIN", BOOL: "E_NOT_BOOL"}[kind]  # null holds no scalar of the kind
    return Term(kind, col, failed(col.isNull(), missing), deps)


# coercion


def as_text(x) -> Term:
    """Text of a Term: numbers by their canonical text; booleans and bytes are not text."""
    x = term(x)
    if x.kind == TEXT:
        return x
    if x.kind == NUM:
        s = x.value.cast("string")
        if x.shown is not None and x.scale:
            s = F.substring(s, F.lit(1), F.char_length(s) - (F.lit(x.scale) - x.shown) - F.when(x.shown == 0, 1).otherwise(0))
            s = F.when(s == "-0", "0").otherwise(s) if x.scale else s
        return Term(TEXT, s, x.error, x.deps)
    if x.kind == LIST:
        return as_text(_first(x))
    return failing("E_NOT_TEXT", TEXT, x)


#: Fraction digits that arithmetic on numbers in texts holds (comparison holds any number, functions.exact too).
FRACTION = 12


def as_num(x, fraction: int = FRACTION) -> Term:
    """Number of a Term. Texts must have the form of a number; more than ``fraction`` fraction digits are E_RANGE."""
    x = term(x)
    if x.kind == NUM:
        return x
    if x.kind == LIST:
        return as_num(_first(x))
    if x.kind != TEXT:
        return failing("E_NOT_NUM", NUM, x)
    if isinstance(x.literal, str):
        return number(x.literal) if _NUMBER.match(x.literal) else failing("E_NOT_NUM", NUM, x)
    ok = x.value.rlike(NUMBER)
    shown = F.when(F.instr(x.value, ".") > 0, F.char_length(x.value) - F.instr(x.value, ".")).otherwise(0)
    value = F.when(ok & (shown <= fraction), x.value.try_cast(f"decimal({DIGITS},{fraction})"))
    return made(NUM, value, x, errors=(failed(~ok, "E_NOT_NUM"), failed(value.isNull() & ok, "E_RANGE")), precision=DIGITS, scale=fraction, shown=shown)


def as_bytes(x) -> Term:
    """Bytes of a Term: texts and numbers as UTF-8."""
    x = term(x)
    if x.kind == BIN:
        return x
    if x.kind in (TEXT, NUM):
        t = as_text(x)
        return Term(BIN, t.value.cast("binary"), t.error, t.deps)
    return failing("E_NOT_BIN", BIN, x)


def byte_values(x: Column) -> Column:
    """Array of a binary column's bytes as texts of one character: in Latin-1 each byte is one."""
    return F.slice(F.split(F.decode(x, "ISO-8859-1"), ""), F.lit(1), F.octet_length(x))


def bytes_of(chars: Column) -> Column:
    """Bytes of an array of characters up to 255; nulls are left out."""
    return F.encode(F.array_join(chars, ""), "ISO-8859-1")


def as_bool(x) -> Term:
    x = term(x)
    return x if x.kind == BOOL else failing("E_NOT_BOOL", BOOL, x)


def as_count(x, least: int = 0) -> tuple[Term, Column]:
    """A whole number as INT (clamped) and its own error; below least is E_RANGE."""
    n = as_num(x)
    whole = n.value == F.floor(n.value) if n.scale else F.lit(True)
    code = F.coalesce(failed(~whole, "E_NOT_INT"), failed(n.value < least, "E_RANGE"))
    clamped = F.least(F.greatest(n.value, F.lit(least)), F.lit(2**31 - 1)).cast("int")
    return Term(NUM, clamped, n.error, n.deps), code


def _first(x: Term) -> Term:
    return x[1] if x.kind == LIST else x


# using


def strict(x: Term) -> Column:
    """The value; a row with an error fails the query."""
    if x.error is None:
        return x.value
    return F.when(x.error.isNull(), x.value).otherwise(F.raise_error(x.error).cast(_type(x)) if _type(x) else F.raise_error(x.error))


def captured(x: Term) -> Column:
    """struct(value, error): every row gives a result."""
    return F.struct(x.value.alias("value"), (F.lit(None).cast("string") if x.error is None else x.error).alias("error"))


def staged(df: DataFrame, terms: dict[str, Term]) -> tuple[DataFrame, dict[str, Term]]:
    """df with hidden columns that hold the Terms, and Terms that read them. Use it for what a rule mentions several times and
    what is costly to compute, as aggregates of lists: Spark computes such a column once."""
    cols, out = {}, {}
    for n, t in terms.items():
        if t.both is not None:
            cols[f"__{n}"] = t.both
            out[n] = replace(t, value=F.col(f"__{n}")["value"], error=F.col(f"__{n}")["error"], both=None)
            continue
        cols[f"__{n}"] = t.value
        if t.error is not None:
            cols[f"__{n}_error"] = t.error
        if t.shown is not None:
            cols[f"__{n}_shown"] = t.shown
        read = lambda what, has: F.col(what) if has is not None else None
        out[n] = replace(t, value=F.col(f"__{n}"), error=read(f"__{n}_error", t.error), shown=read(f"__{n}_shown", t.shown))
    return df.withColumns(cols), out


def _type(x: Term) -> str | None:
    return {NUM: f"decimal({x.precision},{x.scale})", TEXT: "string", BIN: "binary", BOOL: "boolean"}.get(x.kind)
