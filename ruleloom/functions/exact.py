"""Numbers without a bound on their digits, through Arrow batches.

Spark's decimals hold 38 digits. These functions take texts or numbers of any length, compute with Python's whole numbers and
give canonical texts. They cross to Python, so use them only where functions.numbers answers E_RANGE; they cannot stand
inside the bodies of list functions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from .numbers import POWER_MOST, QUOTIENT, ROUND_MOST
from .terms import TEXT, Term, as_text, first_error

_FORM = re.compile(r"-?[0-9]+(\.[0-9]+)?", re.A)


def _read(text: str) -> tuple[int, int]:
    """(digits as a whole number, fraction digits)."""
    if not _FORM.fullmatch(text):
        raise ValueError("E_NOT_NUM")
    whole, _, part = text.partition(".")
    return int(whole + part), len(part)


def _written(n: int, scale: int) -> str:
    digits = str(abs(n)).rjust(scale + 1, "0")
    return ("-" if n < 0 else "") + (f"{digits[:-scale]}.{digits[-scale:]}" if scale else digits)


def _rounded(n: int, by: int) -> int:
    """n / by, half away from zero."""
    q, r = divmod(abs(n), abs(by))
    q += 2 * r >= abs(by)
    return -q if (n < 0) != (by < 0) else q


def _aligned(a, b) -> tuple[int, int, int]:
    scale = max(a[1], b[1])
    return a[0] * 10 ** (scale - a[1]), b[0] * 10 ** (scale - b[1]), scale


def _divided(a, b):
    x, y, _ = _aligned(a, b)
    if not y:
        raise ValueError("E_DIV_ZERO")
    q = _rounded(x * 10**QUOTIENT, y)
    if q * y != x * 10**QUOTIENT:
        return q, QUOTIENT
    scale = QUOTIENT
    while scale and q % 10 == 0:
        q, scale = q // 10, scale - 1
    return q, scale


def _remainder(a, b):
    x, y, scale = _aligned(a, b)
    if not y:
        raise ValueError("E_DIV_ZERO")
    r = abs(x) % abs(y)
    return (-r if x < 0 else r), scale


def _whole(b, most: int) -> int:
    n, scale = b
    if n % 10**scale:
        raise ValueError("E_NOT_INT")
    n //= 10**scale
    if not 0 <= n <= most:
        raise ValueError("E_RANGE")
    return n


def _to_scale(a, b):
    k = _whole(b, ROUND_MOST)
    return (a[0] * 10 ** (k - a[1]) if k >= a[1] else _rounded(a[0], 10 ** (a[1] - k))), k


def _raised(a, b):
    k = _whole(b, POWER_MOST)
    return a[0] ** k, a[1] * k


_OPS = {
    "add": lambda a, b: (lambda x, y, s: (x + y, s))(*_aligned(a, b)),
    "sub": lambda a, b: (lambda x, y, s: (x - y, s))(*_aligned(a, b)),
    "mul": lambda a, b: (a[0] * b[0], a[1] + b[1]),
    "div": _divided,
    "mod": _remainder,
    "round": _to_scale,
    "power": _raised,
}


def _term(op: str, a, b) -> Term:
    a, b = as_text(a), as_text(b)

    @F.pandas_udf("value string, error string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import sys

        sys.set_int_max_str_digits(0)
        out = []
        for p, q in zip(x, y, strict=True):
            try:
                out.append((_written(*_OPS[op](_read(p), _read(q))), None) if p is not None and q is not None else (None, None))
            except ValueError as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    done = run(a.value, b.value)
    return Term(TEXT, done["value"], first_error(a.error, b.error, done["error"]), a.deps | b.deps)


def add(a, b) -> Term:
    return _term("add", a, b)


def sub(a, b) -> Term:
    return _term("sub", a, b)


def mul(a, b) -> Term:
    return _term("mul", a, b)


def div(a, b) -> Term:
    return _term("div", a, b)


def mod(a, b) -> Term:
    return _term("mod", a, b)


def round_(x, n) -> Term:
    """n may differ by row, up to a million digits."""
    return _term("round", x, n)


def power(x, n) -> Term:
    """n may differ by row, up to 100 000."""
    return _term("power", x, n)
