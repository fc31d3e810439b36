"""Text functions: code points, 1-based positions (0 is not found), ASCII letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import BOOL, LIST, NUM, TEXT, Term, as_count, as_text, failed, made

BLANKS = " \t\r\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest text, in code points, that repeat and the padding functions make; beyond it is E_RANGE.
MOST = 10_000_000


def _number(v: Column, *args: Term, errors=()) -> Term:
    return made(NUM, v.cast("decimal(10,0)"), *args, errors=errors, precision=10)


def len_(x) -> Term:
    x = as_text(x)
    return _number(F.char_length(x.value), x)


def left(x, n) -> Term:
    x, (n, bad) = as_text(x), as_count(n)
    return made(TEXT, F.left(x.value, n.value), x, n, errors=(bad,))


def right(x, n) -> Term:
    x, (n, bad) = as_text(x), as_count(n)
    return made(TEXT, F.right(x.value, n.value), x, n, errors=(bad,))


def substr(x, start, length=None) -> Term:
    x, (s, bad) = as_text(x), as_count(start, 1)
    if length is None:
        return made(TEXT, F.substring(x.value, s.value, F.lit(2**31 - 1)), x, s, errors=(bad,))
    n, worse = as_count(length)
    return made(TEXT, F.substring(x.value, s.value, n.value), x, s, n, errors=(bad, worse))


def find(needle, hay, start=1) -> Term:
    needle, hay, (s, bad) = as_text(needle), as_text(hay), as_count(start, 1)
    at = F.call_function("locate", needle.value, hay.value, s.value)
    return _number(at, needle, hay, s, errors=(bad, failed(needle.value == "", "E_BAD_ARG")))


def replace(needle, by, hay) -> Term:
    needle, by, hay = as_text(needle), as_text(by), as_text(hay)
    return made(TEXT, F.replace(hay.value, needle.value, by.value), needle, by, hay, errors=(failed(needle.value == "", "E_BAD_ARG"),))


def split(x, sep: str) -> Term:
    """List of the parts between a literal separator; empty parts stay."""
    from ..operators.lists import of_array
    from .terms import failing

    x = as_text(x)
    if not sep:
        return failing("E_BAD_ARG", LIST, x)
    quoted = r"\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + r"\E"
    return of_array(made(LIST, F.split(x.value, quoted, -1), x), lambda c: Term(TEXT, c))


def trim(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.btrim(x.value, F.lit(BLANKS)), x)


def ltrim(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.ltrim(x.value, F.lit(BLANKS)), x)


def rtrim(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.rtrim(x.value, F.lit(BLANKS)), x)


def upper(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.translate(x.value, LOWER, UPPER), x)


def lower(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.translate(x.value, UPPER, LOWER), x)


def backwards(x) -> Term:
    x = as_text(x)
    return made(TEXT, F.reverse(x.value), x)


def repeat(x, n) -> Term:
    x, (n, bad) = as_text(x), as_count(n)
    big = failed(F.char_length(x.value).cast("long") * n.value > MOST, "E_RANGE")
    return made(TEXT, F.repeat(x.value, n.value), x, n, errors=(bad, big))


def _pad(x, n, fill, how) -> Term:
    x, (n, bad), fill = as_text(x), as_count(n), as_text(fill)
    value = F.when(F.char_length(x.value) >= n.value, x.value).otherwise(F.call_function(how, x.value, n.value, fill.value))
    return made(TEXT, value, x, n, fill, errors=(bad, failed(fill.value == "", "E_BAD_ARG"), failed(n.value > MOST, "E_RANGE")))


def padl(x, n, fill) -> Term:
    """Filled on the left up to n code points, never cut."""
    return _pad(x, n, fill, "lpad")


def padr(x, n, fill) -> Term:
    return _pad(x, n, fill, "rpad")


def char(n) -> Term:
    n, bad = as_count(n)
    out = failed((n.value > 0x10FFFF) | n.value.between(0xD800, 0xDFFF), "E_RANGE")
    value = F.decode(F.unhex(F.lpad(F.hex(n.value), 8, "0")), "UTF-32")
    return made(TEXT, value, n, errors=(bad, out))


def code(x) -> Term:
    x = as_text(x)
    return _number(F.ascii(x.value), x, errors=(failed(x.value == "", "E_RANGE"),))


def is_blank(x) -> Term:
    """Whether nothing but blanks is there."""
    x = as_text(x)
    return made(BOOL, F.btrim(x.value, F.lit(BLANKS)) == "", x)
