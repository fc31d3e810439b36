"""Exact numbers: arithmetic, comparison and the numeric functions.

Result scales: + - % the larger one, * their sum, / the least one if the quotient is exact within ten digits, else ten
(rounded half away from zero). What does not fit in 38 digits is E_RANGE (functions.exact has no such bound). Where the
operands' declared digits prove that a result fits, it is a plain decimal expression without a range test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import BOOL, DIGITS, NUM, NUMBER, TEXT, Term, as_num, as_text, failed, failing, first_error, let, made, term

QUOTIENT = 10  # fraction digits of an inexact quotient
#: Fraction digits that a product of numbers from texts holds.
PRODUCT = 18
#: Limits of the language (fixed values).
ROUND_MOST, POWER_MOST = 1_000_000, 100_000


def _shown(x: Term) -> Column:
    return F.lit(x.scale) if x.shown is None else x.shown


def _fit(value: Column, precision: int, scale: int, a: Term, b: Term, shown: Column | None, *errors: Column | None) -> Term:
    precision = min(DIGITS, precision)
    return made(NUM, value.try_cast(f"decimal({precision},{scale})"), a, b, errors=errors, precision=precision, scale=scale, shown=shown)


def _wide(x: Term, scale: int, room: int = 1) -> Column:
    """x with this scale, and room for more digits before the largest precision."""
    return x.value.try_cast(f"decimal({min(DIGITS - room, x.precision - x.scale + scale)},{scale})")


def _range(result: Column, *args: Term) -> Column:
    """E_RANGE where all arguments have values and the result has none."""
    have = F.lit(True)
    for a in args:
        have = have & a.value.isNotNull()
    return failed(have & result.isNull(), "E_RANGE")


def _sure(value: Column, precision: int, scale: int, *args: Term, shown: Column | None = None) -> Term:
    """A result that fits by its operands' digits."""
    error = first_error(*(x.error for x in args))
    return Term(NUM, value.cast(f"decimal({precision},{scale})"), error, frozenset().union(*(x.deps for x in args)), precision, scale, shown)


def _linear(a: Term, b: Term, op, exact) -> Term:
    a, b = as_num(a), as_num(b)
    scale = max(a.scale, b.scale)
    precision = max(a.precision - a.scale, b.precision - b.scale) + scale + 1
    shown = None if a.shown is None and b.shown is None else F.greatest(_shown(a), _shown(b))
    if precision <= DIGITS:
        return _sure(exact(a.value, b.value), precision, scale, a, b, shown=shown)
    value = op(_wide(a, scale), _wide(b, scale))
    return _fit(value, precision, scale, a, b, shown, _range(value, a, b))


def add(a, b) -> Term:
    return _linear(a, b, F.try_add, lambda x, y: x + y)


def sub(a, b) -> Term:
    return _linear(a, b, F.try_subtract, lambda x, y: x - y)


def neg(a) -> Term:
    a = as_num(a)
    return made(NUM, -a.value, a, precision=a.precision, scale=a.scale, shown=a.shown)


def mul(a, b) -> Term:
    a, b = as_num(a), as_num(b)
    if a.shown is not None or b.shown is not None:
        return _mul_by_row(a, b)
    scale = a.scale + b.scale
    if a.precision + b.precision + 1 <= DIGITS:
        return _sure(a.value * b.value, a.precision + b.precision + 1, scale, a, b)
    if scale > DIGITS - 2:
        return failing("E_RANGE", NUM, a, b)
    over = a.precision + b.precision + 1 - DIGITS
    pa = max(a.scale + 1, a.precision - (over + 1) // 2)
    pb = max(b.scale + 1, DIGITS - 1 - pa)
    pa = min(pa, DIGITS - 1 - pb)
    x, y = a.value.try_cast(f"decimal({pa},{a.scale})"), b.value.try_cast(f"decimal({pb},{b.scale})")
    value = F.try_multiply(x, y)
    return _fit(value, a.precision + b.precision + 1, scale, a, b, None, _range(value, a, b))


def _mul_by_row(a: Term, b: Term) -> Term:
    """Product of numbers whose fraction digits differ by row: their digits are multiplied as whole numbers."""
    scale, shown = min(a.scale + b.scale, PRODUCT), _shown(a) + _shown(b)

    def placed(digits, shown):
        size = F.lpad(F.abs(digits).cast("string"), F.greatest(F.char_length(F.abs(digits).cast("string")), shown + 1), "0")
        cut = F.char_length(size) - shown
        whole, rest = F.substring(size, F.lit(1), cut), F.substring(size, cut + 1, shown)
        return F.concat(F.when(digits < 0, "-").otherwise(""), whole, F.lit("."), rest, F.lit("0")).try_cast(f"decimal({DIGITS},{scale})")

    value = let(lambda d, s: F.when(s <= scale, placed(d, s)), F.try_multiply(_whole_digits(a), _whole_digits(b)), shown)
    return made(NUM, value, a, b, errors=(_range(value, a, b),), precision=DIGITS, scale=scale, shown=shown)


def _whole_digits(x: Term) -> Column:
    """x without its decimal point, by the digits each row shows."""
    return F.replace(as_text(x).value, F.lit("."), F.lit("")).try_cast("decimal(38,0)")


def div(a, b) -> Term:
    """Long division: a remainder decides rounding and exactness. Ten more digits for the quotient, and the difference in scale."""
    a, b = as_num(a), as_num(b)
    whole = a.precision - a.scale + b.scale  # digits before the point
    zero = failed(b.value == 0, "E_DIV_ZERO")
    if a.precision > DIGITS - QUOTIENT - 2 or whole + QUOTIENT > 27:
        return _div_by_row(a, b, zero)
    n = a.value * F.lit(str(10**QUOTIENT)).cast(f"decimal({QUOTIENT + 1},0)")
    m = F.nullif(b.value, F.lit(0).cast(f"decimal({b.precision},{b.scale})"))
    rest = n % m
    away = F.when((a.value < 0) == (b.value < 0), 1).otherwise(-1)
    q = ((n - rest) / m).cast("decimal(27,0)") + F.when(F.abs(rest) * 2 >= F.abs(b.value), away).otherwise(0)
    precision = min(DIGITS, whole + 1 + QUOTIENT)
    value = (q.cast("decimal(27,0)") * F.lit("0.0000000001").cast("decimal(10,10)")).cast(f"decimal({precision},{QUOTIENT})")
    shown = F.when(rest == 0, _least_digits(value)).otherwise(QUOTIENT)
    return Term(NUM, value, first_error(a.error, b.error, zero), a.deps | b.deps, precision, QUOTIENT, shown)


def _least_digits(v: Column) -> Column:
    """Fraction digits of a quotient without closing zeros."""
    return F.lit(QUOTIENT) - F.char_length(F.regexp_extract(v.cast("string"), r"(0*)\z", 1))


def _div_by_row(a: Term, b: Term, zero: Column) -> Term:
    """The same on whole numbers, where the declared digits do not prove that all fits."""
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").try_cast("decimal(38,0)")
    up, down = F.greatest(_shown(b) - _shown(a), F.lit(0)) + QUOTIENT, F.greatest(_shown(a) - _shown(b), F.lit(0))
    n = F.try_multiply(F.abs(_whole_digits(a)), power(up))
    m = F.nullif(F.try_multiply(F.abs(_whole_digits(b)), power(down)), F.lit(0).cast("decimal(38,0)"))

    def quotient(n, m, r, minus):
        q = F.try_divide((n - r).try_cast("decimal(38,0)"), m).try_cast("decimal(28,0)") + F.when(r * 2 >= m, 1).otherwise(0)
        size = (q.try_cast("decimal(27,0)") * F.lit("0.0000000001").cast("decimal(10,10)")).try_cast(f"decimal(38,{QUOTIENT})")
        return let(lambda v: F.struct(F.when(minus, -v).otherwise(v).alias("value"), F.when(r == 0, _least_digits(v)).otherwise(QUOTIENT).alias("shown")), size)

    done = let(lambda n, m, minus: let(quotient, n, m, n % m, minus), n, m, (a.value < 0) != (b.value < 0))
    value, shown = done["value"], done["shown"]
    return made(NUM, value, a, b, errors=(zero, failed(a.value.isNotNull() & (b.value != 0) & value.isNull(), "E_RANGE")), precision=DIGITS, scale=QUOTIENT, shown=shown)


def mod(a, b) -> Term:
    a, b = as_num(a), as_num(b)
    scale = max(a.scale, b.scale)
    x, y = _wide(a, scale, 0), _wide(b, scale, 0)
    value = x % F.nullif(y, F.lit(0).cast(f"decimal({scale + 1},{scale})"))
    shown = None if a.shown is None and b.shown is None else F.greatest(_shown(a), _shown(b))
    return _fit(value, max(a.precision - a.scale, b.precision - b.scale) + scale, scale, a, b, shown, failed(b.value == 0, "E_DIV_ZERO"))


def compare(a, b, op) -> Term:
    """Numbers of texts are compared digit by digit, so any number of digits will do."""
    a, b = term(a), term(b)
    long = lambda x: x.kind == TEXT and (x.literal is None or len(x.literal) > DIGITS)
    if (long(a) or long(b)) and {a.kind, b.kind} <= {TEXT, NUM}:
        return _compare_texts(a, b, op)
    a, b = as_num(a), as_num(b)
    return made(BOOL, op(a.value, b.value), a, b)


def _compare_texts(a: Term, b: Term, op) -> Term:
    sides, errors = [], []
    for x in (a, b):
        t = as_text(x)
        bad = failed(~t.value.rlike(NUMBER), "E_NOT_NUM") if x.kind == TEXT else None
        errors += [t.error, bad]
        whole = F.regexp_extract(t.value, r"^-?0*([0-9]*)", 1)
        part = F.regexp_extract(t.value, r"\.([0-9]*?)0*\z", 1)
        sign = F.when((whole == "") & (part == ""), 0).when(t.value.startswith("-"), -1).otherwise(1)
        sides.append(F.struct(sign.alias("sign"), F.struct(F.char_length(whole).alias("n"), whole.alias("whole"), part.alias("part")).alias("size")))
    told = let(lambda x, y: F.when(x["sign"] != y["sign"], op(x["sign"], y["sign"])).when(x["sign"] >= 0, op(x["size"], y["size"])).otherwise(op(y["size"], x["size"])), *sides)
    error = first_error(*errors)
    return Term(BOOL, told if error is None else F.when(error.isNull(), told), error, a.deps | b.deps)


def abs_(x) -> Term:
    x = as_num(x)
    return made(NUM, F.abs(x.value), x, precision=x.precision, scale=x.scale, shown=x.shown)


def sign(x) -> Term:
    x = as_num(x)
    v = F.when(x.value > 0, 1).when(x.value < 0, -1).when(x.value == 0, 0)
    return made(NUM, v.cast("decimal(1,0)"), x, precision=1)


def _whole(x: Term, v: Column) -> Term:
    p = min(DIGITS, x.precision - x.scale + 1)
    return made(NUM, v.try_cast(f"decimal({p},0)"), x, precision=p)


def ceil(x) -> Term:
    x = as_num(x)
    return _whole(x, F.ceil(x.value))


def floor(x) -> Term:
    x = as_num(x)
    return _whole(x, F.floor(x.value))


def trunc(x) -> Term:
    x = as_num(x)
    return _whole(x, F.when(x.value < 0, F.ceil(x.value)).otherwise(F.floor(x.value)))


def round_(x, n: int) -> Term:
    """Exactly n fraction digits, half away from zero. n is a literal; more than 30 fraction digits are not held."""
    x = as_num(x)
    if not 0 <= n <= 30:
        return failing("E_RANGE", NUM, x)
    p = x.precision - x.scale + 1 + n
    if p <= DIGITS:
        return _sure(F.round(x.value, n), p, n, x)
    value = F.round(x.value, n).try_cast(f"decimal({DIGITS},{n})")
    return made(NUM, value, x, errors=(_range(value, x),), precision=DIGITS, scale=n)


def power(x, n: int) -> Term:
    """x to a literal whole power, by repeated squaring; the result has n times the fraction digits."""
    x = as_num(x)
    if not 0 <= n <= POWER_MOST:
        return failing("E_RANGE", NUM, x)
    if n == 0:
        return made(NUM, F.when(x.value.isNotNull(), F.lit(1)).cast("decimal(1,0)"), x, precision=1)
    if n == 1:
        return x
    half = power(x, n // 2)
    both = mul(half, half)
    return mul(both, x) if n % 2 else both


def _extreme(first, rest, better) -> Term:
    """The first of equal values wins and keeps its own fraction digits."""
    best = as_num(first)
    for y in map(as_num, rest):
        scale = max(best.scale, y.scale)
        whole = max(best.precision - best.scale, y.precision - y.scale)
        p = min(DIGITS, whole + scale)
        take = better(y.value, best.value)
        wide = [v.try_cast(f"decimal({p},{scale})") for v in (y.value, best.value)]
        shown = None if y.shown is None and best.shown is None and y.scale == best.scale else F.when(take, _shown(y)).otherwise(_shown(best))
        value = F.when(take, wide[0]).otherwise(wide[1])
        best = made(NUM, F.when(y.value.isNotNull() & best.value.isNotNull(), value), best, y, precision=p, scale=scale, shown=shown)
    return best


def min_(first, *rest) -> Term:
    return _extreme(first, rest, lambda y, best: y < best)


def max_(first, *rest) -> Term:
    return _extreme(first, rest, lambda y, best: y > best)


def isnum(x) -> Term:
    """Whether x has the form of a number; booleans and bytes have not. Errors of x itself remain."""
    x = term(x)
    if x.kind == NUM:
        return made(BOOL, F.lit(True), x)
    if x.kind != TEXT:
        return made(BOOL, F.lit(False), x)
    return made(BOOL, x.value.rlike(NUMBER), x)
