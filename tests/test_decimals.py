"""Arithmetic against Python's decimal."""

from decimal import ROUND_HALF_UP, Decimal, localcontext

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.functions.terms import as_text, text_col


def _text(d: Decimal) -> str:
    s = f"{d:f}"
    return s[1:] if s.startswith("-") and not d else s


def _divided(a: Decimal, b: Decimal) -> str:
    with localcontext() as c:
        c.prec = 80
        q = a / b
        rounded = q.quantize(Decimal(1).scaleb(-10), ROUND_HALF_UP)
        if rounded * b == a:
            s = f"{rounded:f}".rstrip("0").rstrip(".")
            return "0" if s in ("-0", "") else s
        return _text(rounded)


numbers = st.builds(lambda i, s, neg: ("-" if neg else "") + (f"{i:0{s + 1}d}"[:-s] + "." + f"{i:0{s + 1}d}"[-s:] if s else str(i)), st.integers(0, 10**9), st.integers(0, 4), st.booleans())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=50, max_size=50))
def test_against_decimal(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = text_col("a"), text_col("b")
    ops = {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b, "mod": a % b}
    got = df.select("a", "b", *(F.coalesce(as_text(x).error, as_text(x).value).alias(k) for k, x in ops.items())).collect()
    for row in got:
        x, y = Decimal(row.a), Decimal(row.b)
        with localcontext() as c:
            c.prec = 80
            want = {"add": _text(x + y), "sub": _text(x - y), "mul": _text(x * y)}
            want |= {"div": _divided(x, y), "mod": _text((x % y).quantize(Decimal(1).scaleb(min(x.as_tuple().exponent, y.as_tuple().exponent))))} if y else {"div": "E_DIV_ZERO", "mod": "E_DIV_ZERO"}
        assert {k: row[k] for k in want} == want, (row.a, row.b)
