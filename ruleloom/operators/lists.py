"""Lists inside a row: arrays of (k, v) entries. Keys are texts, "1" to "n" unless a filter left gaps.

Bodies are functions of the element's Term (and its key). They are evaluated in order and stop where the language stops:
what comes after the first false of all_, or the first true of any_, cannot fail.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.terms import BOOL, DIGITS, LIST, NUM, TEXT, Term, as_bool, as_num, as_text, failed, failing, first_error, made, term


class Record:
    """An element with named fields: record["QTY"]. Unknown names are E_NO_KEY where they are reached."""

    kind = "record"

    def __init__(self, col: Column, fields: dict[str, Callable[[Column], Term]]):
        self.col, self.fields = col, fields

    def __getitem__(self, name: str) -> Term:
        return self.fields[name](self.col[name]) if name in self.fields else failing("E_NO_KEY")


def records(fields: dict[str, Callable[[Column], Term]]) -> Callable[[Column], Record]:
    """Element type of a list of structs, from a Term builder for each field."""
    return lambda c: Record(c, fields)


def of_array(x: Term, of: Callable[[Column], object]) -> Term:
    """A list of an array column's elements, with ordinal keys."""
    entries = F.transform(x.value, lambda v, i: F.struct((i + 1).cast("string").alias("k"), v.alias("v")))
    return replace(x, kind=LIST, value=entries, of=of)


def list_col(name: str, of: Callable[[Column], object]) -> Term:
    """A column of arrays; null is the empty list."""
    empty = F.coalesce(F.col(name), F.array())
    return of_array(Term(LIST, empty, None, frozenset({name})), of)


def array_of(*items) -> Term:
    """A list of Terms of one kind."""
    terms = [term(i) for i in items]
    if all(t.kind == NUM for t in terms):
        scale, whole = max(t.scale for t in terms), max(t.precision - t.scale for t in terms)
        cast = f"decimal({min(DIGITS, whole + scale)},{scale})"
        made_ = F.array(*(F.struct(t.value.cast(cast).alias("n"), (F.lit(t.scale) if t.shown is None else t.shown).alias("s")) for t in terms))
        of = lambda c: Term(NUM, c["n"], precision=min(DIGITS, whole + scale), scale=scale, shown=c["s"])
    else:
        terms = [as_text(t) for t in terms]
        made_, of = F.array(*(t.value for t in terms)), lambda c: Term(TEXT, c)
    return of_array(made(LIST, made_, *terms), of)


def count(x) -> Term:
    """Number of elements; 0 for a scalar."""
    x = term(x)
    n = F.size(x.value) if x.kind == LIST else F.lit(0)
    return made(NUM, n.cast("decimal(10,0)"), x, precision=10)


def indexes(x: Term) -> Term:
    return of_array(made(LIST, F.transform(x.value, lambda e: e["k"]), x), lambda c: Term(TEXT, c))


def has(x: Term, key) -> Term:
    key = as_text(key)
    return made(BOOL, F.exists(x.value, lambda e: e["k"] == key.value), x, key)


def index(x: Term, key):
    """The element under a key; E_NO_KEY if there is none."""
    if x.kind != LIST:
        return failing("E_NO_KEY", TEXT, x)
    entry = F.get(F.filter(x.value, lambda e: e["k"] == F.lit(str(key))), F.lit(0))
    missing = first_error(x.error, failed(entry.isNull(), "E_NO_KEY"))
    item = x.of(entry["v"])
    if isinstance(item, Record):
        late = lambda of: lambda c: _after(of(c), missing, x)
        return Record(entry["v"], {n: late(of) for n, of in item.fields.items()})
    return _after(item, missing, x)


def _after(t: Term, error: Column, x: Term) -> Term:
    return replace(t, error=first_error(error, t.error), deps=t.deps | x.deps)


def _free(x: Term, body: Callable) -> tuple[Callable[[Column], Term], list[Term]]:
    """Body as a function of an entry; the Terms it gives are kept to know what else it reads."""
    seen: list[Term] = []

    def of(entry: Column) -> Term:
        item = x.of(entry["v"])
        t = term(body(item, Term(TEXT, entry["k"])))
        seen.append(t)
        return t

    return of, seen


def _err(t: Term) -> Column:
    return F.lit(None).cast("string") if t.error is None else t.error


def _quantified(x: Term, body: Callable, stop: bool) -> Term:
    of, seen = _free(x, body)
    zero = F.struct(F.lit(not stop).alias("value"), F.lit(None).cast("string").alias("error"))

    def step(acc, entry):
        t = as_bool(of(entry))
        done = (acc["value"] == F.lit(stop)) | acc["error"].isNotNull()
        return F.when(done, acc).otherwise(F.struct(F.coalesce(t.value, acc["value"]).alias("value"), _err(t).alias("error")))

    end = F.aggregate(x.value, zero, step)
    return _closed(BOOL, end["value"], end["error"], x, seen)


def _closed(kind: str, value: Column, error: Column, x: Term, seen: list[Term], **more) -> Term:
    return replace(made(kind, value, x, errors=(error,), **more), deps=x.deps.union(*(t.deps for t in seen)))


def all_(x: Term, body: Callable) -> Term:
    """body(element, key) is true for every element; true without elements."""
    return _quantified(x, body, False)


def any_(x: Term, body: Callable) -> Term:
    return _quantified(x, body, True)


def _first_failure(x: Term, of: Callable[[Column], Term]) -> Column:
    """Code of the first element whose Term fails."""
    return F.get(F.filter(F.transform(x.value, lambda en: _err(of(en))), lambda e: e.isNotNull()), F.lit(0))


def _shown(t: Term) -> Column:
    return F.lit(t.scale) if t.shown is None else t.shown


def map_(x: Term, body: Callable) -> Term:
    """List of the body's values, renumbered."""
    of, seen = _free(x, body)
    error = _first_failure(x, of)
    t = seen[-1]
    if t.kind == NUM:
        array = F.transform(x.value, lambda en: (lambda y: F.struct(y.value.alias("n"), _shown(y).alias("s")))(of(en)))
        item = lambda c: Term(NUM, c["n"], precision=t.precision, scale=t.scale, shown=c["s"])
    else:
        array, item = F.transform(x.value, lambda en: of(en).value), lambda c: Term(t.kind, c, of=t.of)
    return of_array(_closed(LIST, array, error, x, seen), item)


def filter_(x: Term, body: Callable) -> Term:
    """Elements for which the body is true; they keep their keys."""
    of, seen = _free(x, body)
    error = _first_failure(x, lambda en: as_bool(of(en)))
    kept = F.filter(x.value, lambda en: F.coalesce(as_bool(of(en)).value, F.lit(False)))
    return _closed(LIST, kept, error, x, seen, of=x.of)


def sum_(x: Term, body: Callable = lambda item, key: item) -> Term:
    """Exact sum; 0 without elements. One pass gives the sum, its fraction digits and the first error."""
    of, seen = _free(x, body)
    as_num(_sample(x, of))
    scale = as_num(seen[-1]).scale
    kind = f"decimal({DIGITS - 1},{scale})"
    zero = F.struct(F.lit(0).cast(kind).alias("n"), F.lit(0).alias("s"), F.lit(None).cast("string").alias("e"))

    def step(acc, entry):
        t = as_num(of(entry))
        total = F.try_add(acc["n"], t.value.try_cast(f"decimal({DIGITS - 2},{scale})")).try_cast(kind)
        return F.struct(total.alias("n"), F.greatest(acc["s"], _shown(t)).alias("s"), F.coalesce(acc["e"], _err(t)).alias("e"))

    end = F.aggregate(x.value, zero, step)
    error = F.when(end["n"].isNull(), F.coalesce(end["e"], F.lit("E_RANGE")))
    return replace(Term(NUM, end["n"], first_error(x.error, error), precision=DIGITS - 1, scale=scale, shown=end["s"]), deps=x.deps.union(*(t.deps for t in seen)))


def _sample(x: Term, of: Callable[[Column], Term]) -> Term:
    """The body's Term for some element, to know its kind and digits."""
    return of(F.get(x.value, F.lit(0)))


def join(x, sep) -> Term:
    """Texts of the elements with a separator between them; a scalar is one element."""
    x, sep = term(x), as_text(sep)
    if x.kind != LIST:
        return made(TEXT, as_text(x).value, sep, as_text(x))
    of, seen = _free(x, lambda item, key: as_text(item))
    error = _first_failure(x, of)
    texts = F.transform(x.value, lambda en: of(en).value)
    return replace(_closed(TEXT, F.call_function("array_join", texts, sep.value), first_error(sep.error, error), x, seen), deps=x.deps | sep.deps)


def fold(x: Term, start, step: Callable[[Term, object], Term]) -> Term:
    """General fold of a number: step(accumulator, element). Precision and scale are those of start."""
    s = as_num(start)
    kind = f"decimal({s.precision},{s.scale})"
    zero = F.struct(s.value.alias("n"), _err(s).alias("e"))

    def one(acc, entry):
        t = as_num(step(Term(NUM, acc["n"], acc["e"], precision=s.precision, scale=s.scale), x.of(entry["v"])))
        value = t.value.try_cast(kind)
        error = first_error(_err(t), failed(value.isNull(), "E_RANGE"))
        return F.when(acc["e"].isNotNull(), acc).otherwise(F.struct(value.alias("n"), error.alias("e")))

    end = F.aggregate(x.value, zero, one)
    return _closed(NUM, end["n"], end["e"], x, [], precision=s.precision, scale=s.scale)
