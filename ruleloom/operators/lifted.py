"""Aggregates lifted onto a child table: one grouped aggregation instead of nested lists.

A parent's list is the set of child rows with its key. Sums, counts and quantifiers become partial (map-side combined)
aggregates, so a parent with many children is no hot spot; the result is joined to the parents by key. Results equal those
of operators.lists on the same rows (tested), including the first error in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import BOOL, DIGITS, NUM, TEXT, Term, as_bool, as_num, as_text, failed, first_error


@dataclass(frozen=True)
class Lifted:
    """An aggregate over child rows: columns to compute, and a Term over the joined row."""

    aggs: tuple
    result: object


def _err(t: Term) -> Column:
    return F.lit(None).cast("string") if t.error is None else t.error


def _where(where) -> Column:
    return F.lit(True) if where is None else as_bool(where).value


def _first(error: Column, order: Column | None) -> Column:
    return F.min(error) if order is None else F.min_by(error, F.when(error.isNotNull(), order))


def sum_(x, where=None, order: Column | None = None) -> Lifted:
    t, w = as_num(x), _where(where)
    shown = F.lit(t.scale) if t.shown is None else t.shown
    value = F.when(w, t.value.try_cast(f"decimal({DIGITS - 10},{t.scale})"))
    over = failed(w & value.isNull() & _err(t).isNull(), "E_RANGE")
    error = F.coalesce(F.lit(None).cast("string") if where is None else _err(as_bool(where)), F.when(w, F.coalesce(_err(t), over)))

    def result(n):
        total = F.coalesce(F.col(n[0]), F.lit(0).cast(f"decimal({DIGITS},{t.scale})"))
        return Term(NUM, F.when(F.col(n[2]).isNull(), total), F.col(n[2]), frozenset(), DIGITS, t.scale, F.coalesce(F.col(n[1]), F.lit(0)))

    return Lifted((F.sum(value), F.max(F.when(w, shown)), _first(error, order)), result)


def count(where=None, order: Column | None = None) -> Lifted:
    w = _where(where)
    error = F.lit(None).cast("string") if where is None else _err(as_bool(where))

    def result(n):
        return Term(NUM, F.when(F.col(n[1]).isNull(), F.coalesce(F.col(n[0]), F.lit(0)).cast("decimal(19,0)")), F.col(n[1]), frozenset(), 19)

    return Lifted((F.count_if(F.coalesce(w, F.lit(False))), _first(error, order)), result)


def _quantified(p, stop: bool, order: Column | None) -> Lifted:
    """The first event in order decides: the stopping value, or an error."""
    t = as_bool(p)
    event = F.when(_err(t).isNotNull(), _err(t)).when(t.value == F.lit(stop), F.lit(""))

    def result(n):
        e = F.col(n[0])
        value = F.when(e == "", F.lit(stop)).when(e.isNull(), F.lit(not stop))
        return Term(BOOL, value, F.when(e != "", e))

    return Lifted((_first(event, order),), result)


def all_(p, order: Column | None = None) -> Lifted:
    return _quantified(p, False, order)


def any_(p, order: Column | None = None) -> Lifted:
    return _quantified(p, True, order)


def join(x, sep: str, order: Column, where=None) -> Lifted:
    """Texts of the rows in order, with a separator. The list of one parent is gathered; use it where lists are short."""
    t, w = as_text(x), _where(where)
    error = F.coalesce(F.lit(None).cast("string") if where is None else _err(as_bool(where)), F.when(w, _err(t)))
    rows = F.collect_list(F.when(w & t.value.isNotNull(), F.struct(order.alias("o"), t.value.alias("v"))))

    def result(n):
        texts = F.array_join(F.transform(F.array_sort(F.col(n[0])), lambda r: r["v"]), sep)
        return Term(TEXT, F.when(F.col(n[1]).isNull(), F.coalesce(texts, F.lit(""))), F.col(n[1]))

    return Lifted((rows, _first(error, order)), result)


def first(x, order: Column, precision: int | None = None, scale: int = 0) -> Lifted:
    """The first row's value (E_NO_KEY without rows)."""
    t = as_num(x) if precision is not None else as_text(x)

    def result(n):
        missing = failed(F.col(n[2]).isNull(), "E_NO_KEY")
        value = F.when(F.coalesce(F.col(n[2]), F.lit(0)) > 0, F.col(n[0]))
        more = {"precision": precision, "scale": scale} if precision is not None else {}
        return Term(t.kind, value, first_error(missing, F.col(n[1])), frozenset(), **more)

    return Lifted((F.min_by(t.value, order), F.min_by(_err(t), order), F.count(F.lit(1))), result)


def attach(parents: DataFrame, children: DataFrame, on: str | list[str], aggregates: dict[str, Lifted]) -> tuple[DataFrame, dict[str, Term]]:
    """Parents with hidden aggregate columns, and the Terms that read them. Every parent stays, also without children."""
    keys = [on] if isinstance(on, str) else on
    names = {a: [f"__{a}_{i}" for i in range(len(x.aggs))] for a, x in aggregates.items()}
    cols = [c.alias(n) for a, x in aggregates.items() for n, c in zip(names[a], x.aggs, strict=True)]
    joined = parents.join(children.groupBy(*keys).agg(*cols), keys, "left")
    return joined, {a: x.result(names[a]) for a, x in aggregates.items()}


def members(parents: DataFrame, children: DataFrame, on: str, present: bool = True) -> DataFrame:
    """Parents whose key is (or is not) among the children's: IN and its negation over a relation."""
    return parents.join(children.select(on), on, "left_semi" if present else "left_anti")


__all__ = ["Lifted", "all_", "any_", "attach", "count", "first", "join", "members", "sum_"]
