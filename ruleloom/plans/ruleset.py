"""Named rules over one DataFrame: one projection evaluates them all.

Modes: ``strict`` fails the query at the first error, ``capture`` gives struct(value, error) per rule. Both are plain
column expressions, so filters and column pruning reach the scan, and the same set runs on a stream.

A rule may read results of rules before it: it is then a function of them (a dict of Terms by name). A failure of a result
is a failure of what reads it, and the columns a result depends on are those of its reader too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Term, as_bool, as_text, captured, staged, strict, term


@dataclass(frozen=True)
class RuleSet:
    rules: dict[str, Term | Callable[[dict[str, Term]], object]]

    def __post_init__(self):
        done: dict[str, Term] = {}
        for n, t in self.rules.items():
            done[n] = term(t(dict(done)) if callable(t) else t)
        object.__setattr__(self, "given", dict(self.rules))
        object.__setattr__(self, "rules", done)

    def staged(self, df: DataFrame) -> tuple[DataFrame, dict[str, Term]]:
        """df with hidden columns that hold the results which rules after them may read, and the rules as Terms over it: each
        result is computed once, however often and however deep others read it."""
        last = max((i for i, t in enumerate(self.given.values()) if callable(t)), default=0)
        done: dict[str, Term] = {}
        for i, (n, t) in enumerate(self.given.items()):
            done[n] = term(t(dict(done)) if callable(t) else t)
            if i < last:
                df, one = staged(df, {f"{n}__rule": done[n]})
                done[n] = one[f"{n}__rule"]
        return df, done

    def columns(self, mode: str = "strict", names: list[str] | None = None, terms: dict[str, Term] | None = None) -> list[Column]:
        how = {"strict": lambda t: strict(_shown(t)), "capture": lambda t: captured(_shown(t))}[mode]
        return [how(term(t)).alias(n) for n, t in (terms or self.rules).items() if names is None or n in names]

    def apply(self, df: DataFrame, mode: str = "strict", keep: list[str] | None = None) -> DataFrame:
        """df (or the columns named in keep) with one column for each rule."""
        wide, terms = self.staged(df)
        return wide.select(*(df.columns if keep is None else keep), *self.columns(mode, None, terms))

    def where(self, df: DataFrame, name: str) -> DataFrame:
        """Rows for which a boolean rule holds; a row with an error fails the query."""
        return df.where(strict(as_bool(self.rules[name])))

    def dependencies(self, name: str) -> frozenset[str]:
        """Columns that a rule reads."""
        return term(self.rules[name]).deps

    def watch(self) -> dict[str, list[str]]:
        """Column to the rules that read it."""
        out: dict[str, list[str]] = {}
        for n, t in self.rules.items():
            for d in sorted(term(t).deps):
                out.setdefault(d, []).append(n)
        return out

    def rerun(self, df: DataFrame, changed: list[str], keep: list[str], mode: str = "strict") -> DataFrame:
        """Only the rules that read a changed column."""
        hit = sorted({n for c in changed for n in self.watch().get(c, [])})
        return df.select(*keep, *self.columns(mode, hit))

    def messages(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """(keep..., rule, message, error): one row for each rule that gives a text or an error. No shuffle."""
        df, terms = self.staged(df)
        each = F.array(*(F.struct(F.lit(n).alias("rule"), as_text(t).value.alias("message"), _error(as_text(t)).alias("error")) for n, t in terms.items()))
        told = F.filter(each, lambda r: r["error"].isNotNull() | (r["message"] != ""))
        return df.select(*keep, F.explode(told).alias("m")).select(*keep, "m.rule", "m.message", "m.error")

    def summary(self, df: DataFrame) -> DataFrame:
        """(rule, message, error, n): how often each message occurs."""
        return self.messages(df, []).groupBy("rule", "message", "error").agg(F.count(F.lit(1)).alias("n"))


def _shown(t: Term) -> Term:
    """Results whose fraction digits differ by row are shown as text."""
    return as_text(t) if t.kind == "num" and t.shown is not None else t


def _error(t: Term) -> Column:
    return F.lit(None).cast("string") if t.error is None else t.error


def dump(x: Term) -> Column:
    """Canonical text of a value with its kind, for tests and display."""
    x = term(x)
    if x.kind == "list":
        inner = lambda e: F.concat(F.lit('"'), e["k"], F.lit('"='), dump(x.of(e["v"])))
        return F.concat(F.lit("-{"), F.array_join(F.transform(x.value, inner), ","), F.lit("}"))
    if x.kind == "bool":
        return F.when(x.value, "TRUE").otherwise("FALSE")
    if x.kind == "bin":
        return F.concat(F.lit('b"'), F.lower(F.hex(x.value)), F.lit('"'))
    return F.concat(F.lit('t"'), as_text(x).value, F.lit('"'))


__all__ = ["RuleSet", "dump"]
