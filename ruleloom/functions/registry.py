"""Functions of the host by name, beside the built-in ones. A builder composes Terms, so what it adds runs in Spark like them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from .terms import LIST, Term, first_error, term


@dataclass(frozen=True)
class Function:
    least: int
    most: int | None
    builder: Callable[..., object]
    lazy: bool


_FUNCTIONS: dict[str, Function] = {}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def register_function(name: str, arity: int | tuple[int, int | None], builder: Callable[..., object], lazy: bool = False) -> None:
    """Adds a function of a fixed number of arguments, or of (least, most or None for any).

    A strict builder sees arguments without errors: the first error of any argument, in their order, comes before what the
    builder makes. A lazy builder gets the arguments as they are, so it decides which of them count, as ``if_`` does.
    """
    least, most = (arity, arity) if isinstance(arity, int) else arity
    if not _NAME.match(name) or least < 0 or (most is not None and most < least):
        raise ValueError(f"not a function: {name!r} of {arity!r}")
    if name.upper() in _FUNCTIONS:
        raise ValueError(f"{name} is registered already")
    _FUNCTIONS[name.upper()] = Function(least, most, builder, lazy)


def unregister_function(name: str) -> None:
    _FUNCTIONS.pop(name.upper(), None)


def call(name: str, *args) -> Term:
    """Result of a registered function; an unknown name and a wrong number of arguments are known when the rule is built."""
    f = _FUNCTIONS.get(name.upper())
    if f is None:
        raise LookupError(f"E_UNKNOWN_FUNC: {name}")
    if len(args) < f.least or (f.most is not None and len(args) > f.most):
        raise TypeError(f"E_ARITY: {name} with {len(args)} arguments")
    terms = [term(a) for a in args]
    if f.lazy:
        return term(f.builder(*terms))
    out = term(f.builder(*(replace(t, error=None) for t in terms)))
    before = first_error(*(t.error for t in terms))
    if before is None:
        return out
    error = first_error(before, out.error)
    value = out.value if out.kind == LIST else F.when(error.isNull(), out.value)
    return replace(out, value=value, error=error, deps=out.deps.union(*(t.deps for t in terms)), literal=None)


__all__ = ["call", "register_function", "unregister_function"]
