"""Bitwise functions on whole texts, through Arrow batches.

They equal ``logic.band``, ``bor`` and ``bxor``, which are expressions: a batch's bytes are combined at once instead of word by
word. They cross to Python, so they cannot stand inside the bodies of list functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .terms import BIN, Term, as_bytes, failed, made


def _parts(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes of an array without nulls."""
    wide = pa.types.is_large_binary(x.type)
    _, at, data = x.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1]
    return at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]


def combined(op, a: pa.Array, b: pa.Array) -> pa.Array:
    """op on the bytes of each pair; null where one is null or their lengths differ."""
    keep = pc.fill_null(pc.equal(pc.binary_length(a), pc.binary_length(b)), False)
    x = a.filter(keep)
    if not len(x):
        return pa.nulls(len(a), a.type)
    (at, left), (_, right) = _parts(x), _parts(b.filter(keep))
    out = pa.Array.from_buffers(a.type, len(x), [None, pa.py_buffer(at), pa.py_buffer(op(left, right))])
    if len(x) == len(a):
        return out
    kept = keep.to_numpy(zero_copy_only=False)
    return out.take(pa.array(np.cumsum(kept) - 1, mask=~kept))


def _bits(op, a, b) -> Term:
    a, b = as_bytes(a), as_bytes(b)

    @F.arrow_udf("binary")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return combined(op, x, y)

    uneven = failed(F.octet_length(a.value) != F.octet_length(b.value), "E_LEN_MISMATCH")
    return made(BIN, run(a.value, b.value), a, b, errors=(uneven,))


def band(a, b) -> Term:
    return _bits(np.bitwise_and, a, b)


def bor(a, b) -> Term:
    return _bits(np.bitwise_or, a, b)


def bxor(a, b) -> Term:
    return _bits(np.bitwise_xor, a, b)
