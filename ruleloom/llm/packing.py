"""Packing of token ids into sequences of near-equal size.

Whole windows are cut off long documents. What is left of each document is pooled in the task that encoded it (no
shuffle), and each pool is dealt to windows by Karmarkar-Karp multiway differencing: the two partial partitions with the
largest spread are merged with opposing imbalances until one is left. The number of windows starts at the least that can
hold the pool and rises by one whenever a window exceeds the capacity. So that it seldom rises, which is padding, a small
share of the pool (the longest tails) is cut into small pieces of falling size, which even out the windows; all other tails
stay whole. Where the count would rise by more than a hundredth, as with many tails of one awkward size, that share is
doubled first.

Padding: a pool that needs k windows at the least is padded by less than one window, and by one more for each time k rises
(seldom: see the tests). A task packs its pools alone, so each input partition also ends in a padded window.

Defined results: a null or empty text is the closing id alone; repeated rows are each packed; a null id is kept as
null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, texts_of
from .tokens import encoding, ids_of, vocabulary_file

CAPACITY, CLOSING, POOL = 2048, 1, 1024
#: Share of a pool's tokens that is cut into small pieces, and the sizes of these pieces in turn.
SAND, GRAINS = 0.06, (128, 64, 32, 16, 8, 4, 2, 1, 1)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[int]:
    """Window of each item: Karmarkar-Karp for k windows. Slots of a partial partition are kept in descending order."""
    n = len(sizes)
    if k == 1 or n == 0:
        return [0] * n
    sums: list[np.ndarray | None] = []
    made: list[tuple[int, int, np.ndarray] | None] = []  # left, right, order of the merged slots
    for s in sizes:
        v = np.zeros(k, np.int64)
        v[0] = s
        sums.append(v)
        made.append(None)
    agenda = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(agenda)
    while len(agenda) > 1:
        _, a = heapq.heappop(agenda)
        _, b = heapq.heappop(agenda)
        both = sums[a] + sums[b][::-1]
        sums[a] = sums[b] = None
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums.append(both)
        made.append((a, b, order))
        heapq.heappush(agenda, (int(both[-1] - both[0]), len(made) - 1))
    window = [0] * n
    stack = [(agenda[0][1], np.arange(k))]
    while stack:
        node, at = stack.pop()  # at: window of each slot
        if made[node] is None:
            window[node] = int(at[0])
            continue
        a, b, order = made[node]
        before = np.empty(k, np.int64)
        before[order] = at
        stack += [(a, before), (b, before[::-1])]
    return window


def _sanded(sizes: list[int], share: float) -> list[tuple[int, int, int]]:
    """(item, start, length) of all items; the longest ones, up to a share of the sum, are cut into grains."""
    left, out = share * sum(sizes), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, at = sizes[item], 0
        fine = left > 0 and size >= GRAINS[0]
        grains = itertools.cycle(GRAINS) if fine else itertools.repeat(size)
        left -= size * fine
        while at < size:
            n = min(next(grains), size - at)
            out.append((item, at, n))
            at += n
    return out


def _dealt(pieces: list[tuple[int, int, int]], k: int) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for piece, w in zip(pieces, differencing([n for _, _, n in pieces], k), strict=True):
        out[w].append(piece)
    return out


def windows(sizes: list[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length), none above the capacity. Without cut, items stay whole."""
    if max(sizes, default=0) > capacity:
        raise ValueError("an item is larger than a window")
    fits = lambda got: max(sum(n for _, _, n in own) for own in got) <= capacity
    least = k = max(1, -(-sum(sizes) // capacity))
    pieces, share = [(i, 0, n) for i, n in enumerate(sizes)], 0.0
    while not fits(got := _dealt(pieces, k)):
        if cut and share < 1 and (share == 0 or k >= least + least // 100):
            share = min(1.0, share * 2 or SAND)
            pieces, k = _sanded(sizes, share), least
        else:
            k += 1
    return [_joined(own) for own in got if own]


def _joined(own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces of one window in order, those that follow each other in their item as one."""
    out: list[tuple[int, int, int]] = []
    for item, start, n in sorted(own):
        if out and out[-1][0] == item and out[-1][1] + out[-1][2] == start:
            out[-1] = (item, out[-1][1], out[-1][2] + n)
        else:
            out.append((item, start, n))
    return out


class Packer:
    """Pieces of a stream of documents; sequence ids start at first."""

    def __init__(self, first: int, capacity: int, pool: int):
        self.next, self.capacity, self.pool = first, capacity, pool
        self.tails: list[tuple[int | None, int, int, np.ndarray]] = []
        self.rows: list[tuple] = []

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.capacity
        for s in range(0, whole, self.capacity):
            self.rows.append((doc_id, s, self.capacity, zlib.crc32(ids[s : s + self.capacity]), n, self.next, 0))
            self.next += 1
        if whole < n:
            self.tails.append((doc_id, whole, n, ids[whole:].copy()))
        if len(self.tails) >= self.pool:
            self.flush()

    def flush(self) -> None:
        for own in windows([len(x[3]) for x in self.tails], self.capacity) if self.tails else []:
            offset = 0
            for item, start, length in own:
                doc_id, base, n, ids = self.tails[item]
                self.rows.append((doc_id, base + start, length, zlib.crc32(ids[start : start + length]), n, self.next, offset))
                offset += length
            self.next += 1
        self.tails = []

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING, pool: int = POOL) -> DataFrame:
    """Pieces of all documents; every id of every document lies in exactly one piece."""
    file = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(file)
        p = Packer(TaskContext.get().partitionId() << 40, capacity, pool)
        for batch in slices(batches, 1024):
            for doc_id, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                p.put(doc_id, np.array([*ids_of(enc, t), closing], "<u4"))
            yield p.taken()
        p.flush()
        yield p.taken()

    bounded_batches(docs.sparkSession)
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text}` as text").mapInArrow(run, SCHEMA)
