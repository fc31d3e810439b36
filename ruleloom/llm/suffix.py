"""Suffix-array removal of repeated passages.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller document, or earlier in the same
one) is removed. Strings are judged on the input.

1. Whole copies of an earlier text are found by a grouped SHA-256.
2. Each window of ``length`` bytes is named by the smallest hash of the grams of GRAM bytes in it, so equal windows have
   the same name wherever they stand. Windows with one name in a row form a segment. Names only bring segments together;
   a collision of names removes nothing.
3. Segments are shuffled by name with a BLAKE2 digest of 128 bits of their bytes. A segment whose digest occurred earlier
   is repeated as a whole; only where one name has different segments (the ends of repeats) the bytes are fetched.
4. There, segments are lined up at the naming gram, and their right and left extensions are suffix-sorted: a mergesort
   whose comparisons find the common extension by binary search over prefix hashes, logarithmic in its length. The order
   and the common extensions of neighbours are then verified byte by byte; where hashes modulo 2**64 collided, the sort is
   done again with two bases modulo a prime. For every offset, windows whose left and right parts fall in the same classes
   are equal; the earliest stays.
5. A name with more than HOT different segments is split by a further key, the digest of each window's bytes, and the
   earliest window of a key is found with map-side combine, so no task holds all segments of a common passage's end.

No removal rests on a polynomial hash alone: it is decided by compared bytes or by a cryptographic digest of them.

Defined results: null text is empty; empty and short texts lose nothing; rows with a null id have no place in the order and
lose nothing; rows that repeat an id are the same document (each is judged, none counts as earlier than the other); an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, bounded_batches, dealt_join, freeing, mix, whole_groups

LENGTH, GRAM, HOT = 100, 32, 20_000
#: Bytes handled at once by a worker; longer documents are taken in overlapping parts.
PART = 1 << 17
_BASE = np.uint64(0xD6E8FEB86659FD93)
_FROM, _COUNT = 21, (1 << 20) - 1  # bits of a packed (start, windows, flag)
_PRIME = np.uint64((1 << 31) - 1)
#: Repeated segments that a task remembers, so that a passage in many of its documents is sent once.
_REMEMBERED = 20_000


_known_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64; one pair is kept, as long as was ever needed."""
    global _known_powers
    if len(_known_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        out = []
        for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _known_powers = (out[0], out[1])
    return _known_powers


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums modulo 2**64, for names of grams: the hash of [s, e) is (p[e] - p[s]) * inverse ** s."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _tables(len(data) + 1)[0][: len(data)], out=p[1:])
    return p


def hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((p[end] - p[start]) * _tables(len(p))[1][start])


def digested(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """BLAKE2 digests of byte ranges, as two integers each."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), stop.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def _sliding(x: np.ndarray, w: int, most: bool = False) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + w] for every i with a full window."""
    f = np.maximum if most else np.minimum
    n = len(x)
    rows = -(-n // w)
    y = np.full(rows * w, 0 if most else np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(rows, w)
    ahead = f.accumulate(y, 1).ravel()
    back = f.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return f(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: start, windows, name, whether the naming gram repeats."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    n, w = len(data), length - gram + 1
    if n < length:
        return none
    p = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    g = hashes(p, at, at + gram)
    low = _sliding(g, w)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(low) + 1, np.int64)
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    inside = np.cumsum(inside)[:-1] > 0
    cut = np.ones(len(low), bool)
    cut[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    cut[starts[starts < len(low)]] = True
    first = np.flatnonzero(cut & inside)
    if not len(first):
        return none
    stop = np.ones(len(low), bool)
    stop[:-1] = cut[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    if (long := last - first >= _COUNT).any():  # packed in 20 bits
        first, last = (np.concatenate([[*range(a, b + 1, _COUNT)] if r else [*range(min(b, a + _COUNT - 1), b, _COUNT), b] for a, b in zip(first[long], last[long], strict=True)] + [q[~long]]) for r, q in ((True, first), (False, last)))
        first, last = np.sort(first), np.sort(last)
    name = low[first]
    # grams that name some window, to see which segments hold their naming gram twice
    fence = np.full(len(g) + w - 1, np.uint64(0))
    fence[w - 1 : w - 1 + len(low)] = np.where(inside, low, 0)
    names_one = np.flatnonzero(_sliding(fence, w, most=True)[: len(g)] == g)
    kinds, rank = np.unique(g[names_one], return_inverse=True)
    order = np.sort(rank * np.int64(len(g) + w + 1) + names_one)
    key = np.searchsorted(kinds, name) * np.int64(len(g) + w + 1)
    twice = np.searchsorted(order, key + last + w) - np.searchsorted(order, key + first) > 1
    return first, last - first + 1, name.view(np.int64), twice


def _laid(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of (doc_id, text) laid end to end, about PART bytes at once: data, ends, doc ids, offset in the document."""
    data: list[bytes] = []
    ids: list[int] = []
    base: list[int] = []
    size = 0

    def out():
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]), np.array(ids, np.int64), np.array(base, np.int64)

    seen: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            t, d = text.as_py(), doc_id.as_py()
            if t is None or d is None:
                continue
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw) < length:
                continue
            name = hashlib.blake2b(raw, digest_size=16).digest()
            if seen.get(name, d) < d:
                continue  # a whole copy of an earlier text
            if len(seen) > 30_000:
                seen.clear()
            seen[name] = d
            for at in range(0, max(1, len(raw) - length + 1), PART):
                piece = raw[at : at + PART + length - 1]
                data.append(piece)
                ids.append(d)
                base.append(at)
                size += len(piece)
                if size >= PART:
                    yield out()
                    data, ids, base, size = [], [], [], 0
    if data:
        yield out()


_ROW = ["slot", "name", "w0", "w1", "doc_id", "span"]
_DONE = "doc_id long, first long, stop long"


def _packed(start: np.ndarray, windows: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return (start << _FROM) | (windows << 1) | twice


def _start(span: np.ndarray) -> np.ndarray:
    return span >> _FROM


def _windows(span: np.ndarray) -> np.ndarray:
    return (span >> 1) & _COUNT


def _remembered(seen: dict, w: np.ndarray, doc: np.ndarray, span: np.ndarray, again: np.ndarray) -> None:
    """Marks first segments of this part that the task met earlier in the order; remembers those that repeat in this part."""
    heads = np.flatnonzero(~again)
    repeated = np.append(again[1:], False)[heads]
    keys = w[heads].tobytes()
    for k, i in enumerate(heads.tolist()):
        key = keys[16 * k : 16 * k + 16]
        before, own = seen.get(key), (int(doc[i]), int(span[i]))
        if before is not None and before < own:
            again[i] = True
        elif before is not None or repeated[k]:
            seen[key] = own
    if len(seen) > _REMEMBERED:
        seen.clear()


def _named(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(slot, name, w0, w1, doc_id, span): segments with their digests, to be shuffled by slot. Those that repeat within what a
    task holds at once, or that it remembers, are settled there (slot of the document, span inverted), so a passage in many
    documents is combined before the shuffle."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for data, ends, ids, base in _laid(batches, length):
            first, windows, name, twice = segments(data, ends, length, gram)
            if not len(first):
                continue
            part = np.searchsorted(ends, first, side="right")
            doc = ids[part]
            span = _packed(first - np.concatenate([[0], ends[:-1]])[part] + base[part], windows, twice.astype(np.int64))
            w = digested(data, first, first + windows - 1 + length)
            order = np.lexsort((span, doc, w[:, 1], w[:, 0]))
            name, w, doc, span = name[order], w[order], doc[order], span[order]
            again, twin = np.zeros(len(name), bool), np.zeros(len(name), bool)
            again[1:] = (w[1:] == w[:-1]).all(1)
            twin[1:] = again[1:] & (doc[1:] == doc[:-1]) & (span[1:] == span[:-1])  # a row that repeats an id
            name, w, doc, span, again = (x[~twin] for x in (name, w, doc, span, again))
            _remembered(seen, w, doc, span, again)
            w = np.where(again[:, None], 0, w)
            slot = np.where(again, mix(doc.view(np.uint64)).view(np.int64), name)
            name, span = np.where(again, 0, name), np.where(again, ~span, span)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (slot, name, w[:, 0].copy(), w[:, 1].copy(), doc, span)], names=_ROW)

    return docs.mapInArrow(run, "slot long, name long, w0 long, w1 long, doc_id long, span long")


def _told(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, name, first, stop): name null for intervals to remove, else a segment whose windows must be compared.
    Rows come sorted by (name, w0, w1, doc_id, span); one row is carried from batch to batch."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last first-of-its-kind row, if nothing that came so far shares its name
        last = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(1, 6)])
            settled = rows[4] < 0
            done = [(rows[3, settled], ~rows[4, settled])]
            rows = rows[:, ~settled]
            if rows.shape[1]:
                name, doc, span = rows[0], rows[3], rows[4]
                before = np.concatenate([rows[:, :1] if last is None else last, rows[:, :-1]], 1)
                equal = rows == before
                if last is None:
                    equal[:, 0] = False
                last = rows[:, -1:].copy()
                same_name, same, twin = equal[0], equal[:3].all(0), equal.all(0)
                done.append((doc[same & ~twin], span[same & ~twin]))
                k, d, s, cont = name[~same], doc[~same], span[~same], same_name[~same]
                if len(k):
                    if carry is not None:
                        k, d, s = (np.append(x, y) for x, y in zip(carry, (k, d, s), strict=True))
                        cont = np.append(False, cont)
                    tell = cont | np.append(cont[1:], False) | ((s & 1) == 1)
                    carry = None if tell[-1] else (k[-1], d[-1], s[-1])
                    yield _intervals(d[tell], s[tell], k[tell], length)
            yield _intervals(*(np.concatenate(x) for x in zip(*done, strict=True)), None, length)

    return rows.mapInArrow(run, "doc_id long, name long, first long, stop long")


def _intervals(doc: np.ndarray, span: np.ndarray, name: np.ndarray | None, length: int) -> pa.RecordBatch:
    first = _start(span)
    names = pa.nulls(len(doc), pa.int64()) if name is None else pa.array(name)
    return pa.RecordBatch.from_arrays([pa.array(doc), names, pa.array(first), pa.array(first + _windows(span) - 1 + length)], names=["doc_id", "name", "first", "stop"])


def _bytes_of(docs: DataFrame) -> DataFrame:
    """(name, doc_id, first, hot, bytes) of (doc_id, text, at: names, firsts, stops and whether the name is hot)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = []
                for d, t, at in zip(*(batch.slice(i, 128).column(c).to_pylist() for c in range(3)), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    rows += [(x["name"], d, x["first"], x["hot"], raw[x["first"] : x["stop"]]) for x in at]
                names, ids, first, hot, data = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(hot, pa.bool_()), pa.array(data, pa.binary())], names=["name", "doc_id", "first", "hot", "bytes"])

    return docs.mapInArrow(run, "name long, doc_id long, first long, hot boolean, bytes binary")


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, for x below 2**63."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _modulo(out * np.uint64(pow(base, len(out), int(_PRIME))))])
    return out[:n]


class Prefixes:
    """Polynomial hashes of all ranges of a buffer, modulo a prime."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        each = (data.astype(np.uint64) + np.uint64(1)) * _powers(base, n + 1)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        for at in range(0, n, 1 << 22):
            self.sums[at + 1 : at + 1 + (1 << 22)] = _modulo(np.cumsum(each[at : at + (1 << 22)]) + self.sums[at])
        self.inverse = _powers(pow(base, -1, int(_PRIME)), n + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from a and from b have one hash."""
        x, y = (_modulo((self.sums[at + n] + (_PRIME - self.sums[at])) * self.inverse[at]) for at in (a, b))
        return x == y


class Wrapped:
    """The same modulo 2**64: faster, but texts can be made whose hashes collide."""

    def __init__(self, data: np.ndarray):
        self.sums = prefix_hashes(data)
        self.inverse = _tables(len(self.sums))[1]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[a + n] - self.sums[a]) * self.inverse[a] == (self.sums[b + n] - self.sums[b]) * self.inverse[b]


class Collided(Exception):
    """The bytes do not confirm what hashes said."""


class Sorted:
    """Suffixes of one buffer in order: mergesort, with comparisons by prefix hashes. Suffix i is data[at[i] : at[i] + size[i]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray, seed: int = 0):
        self.data, self.at, self.size, self.group = data, at, size, group
        bases = np.random.default_rng([20240307, seed]).integers(1 << 20, (1 << 31) - 2, 2)
        self.prefixes = [Prefixes(data, int(b)) for b in bases] if seed else [Wrapped(data)]
        self.order = np.argsort(group, kind="stable")
        self._sort()

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            ok = np.logical_and.reduce([p.equal(a, b, mid) for p in self.prefixes])
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ex, ey = n >= self.size[x], n >= self.size[y]
        cx = np.where(ex, -1, self.data[np.minimum(self.at[x] + n, len(self.data) - 1)].astype(np.int16))
        cy = np.where(ey, -1, self.data[np.minimum(self.at[y] + n, len(self.data) - 1)].astype(np.int16))
        return cx < cy

    def _sort(self) -> None:
        """Bottom-up; two runs are merged only where a group lies on both sides of their border."""
        n, width = len(self.order), 1
        group = self.group[self.order]
        edge = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.concatenate([[0], edge]), np.append(edge, n)
        while width < n:
            mid = np.arange(width, n, 2 * width)
            mid = mid[group[mid] == group[mid - 1]]
            if len(mid):
                own = np.searchsorted(starts, mid, side="right") - 1
                a, b = np.maximum(mid - width, starts[own]), np.minimum(mid + width, ends[own])
                self._merge(a, mid, b)
            width *= 2

    def _merge(self, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> None:
        run = np.repeat(np.arange(len(a)), m - a)
        place = np.arange(len(run)) - np.repeat(np.cumsum(m - a) - (m - a), m - a)
        x = self.order[a[run] + place]
        low, high = m[run], b[run]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            smaller = self.less(self.order[mid], x[open_])  # right ones go first only if strictly smaller
            low[open_] = np.where(smaller, mid + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], mid)
        to = a[run] + place + (low - m[run])
        every = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
        right = np.repeat(m - (np.cumsum(b - m) - (b - m)), b - m) + np.arange((b - m).sum())
        y = self.order[right]
        taken = np.zeros(len(self.order), bool)
        taken[to] = True
        self.order[to] = x
        self.order[every[~taken[every]]] = y

    def neighbours(self) -> np.ndarray:
        """Common extension with the suffix before in order (0 across groups). The bytes must confirm it and the order."""
        n = np.zeros(len(self.order), np.int64)
        x, y = self.order[:-1], self.order[1:]
        i = np.flatnonzero(self.group[x] == self.group[y])
        n[i + 1] = self.common(x[i], y[i])
        step = np.arange(int(n.max(initial=0)))
        for s in range(0, len(i), 4096):
            j = i[s : s + 4096]
            mine = n[j + 1]
            inside = step < mine[:, None]
            left = self.data[np.where(inside, self.at[x[j]][:, None] + step, 0)]
            right = self.data[np.where(inside, self.at[y[j]][:, None] + step, 0)]
            ends = mine >= self.size[x[j]]
            last = len(self.data) - 1
            rises = (mine < self.size[y[j]]) & (self.data[np.minimum(self.at[x[j]] + mine, last)] < self.data[np.minimum(self.at[y[j]] + mine, last)])
            if (left != right).any() or not (ends | rises).all():
                raise Collided
        return n


def _in_order(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[Sorted, np.ndarray]:
    """Sorted suffixes and their verified common extensions; other hashes are taken until the bytes confirm them."""
    for seed in itertools.count():
        s = Sorted(data, at, size, group, seed)
        try:
            return s, s.neighbours()
        except Collided:
            continue
    raise AssertionError


def repeated_windows(name: np.ndarray, doc: np.ndarray, first: np.ndarray, data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start) of windows that occur earlier under the same name. Segments are laid end to end in data."""
    starts = np.concatenate([[0], ends[:-1]])
    p = prefix_hashes(data)
    at = np.arange(max(0, len(data) - gram + 1))
    g = hashes(p, at, at + gram)
    seg = np.searchsorted(ends, at, side="right")
    anchor = np.flatnonzero((g.view(np.int64) == name[seg]) & (at + gram <= ends[seg]))
    seg = seg[anchor]
    # windows of a segment belong to the first naming gram at or after their start
    before = np.full(len(anchor), -1)
    before[1:] = np.where(seg[1:] == seg[:-1], anchor[:-1], -1)
    from_ = np.maximum(np.maximum(starts[seg], before + 1), anchor - (length - gram))
    to = np.minimum(anchor, ends[seg] - length)
    ok = from_ <= to
    anchor, seg, from_, to = anchor[ok], seg[ok], from_[ok], to[ok]
    if not len(anchor):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    group = np.unique(name[seg], return_inverse=True)[1]
    n = len(anchor)
    right, right_common = _in_order(data, anchor, np.minimum(length, ends[seg] - anchor), group)
    left, left_common = _in_order(data[::-1], len(data) - anchor, anchor - from_, group)
    where = first[seg] + anchor - starts[seg]  # place of the anchor in its document
    earlier = np.empty(n, np.int64)
    earlier[np.lexsort((where, doc[seg]))] = np.arange(n)
    new_r, new_l = (np.concatenate([[True], np.diff(group[s.order]) != 0]) for s in (right, left))
    out_doc, out_at = [], []
    for t in range(int((anchor - from_).max()) + 1):
        valid = np.flatnonzero((anchor - to <= t) & (t <= anchor - from_))
        if len(valid) < 2:
            continue
        cr, cl = np.empty(n, np.int64), np.empty(n, np.int64)
        cr[right.order] = np.cumsum(new_r | (right_common < length - t))
        cl[left.order] = np.cumsum(new_l | (left_common < t))
        both = cr[valid] * np.int64(n + 1) + cl[valid]
        order = np.lexsort((earlier[valid], both))
        again = np.zeros(len(valid), bool)
        again[1:] = both[order][1:] == both[order][:-1]
        hit = valid[order[again]]
        out_doc.append(doc[seg[hit]])
        out_at.append(where[hit] - t)
    if not out_doc:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_at)


def _merged(doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Intervals of windows that lie in a row."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first]), pa.array(at[last] + length)], names=["doc_id", "first", "stop"])


def _compared(rows: DataFrame, length: int, gram: int) -> DataFrame:
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["name"], 8192):
            name, doc, first = (t.column(c).to_numpy() for c in ("name", "doc_id", "first"))
            one = np.sort(np.unique(np.stack([name, doc, first]), axis=1, return_index=True)[1])  # rows may repeat an id
            name, doc, first = name[one], doc[one], first[one]
            raw = t.column("bytes").take(pa.array(one)).to_pylist()
            data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw])
            yield _merged(*repeated_windows(name, doc, first, data, ends, length, gram), length)

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, _DONE)


def _hot(rows: DataFrame, length: int) -> DataFrame:
    """The same result for names with very many segments, split by a further key: the digest of each window's bytes."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                doc, first = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("doc_id", "first"))
                raw = part.column(part.schema.get_field_index("bytes")).to_pylist()
                n = np.array([len(b) for b in raw])
                data = np.frombuffer(b"".join(raw), np.uint8)
                windows = n - length + 1
                at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                s = np.repeat(np.cumsum(n) - n, windows) + at
                w = digested(data, s, s + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, windows)), pa.array(np.repeat(first, windows) + at), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], names=["doc_id", "at", "w0", "w1"])

    each = rows.mapInArrow(run, "doc_id long, at long, w0 long, w1 long")
    least = each.groupBy("w0", "w1").agg(F.min("doc_id").alias("d"), F.min_by("at", F.struct("doc_id", "at")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = dealt_join(each, least, ["w0", "w1"], "doc_id").where("doc_id > d or (doc_id = d and at > a)")
    return again.select("doc_id", F.col("at").alias("first"), (F.col("at") + length).alias("stop"))


def _fetched(docs: DataFrame, ask: DataFrame) -> DataFrame:
    """(doc_id, text, ...) of documents in ask; a Bloom filter of bounded size keeps the other texts out of the shuffle."""
    return bloom.parted(docs, ask, "doc_id")[1].join(ask, "doc_id")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, at): per document that loses something, the intervals (first, stop) to remove; they may overlap. docs: (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    usable = docs.where("doc_id is not null and text is not null")
    named = usable.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= length)
    least = named.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last")
    copies = dealt_join(named, least, ["h"], "doc_id").where("doc_id > rep").select("doc_id", F.lit(0).cast("long").alias("first"), F.col("n").alias("stop"))

    rows = _named(usable, length, gram).repartition("slot").sortWithinPartitions("name", "w0", "w1", "doc_id", "span")
    told = scratch.keep(_told(rows, length))
    ask = told.where("name is not null")
    many = ask.groupBy("name").count().where(F.col("count") > hot).select("name", F.lit(True).alias("hot"))
    ask = dealt_join(ask, many, ["name"], "doc_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_doc = ask.groupBy("doc_id").agg(F.collect_list(F.struct("name", "first", "stop", "hot")).alias("at"))
    per_doc = scratch.keep(per_doc)
    ends = scratch.keep(_bytes_of(_fetched(usable, per_doc)))
    hot_rows, cool_rows = ends.where("hot"), ends.where("not hot")
    found = copies.unionAll(told.where("name is null").select("doc_id", "first", "stop")).unionAll(_compared(cool_rows, length, gram)).unionAll(_hot(hot_rows, length))
    found = scratch.keep(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "stop")).alias("at")))
    scratch.drop(told, per_doc, ends)
    return found


def runs(at: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of intervals; runs that touch are one."""
    out: list[list[int]] = []
    for first, stop in sorted((x["first"], x["stop"]) for x in at):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in gone:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _joined(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs whose id is surely not in found, and the others with their intervals (null for none)."""
    clean, maybe = bloom.parted(docs, found, "doc_id")
    return clean, maybe.join(found.withColumnRenamed("at", "__at"), "doc_id", "left")


def digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text}` as text")
    found = repeats(docs, length, hot=hot)
    clean, other = _joined(docs, found)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for d, t, at in zip(*(batch.slice(i, 256).column(c).to_pylist() for c in range(3)), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    gone = runs(at or [])
                    rows.append((d, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(raw, gone)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    cut = other.select("doc_id", "text", "__at").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    return clean.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256")).unionAll(cut)


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut out of the text; a character goes only if all of its bytes do."""
    scratch = Scratch(docs.sparkSession, "suffix")
    found = repeats(docs.select("doc_id", "text"), length, scratch=scratch)
    clean, other = _joined(docs, found)
    schema = docs.schema
    other = other.select(*docs.columns, "__at")
    at = docs.columns.index("text")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [t if not x else shortened(t, runs(x)) for t, x in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == at else part.column(c) for c in range(part.num_columns - 1)], names=part.schema.names[:-1])

    return clean.select(*docs.columns).unionAll(other.mapInArrow(run, schema))


def shortened(text: str, gone: list[tuple[int, int]]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    whole = []
    for a, b in gone:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return without(raw, whole).decode("utf-8", "surrogatepass")
