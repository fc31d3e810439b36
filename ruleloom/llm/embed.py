"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions (one random orthonormal projection per table) and decoded to the nearest
point of the E8 lattice. A vector is indexed under its own cell and asks its own cell and the nearest neighbouring cells
(minimal lattice vectors, by distance). What meets in a cell of the same label is confirmed by cosine in double precision,
in blocks of bounded size; a block sends sums and a spanning forest, not pairs. A pair is counted where it meets first, so
no pair list has to be made distinct.

Projecting d dimensions to eight shrinks distances by about sqrt(8 / d), so the scale grows with sqrt(d): SCALE holds at 64
dimensions. With the defaults nearly all pairs at cosine 0.98 meet; the tests measure it from 8 to 768 dimensions.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null label, link
with nothing and are their own component; rows with a null id have no component and are kept; equal vectors are one class
and all linked; vectors of different length do not link; of different vectors under one id, all are one node; repeated
rows each count as a vector; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, dealt_join, freeing, group_starts, mix, slices, whole_groups
from .components import components

TABLES, PROBES, SCALE, BLOCK = 5, 4, 8.0, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _neighbours() -> np.ndarray:
    """The 240 minimal vectors of E8."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(pairs + halves)


@lru_cache(maxsize=64)
def _projection(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240301, table, dim])
    return np.linalg.qr(rng.normal(size=(dim, 8)))[0], rng.random(8)


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8: integers with an even sum."""
    k = np.rint(y)
    e = y - k
    odd = np.flatnonzero(k.sum(1).astype(np.int64) & 1)
    j = np.abs(e[odd]).argmax(1)
    k[odd, j] += np.where(e[odd, j] >= 0, 1, -1)
    return k


def decoded(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the better one of D8 and D8 moved by a half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _name(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of lattice points."""
    h = np.broadcast_to(salt, points.shape[:-1]).astype(np.uint64)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for i in range(8):
        h = mix(h * _STEP + twice[..., i])
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(vectors, TABLES, 1 + PROBES) cell names; the first is the own cell."""
    n, dim = unit.shape
    if dim < 8:
        unit = np.concatenate([unit, np.zeros((n, 8 - dim))], 1)
    out = np.empty((n, TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        turn, shift = _projection(t, max(8, dim))
        y = unit @ turn * (SCALE * np.sqrt(max(8, dim) / 64)) + shift
        own = decoded(y)
        near = np.argpartition(-((y - own) @ _neighbours().T), PROBES, axis=1)[:, :PROBES]
        points = np.concatenate([own[:, None], own[:, None] + _neighbours()[near]], 1)
        salt = mix(label.astype(np.int64).view(np.uint64) * _STEP + np.uint64(t * 65536 + dim))
        out[:, t] = _name(points, salt[:, None])
    return out


def _units(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # neither tiny nor huge vectors leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(classes: DataFrame) -> DataFrame:
    """(key, place, rep): the cells of each class; place is table * (1 + PROBES) + probe, 0 the own cell."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            rep, label = (batch.column(i).to_numpy() for i in (0, 1))
            rows = batch.column(2).to_pylist()
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                key = cells(_units([rows[i] for i in at]), label[at]).reshape(len(at), -1)
                place = np.tile(np.arange(key.shape[1], dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(place), pa.array(np.repeat(rep[at], key.shape[1]))], names=["key", "place", "rep"])

    return classes.select("rep", "label", "embedding").mapInArrow(run, "key long, place int, rep long")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what (a, b) joins, fewer than there are nodes."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _first_meeting(kx: np.ndarray, ky: np.ndarray, x: np.ndarray, y: np.ndarray, table: int, case: np.ndarray) -> np.ndarray:
    """Whether pairs (x, y), x the smaller id, do not meet before (table, case); cases: own cells, x's own in y's probes, y's own in x's probes."""
    fresh = np.ones(len(x), bool)
    for t in range(table + 1):
        hx, hy = kx[x, t], ky[y, t]
        meets = (hx[:, 0] == hy[:, 0], (hy[:, 1:] == hx[:, :1]).any(1), (hx[:, 1:] == hy[:, :1]).any(1))
        for c, m in enumerate(meets):
            fresh &= ~m if t < table else ~(m & (c < case))
    return fresh


def _compared(blocks: DataFrame, least: float) -> DataFrame:
    """(rep, links, other): links of a class from one block, or with links null an edge of its forest."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"]):
            side, place, rep, label, n = (t.column(c).to_numpy() for c in ("side", "place", "rep", "label", "n"))
            rows = t.column("embedding").to_pylist()
            cuts = np.append(group_starts(t, ["key", "i", "j"]), t.num_rows)
            got: list[tuple[int, int | None, int | None]] = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                home, ask = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                if not len(home) or not len(ask) or len(np.unique(rep[s:e])) < 2:
                    continue
                if len({len(rows[i]) for i in range(s, e)}) > 1:
                    continue  # vectors of different length: only a collision of names brings them together
                u, v = _units([rows[i] for i in home]), _units([rows[i] for i in ask])
                cosine = u @ v.T
                own = place[ask] % (1 + PROBES) == 0
                ok = (cosine >= least) & (label[home][:, None] == label[ask]) & (rep[home][:, None] != rep[ask])
                ok &= ~own | (rep[home][:, None] < rep[ask])  # two own cells meet twice in a block pair
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                iu, i = np.unique(i, return_inverse=True)
                ju, j = np.unique(j, return_inverse=True)
                kh, ka = cells(u[iu], label[home[iu]]), cells(v[ju], label[ask[ju]])
                a, b = rep[home[iu[i]]], rep[ask[ju[j]]]
                table = int(place[home[0]]) // (1 + PROBES)
                less = a < b
                case = np.where(own[ju[j]], 0, np.where(less, 1, 2))
                fresh = np.empty(len(a), bool)
                for w in (True, False):
                    m = less == w
                    fresh[m] = _first_meeting(kh, ka, i[m], j[m], table, case[m]) if w else _first_meeting(ka, kh, j[m], i[m], table, case[m])
                got += [(x, None, y) for x, y in _forest(a, b)]
                for ids, links in ((a[fresh], n[ask[ju[j]]][fresh]), (b[fresh], n[home[iu[i]]][fresh])):
                    uid, at = np.unique(ids, return_inverse=True)
                    got += [(x, c, None) for x, c in zip(uid.tolist(), np.bincount(at, links).astype(np.int64).tolist(), strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["rep", "links", "other"])

    return blocks.mapInArrow(run, "rep long, links long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    bounded_batches(vectors.sparkSession)
    scratch = Scratch(vectors.sparkSession, "embed")
    rows = vectors.selectExpr(f"`{id_col}` as vec_id", f"`{vector}` as embedding", f"cast(`{label}` as long) as label")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("h0", F.xxhash64("label", "embedding")).withColumn("h1", F.xxhash64("embedding", "label", F.lit(7)))
    classes = rows.where("ok").groupBy("h0", "h1").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    full = dealt_join(rows.where("ok").select("vec_id", "label", "embedding", "h0", "h1"), classes, ["h0", "h1"], "vec_id").where("vec_id = rep")
    classes = scratch.keep(full.dropDuplicates(["h0", "h1"]).select("h0", "h1", "rep", "n", "label", "embedding"))

    entries = scratch.keep(_entries(classes))
    home = (F.col("place") % (1 + PROBES) == 0).cast("int")
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.sum(home).alias("homes"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("homes > 0 and least <> most").select("key", "all", "homes")
    met = dealt_join(entries, met, ["key"], "rep")
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ni, nj = chunks("homes"), chunks("all")
    cols = ["key", "i", "j", "side", "place", "rep"]
    left = met.where(home == 1).withColumn("i", own(ni)).withColumn("j", every(nj)).withColumn("side", F.lit(0)).select(cols)
    right = met.withColumn("j", own(nj)).withColumn("i", every(ni)).withColumn("side", F.lit(1)).select(cols)
    blocks = left.unionAll(right).join(classes.select("rep", "label", "n", "embedding"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.keep(_compared(blocks, least))
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(scratch, found.where("links is null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    scratch.drop(entries)
    by_class = classes.select("h0", "h1", "rep", "n").join(links, "rep", "left").join(joined, "rep", "left")
    by_class = by_class.select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    answer = rows.select("vec_id", "ok", "h0", "h1").join(by_class, ["h0", "h1", "ok"], "left")
    return answer.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
