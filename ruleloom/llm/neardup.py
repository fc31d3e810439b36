"""MinHash near-duplicates with odd sketches.

1. Each text becomes its set of word shingles, 128 MinHash values, 32 bands of four and an odd sketch (the values folded
   into a 512-bit parity map).
2. Texts with the same set are one class, so copies are never paired.
3. Documents that share a band are candidates. First each bucket's members are paired with one centre only. The XOR
   population count of two odd sketches estimates how many MinHash values differ; what can reach the threshold is
   confirmed on the full sets.
4. Buckets that then still hold several components are compared in blocks of bounded size, members outside the largest
   component against all: first by sketch, then, for rows with a close pair, on the full sets. A block sends links that
   join components, not pairs, and no pair of different components is left out. The sketches of a bucket of n rows are sent
   to at most SPREAD blocks each while n is at most SPREAD * LARGE, to n / LARGE beyond it; full sets, of rows with a close
   pair in another component only, to n / BLOCK. Sketches of rows whose sets' sizes allow a link are still all compared, so
   the comparisons, not the rows moved, follow the square of a bucket of texts that share a band but are not linked.

At the threshold 0.8 a link is missed by all 32 bands with a chance of about 5e-8, and by the sketch with about 7.7e-7.

Defined results: null and empty texts, or texts without words, have no shingles and link with nothing; fewer words than a
shingle are one shingle; repeated rows get the same answer, each its own row; where one id has different texts, the one with
the smallest set hash stands for the id, and another is linked only through an equal set of some id; rows with a null id link with nothing, their
component is null and they are kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bloom
from .common import Scratch, bounded_batches, dealt_join, freeing, group_starts, mix, slices, texts_of, whole_groups
from .components import components

HASHES, BANDS, SKETCH_WORDS = 128, 32, 8
#: Rows of each side of a block of an open bucket that carries full sets.
BLOCK = 256
#: Blocks that sketches are sent to in a bucket of up to SPREAD * LARGE rows, and the most rows of a side of such a block.
SPREAD, LARGE = 16, 16_384
_REMEMBERED = 100_000
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Orders by which centres are chosen; several, so that one bad centre does not serve a document in every band.
_MASKS = (0, 0x2AAAAAAAAAAAAAAA, 0x1C71C71C71C71C71, 0x0F0F0F0F0F0F0F0F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are lower-cased (A-Z) and split at ASCII space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h = h * _STEP + w[i : i + n]
    return np.unique(mix(h))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and odd sketch of a set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[None, at : at + 2048] * _MUL[:, None] + _ADD[:, None]).min(1), out=low)
    place = np.arange(HASHES, dtype=np.uint64)
    each = mix(low.astype(np.uint64) + (place << np.uint64(32)))
    rows = each.reshape(BANDS, -1)
    band = rows[:, 0]
    for i in range(1, rows.shape[1]):
        band = mix(band * _STEP + rows[:, i])
    bits = (mix(each + np.uint64(1)) >> np.uint64(55)).astype(np.int64)
    parity = np.bincount(bits, minlength=SKETCH_WORDS * 64) & 1
    sketch = np.packbits(parity.astype(np.uint8)).view(np.uint64)
    return band.view(np.int64), sketch.view(np.int64)


def most_bits(threshold: float) -> int:
    """XOR population count up to which a pair is confirmed: that of a pair whose differing values are 5.5 deviations above the mean at the threshold."""
    d = HASHES * (1 - threshold) + 5.5 * (HASHES * threshold * (1 - threshold)) ** 0.5
    bits = SKETCH_WORDS * 64
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * d))
    return int(mean + 3)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, h0, h1, bands, sketch) of (doc_id, text)."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            n, high, lo, bands, sketches = [], [], [], [], []
            for t in texts_of(batch):
                s = shingles(t, size)
                n.append(len(s))
                if len(s):
                    both = _named(s)
                    band, sketch = signature(s)
                else:
                    both, band, sketch = np.zeros(2, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                high.append(both[0])
                lo.append(both[1])
                bands.append(band)
                sketches.append(sketch)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs)], names=["doc_id", "n_shingles", "h0", "h1", "bands", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h0 long, h1 long, bands array<long>, sketch array<long>")


def _named(s: np.ndarray) -> np.ndarray:
    """128-bit name of a set, as two integers."""
    return np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sets = [shingles(t, size) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_named(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "h0", "s"])

    return docs.mapInArrow(run, "doc_id long, h0 long, s binary")


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, s): full sets of (doc_id, h0); only sets of these documents (and of a Bloom filter's false positives) are shuffled."""
    blocks = bloom.blocks_for(ids.count())
    asked = bloom.probed(docs, "doc_id", bloom.build(ids, "doc_id", blocks), blocks).where("__possible").drop("__possible")
    return _sets(asked, size).join(ids, ["doc_id", "h0"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "s")


def _dealt(rows: DataFrame, light: bool = False) -> DataFrame:
    """Rows of open buckets as blocks of at most about BLOCK x BLOCK rows, sorted; light rows (sketches) in larger ones, so
    that they are repeated less."""
    block = F.greatest(F.lit(BLOCK), F.least(F.ceil(F.col("n") / SPREAD), F.lit(LARGE))) if light else F.lit(BLOCK)
    chunks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    ni, nj = chunks(F.col("n") - F.col("most")), chunks(F.col("n"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    minor = rows.where("component <> major").withColumn("i", own(ni)).withColumn("j", every(nj)).withColumn("side", F.lit(0))
    whole = rows.withColumn("j", own(nj)).withColumn("i", every(ni)).withColumn("side", F.lit(1))
    both = minor.unionByName(whole).drop("n", "most", "major")
    return both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _confirmed(scratch: Scratch, docs: DataFrame, names: DataFrame, pairs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. Only texts of documents in pairs are shuffled."""
    hundred = round(threshold * 100)
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct().join(names, "doc_id")
    sets = scratch.keep(_sets_of(docs, ids, size))

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * same >= hundred * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    found = scratch.keep(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    scratch.drop(sets)
    return found


def _near(left: str, right: str, most: int):
    """Whether two sketch columns differ in few enough bits."""
    return sum((F.bit_count(F.get(left, i).bitwiseXOR(F.get(right, i))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.get(left, 0).bitwiseXOR(F.get(right, 0)))) <= most


def _blocks(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of both sides of each block (key, i, j): 0, outside the bucket's largest component, and 1, all."""
    side = t.column("side").to_numpy()
    cuts = np.append(group_starts(t, ["key", "i", "j"]), t.num_rows)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)


def _close(t: pa.Table, l: np.ndarray, r: np.ndarray, most: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of different components that the sketches and the sizes of the sets allow, some rows of each side at once."""
    comp, n = t.column("component").to_numpy(), t.column("n_shingles").to_numpy()
    sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(t.num_rows, SKETCH_WORDS)
    hundred = round(threshold * 100)
    l, r = (x[np.argsort(n[x], kind="stable")] for x in (l, r))
    for at in range(0, len(l), 256):
        p = l[at : at + 256]
        first, stop = np.searchsorted(100 * n[r], hundred * n[p[0]]), np.searchsorted(hundred * n[r], 100 * n[p[-1]], side="right")
        for to in range(first, stop, 4096):
            q = r[to : min(to + 4096, stop)]
            bits = np.zeros((len(p), len(q)), np.uint16)
            for w in range(SKETCH_WORDS):
                bits += np.bitwise_count(sketch[p, w][:, None] ^ sketch[q, w])
            x, y = np.nonzero(bits <= most)
            x, y = p[x], q[y]
            ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= hundred * np.maximum(n[x], n[y]))
            yield x[ok], y[ok]


def _asked(rows: DataFrame, most: int, threshold: float) -> DataFrame:
    """(key, doc_id) of rows that are in some close pair: their sets are needed."""

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"]):
            need = np.zeros(t.num_rows, bool)
            for l, r in _blocks(t):
                for x, y in _close(t, l, r, most, threshold):
                    need[x] = need[y] = True
            yield t.select(["key", "doc_id"]).filter(pa.array(need)).combine_chunks().to_batches()[0] if need.any() else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["key", "doc_id"])

    return rows.mapInArrow(run, "key long, doc_id long")


def _across(rows: DataFrame, most: int, threshold: float) -> DataFrame:
    """Links (a, b) between different components, confirmed on the full sets within each block; enough to join what is linked
    (a block gives fewer links than it has rows). Pairs that met in an earlier band are left to that one."""
    hundred = round(threshold * 100)

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "i", "j"], 1024):
            doc, comp, key = (t.column(c).to_numpy() for c in ("doc_id", "component", "key"))
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("s")]
            got: list[tuple[int, int]] = []
            for l, r in _blocks(t):
                top: dict[int, int] = {}

                def find(c: int) -> int:
                    while top.setdefault(c, c) != c:
                        c = top[c]
                    return c

                for x, y in _close(t, l, r, most, threshold):
                    for i in np.unique(x):
                        near = y[x == i]
                        shared = bands[near] == bands[i]
                        near = near[bands[i][shared.argmax(1)] == key[i]]
                        near = near[[find(int(comp[j])) != find(int(comp[i])) for j in near]] if len(near) else near
                        if not len(near):
                            continue
                        own, size = sets[i], np.array([len(sets[j]) for j in near])
                        every = np.concatenate([sets[j] for j in near])
                        same = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                        same = np.add.reduceat(same, np.cumsum(size) - size)
                        for j in near[100 * same >= hundred * (len(own) + size - same)]:
                            p, q = find(int(comp[i])), find(int(comp[j]))
                            if p != q:
                                top[max(p, q)] = min(p, q)
                                got.append((int(doc[i]), int(doc[j])))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h0, h1) for each row of docs; h0 and h1 name its set."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text}` as text")
    most = most_bits(threshold)
    sigs = scratch.keep(signatures(docs, size))
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    twice = some.groupBy("doc_id").agg(F.min("h0").alias("low"), F.max("h0").alias("high")).where("low <> high").select("doc_id", "low")
    one = some.select("doc_id", "h0", "h1").join(twice, "doc_id", "left").where("low is null or low = h0")
    classes = scratch.keep(one.groupBy("h0", "h1").agg(F.min("doc_id").alias("rep")))
    reps = scratch.keep(some.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "h0", "h1"], "left_semi").dropDuplicates(["doc_id"]))
    names = reps.select("doc_id", "h0")

    # buckets of at least two classes, with one centre each
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    mask = F.get(F.array(*map(F.lit, _MASKS)), F.col("band") % len(_MASKS))
    shared = banded.withColumn("o", F.col("doc_id").bitwiseXOR(mask)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"), F.max("o").alias("last"), F.min("band").alias("band")).where("o <> last")
    centres = shared.select("key", "n", F.col("o").bitwiseXOR(mask).alias("centre"))
    members = scratch.keep(dealt_join(banded.select("key", "doc_id"), centres, ["key"], "doc_id"))
    sketches = reps.select("doc_id", "sketch")
    stars = members.where("doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    side = lambda c, s: sketches.select(F.col("doc_id").alias(c), F.col("sketch").alias(s))
    near = scratch.keep(stars.join(side("b", "y"), "b").join(side("a", "x"), "a").where(_near("x", "y", most)).select("a", "b"))
    links = _confirmed(scratch, docs, names, near, size, threshold)
    first = components(scratch, links)

    # buckets that still hold several components; those of two members were compared above
    placed = members.where("n > 2").select("key", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("major")).where("parts > 1").drop("parts")
    light = reps.select("doc_id", "n_shingles", "sketch")
    rows = scratch.keep(dealt_join(placed, open_, ["key"], "doc_id"))
    asked = scratch.keep(_asked(_dealt(rows.join(light, "doc_id"), light=True), most, threshold).distinct())
    ids = asked.select("doc_id").distinct().join(names, "doc_id")
    sets = scratch.keep(_sets_of(docs, ids, size).join(reps.select("doc_id", "n_shingles", "sketch", "bands"), "doc_id"))
    more = scratch.keep(_across(_dealt(rows.join(asked, ["key", "doc_id"], "left_semi").join(sets, "doc_id")), most, threshold).distinct())
    joined = components(scratch, links.unionAll(more))
    scratch.drop(reps, members, near, links, rows, asked, sets, more)
    by_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h0", "h1", F.coalesce("component", "rep").alias("component_id"))
    answer = sigs.select("doc_id", "n_shingles", "h0", "h1").join(by_class, ["h0", "h1"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), linked)
    return answer.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "h0", "h1")


def deduped(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of docs (doc_id, text, ...), one of each group of near-duplicates: the row with the smallest id.

    Rows are judged one by one: where one id has several texts, only those that near_duplicates does not keep go, and of rows
    with one id and one set one stays. Rows without words or with a null id all stay. Only texts of ids that lose a
    row (and a Bloom filter's false positives) are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "deduped")
    each = near_duplicates(docs, size, threshold).where("doc_id is not null and n_shingles > 0")
    told = scratch.keep(each.groupBy("doc_id", "h0", "h1").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    clean, maybe = bloom.parted(docs, told.select("doc_id").distinct(), "doc_id")
    text = maybe.columns.index("text")

    @freeing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            names = np.stack([_named(s) if len(s := shingles(t or "", size)) else np.zeros(2, np.int64) for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(names[:, k].copy()) for k in (0, 1))], names=[*batch.schema.names, "__h0", "__h1"])

    schema = StructType([*maybe.schema.fields, StructField("__h0", LongType()), StructField("__h1", LongType())])
    judged = maybe.mapInArrow(run, schema).join(told.selectExpr("doc_id", "h0 as __h0", "h1 as __h1", "kept as __kept", "n as __n"), ["doc_id", "__h0", "__h1"], "left")
    stay = scratch.keep(judged.where("__kept is null or __kept"))
    repeated = stay.where("__n is not null").dropDuplicates(["doc_id", "__h0", "__h1"])
    return clean.unionByName(stay.where("__n is null").select(*docs.columns)).unionByName(repeated.select(*docs.columns)).select(*docs.columns)
