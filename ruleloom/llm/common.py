"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ruleloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Rows of an Arrow batch where the session has Spark's default (10 000): rows hold whole texts, and a batch is held by both
#: the executor and its Python worker.
BATCH_ROWS = 2000
#: Bytes of an Arrow batch in the same case, so that very long texts do not meet in one batch (a single text may be larger).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size, unless its rows were set to something else than Spark's default."""
    rows, size = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder to cut lineage; lost executors do not lose them.

    ``keep`` writes a table and reads it back, ``drop`` deletes those that are no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, self.paths.pop(id(df)))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 4) -> DataFrame:
    """Join with a right side that has one row per key, where a key may hold a large share of the left rows.

    Left rows of a key are dealt to several tasks by a hash of column ``by``, right rows are repeated for each. Both sides
    are shuffled for it, so adaptive execution can split what is still too large.
    """
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    each = right.withColumn("__salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(salts)))))
    return dealt.join(each, [*keys, "__salt"], how).drop("__salt")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when a task ends: workers live on for later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a task holds at once does not follow Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by keys; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held)
        cuts = group_starts(whole, keys)
        if (cut := int(cuts[-1])) > 0:
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
        else:
            held = [whole.combine_chunks().to_batches()[0]]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group starts; keys are integer columns without nulls."""
    new = np.zeros(whole.num_rows, bool)
    new[0] = True
    for k in keys:
        v = whole.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hex_crc32_fold(column: str = "doc_id", of: int = 5):
    """Remainder of the CRC-32 of an id's decimal text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))
