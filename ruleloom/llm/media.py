"""Media columns: payloads in archives, read by a custom Spark data source.

A payload of bytes is stored as an 8-bit grey PNG image of 64 columns. Images are members of zip archives in the shared
folder. The data source ``media_archive`` plans byte ranges over the archives (a member belongs to the range that holds
its header's offset, found in the archive's directory), streams batches of bounded size through Arrow and retries each
member by its offset, so that one failed read does not repeat the others.

Defined results: null text is empty and becomes one row of zeros; equal texts give equal media; repeated rows are each
stored; a null id stays null; an empty table gives no archives and no rows. Writing is idempotent: a task that runs
again replaces its archives by the same ones.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import Scratch, bounded_batches, delete, shared_dir, slices, texts_of

COLUMNS = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 48 << 20, 8 << 20, 8 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "doc_id long, n_bytes long, media binary"


def padded(data: bytes) -> bytes:
    """Zeros up to a positive multiple of COLUMNS."""
    return data + bytes(max(COLUMNS, -(-len(data) // COLUMNS) * COLUMNS) - len(data))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = len(payload) // COLUMNS
    lines = np.zeros((rows, COLUMNS + 1), np.uint8)  # each row starts with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, COLUMNS)
    head = struct.pack(">IIBBBBB", COLUMNS, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), level)) + _part(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """Samples (rows x COLUMNS) of an image that to_png made; checks every part's sum."""
    if not png.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    at, parts = len(_SIGNATURE), {}
    while at < len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a damaged PNG part")
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, rows = struct.unpack_from(">II", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:]


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; the names Hadoop has for S3 are known."""
    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    except pa.ArrowInvalid as e:
        raise ValueError(f"archives cannot be kept in {uri}: use a local, hdfs, s3, gs or abfs folder") from e


def _tried(read, tries: int, pause: float = 0.2):
    """What read gives; tried again after an OSError."""
    for n in range(tries):
        try:
            return read()
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(pause * 2**n)
    raise AssertionError


def write_archives(docs: DataFrame, root: str, id_col: str = "doc_id", text: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Stores every document's payload in archives below root; gives the number of members."""
    bounded_batches(docs.sparkSession)
    files, path = _at(root)
    files.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _at(root)
        part, made, members = TaskContext.get().partitionId(), 0, 0
        held: io.BytesIO | None = None

        def close() -> None:
            nonlocal held, made
            if held is not None:
                archive.close()
                at = f"{path}/{part:06d}-{made:04d}.zip"
                own = f"{at}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(own) as out:
                    out.write(held.getbuffer())
                files.move(own, at)
                held, made = None, made + 1

        for batch in slices(batches, 512):
            for doc_id, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if held is None:
                    held = io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                data = t.encode()
                info = zipfile.ZipInfo(f"{members:09d}/{'' if doc_id is None else doc_id}.png")
                info.comment = str(len(data)).encode()
                archive.writestr(info, to_png(padded(data)))
                members += 1
                if held.tell() >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], names=["members"])

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text}` as text").mapInArrow(run, "members long").groupBy().sum("members").first()[0] or 0


@dataclass
class Ranges(InputPartition):
    """Byte ranges (archive, first, end) of one task."""

    ranges: list

    def __init__(self, ranges: list):
        self.ranges = ranges


def read_member(files: fs.FileSystem, path: str, info: zipfile.ZipInfo, tries: int = TRIES, pause: float = 0.2) -> bytes:
    """The member at an offset; opens the archive anew for each try."""

    def read() -> bytes:
        with files.open_input_file(path) as f:
            f.seek(info.header_offset)
            data = _member(info, info.header_offset, f.read(_HEAD + len(info.filename.encode()) + info.compress_size + (1 << 16)))
        if data is None:
            raise OSError(f"member at {info.header_offset} of {path} is damaged")
        return data

    return _tried(read, tries, pause)


_HEAD = 30


def _member(info: zipfile.ZipInfo, base: int, raw: bytes) -> bytes | None:
    """A member's bytes from raw, which starts at base of the archive; None if its sum is wrong or something is missing."""
    at = info.header_offset - base
    if len(raw) < at + _HEAD:
        return None
    at += _HEAD + sum(struct.unpack_from("<HH", raw, at + 26))
    data = raw[at : at + info.compress_size]
    return data if len(data) == info.compress_size and zlib.crc32(data) == info.CRC else None


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.span, self.tries = options["path"], int(options.get("rangebytes", RANGE_BYTES)), int(options.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        files, path = _at(self.root)
        found = sorted((x.path, x.size) for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".zip"))
        plan: list[InputPartition] = []
        held: list = []
        for at, size in found:
            for first in range(0, size, self.span):
                held.append((at, first, min(size, first + self.span)))
                if sum(e - f for _, f, e in held) >= self.span:
                    plan.append(Ranges(held))
                    held = []
        return [*plan, Ranges(held)] if held or not plan else plan

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = _at(self.root)
        rows: list[tuple] = []
        size = 0
        for path, first, end in partition.ranges:
            infos, stop = _tried(lambda path=path: self._directory(files, path), self.tries)
            own = [x for x in infos if first <= x.header_offset < end]
            if not own:
                continue
            base = own[0].header_offset
            stop = next((x.header_offset for x in infos if x.header_offset >= end), stop)
            raw = _tried(lambda path=path, base=base, stop=stop: self._bytes(files, path, base, stop), self.tries)
            for info in own:
                data = _member(info, base, raw)
                if data is None:
                    data = read_member(files, path, info, self.tries)
                name = info.filename.rpartition("/")[2].removesuffix(".png")
                rows.append((int(name) if name else None, int(info.comment), data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _directory(files: fs.FileSystem, path: str) -> tuple[list[zipfile.ZipInfo], int]:
        """Members in order of their offsets, and where the directory starts."""
        with files.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            return sorted(archive.infolist(), key=lambda x: x.header_offset), archive.start_dir

    @staticmethod
    def _bytes(files: fs.FileSystem, path: str, first: int, stop: int) -> bytes:
        with files.open_input_file(path) as f:
            f.seek(first)
            return f.read(stop - first)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, n, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


class MediaSource(DataSource):
    """Format ``media_archive``: option path (folder of archives), rangebytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


def members(spark: SparkSession, root: str, **options: object) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(path=root, **options).load()


def features(media: DataFrame) -> DataFrame:
    """Digests and features of stored members, from the bytes that were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows = []
            for doc_id, n, png in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                image = from_png(png)
                payload = image.tobytes()
                counts = np.bincount(image.ravel(), minlength=256)
                share = counts[counts > 0] / image.size
                feature = f"rows={image.shape[0]};mean={image.mean():.4f};entropy={-(share * np.log2(share)).sum():.4f};levels={len(share)}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (3, 6, 7) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame, **columns: str) -> DataFrame:
    """features() of all documents; the archives are deleted once their digests are kept."""
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    found = Scratch(spark, "features").keep(features(stored(docs, root, **columns)))
    delete(spark, root)
    return found


def stored(docs: DataFrame, root: str | None = None, **columns: str) -> DataFrame:
    """(doc_id, n_bytes, media) of all documents, through archives in the shared folder."""
    spark = docs.sparkSession
    root = root or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, root, **columns)
    return members(spark, root)
