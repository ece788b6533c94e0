"""Media columns: archives of PNG members in a shared folder, read through a Spark data source by byte ranges.

``write_archives`` stores one payload per row as an 8-bit RGB image of 64 pixels a line (192 bytes) in uncompressed ZIP
archives of bounded size, one series of archives per input partition, and a manifest of the archives that were committed.
``archives`` reads such a folder: the plan cuts the archives of the manifest (or all of the folder) into byte ranges; a range owns
the members whose header begins in it. Each member is read by its offset, verified and, if that fails, read again by
itself from a newly opened file.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import append_columns, materialize, open_fs, released, scratch, small_batches

LINE = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
MAX_PARTITIONS = 20_000  # beyond, a partition has more than RANGE_BYTES
BATCH_BYTES = 2 << 20
ATTEMPTS = 4
SCHEMA = "name string, key long, n_bytes long, archive string, offset long, media binary, payload binary"
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """``raw`` with bytes 32 appended up to a positive multiple of 192."""
    return raw + b" " * (LINE - len(raw) % LINE if len(raw) % LINE or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A PNG of 64 RGB pixels a line whose 8-bit samples are the payload, row filter none. Equal payloads, equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    data = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    size = struct.pack(">IIBBBBB", LINE // 3, len(rows), 8, 2, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(data, 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a file that ``to_png`` made; a wrong checksum is an error."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG file")
    at, data = 8, b""
    while at < len(media):
        n = int.from_bytes(media[at : at + 4], "big")
        if at + 12 + n > len(media):
            raise ValueError("a chunk is cut off")
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, LINE + 1)
    if rows[:, 0].any():
        raise ValueError("a row filter is set")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Lines, mean and deviation of the samples, entropy in bits a sample, and the mean of the last line."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    some = share[share > 0]
    return f"lines={len(samples) // LINE};mean={samples.mean():.4f};std={samples.std():.4f};bits={-(some * np.log2(some)).sum():.4f};last={samples[-LINE:].mean():.4f}"


def write_archives(df: DataFrame, folder: str, key_col: str, text_col: str) -> DataFrame:
    """Write the texts of ``df`` as media members into archives below ``folder`` (a URI all executors see).

    Returns the manifest, rows (archive, bytes, members) that are written and read back. Every attempt at a task gives its archives names of their own
    and only those of the successful ones are in the manifest, so neither a repeated task nor what lay in the folder before is read.
    Keys are integers; null ones stay null. Null texts are stored as empty payloads padded to one line. Repeated rows give members of
    their own. Other columns are not read. An empty table writes no archive.
    """
    from pyspark.sql import types as T

    if not isinstance(df.select(key_col).schema[0].dataType, T.IntegralType):
        raise ValueError("keys of media members are integers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = open_fs(folder)
        out, archive, name, members, done = None, None, "", 0, []

        def close() -> None:
            nonlocal out, archive, members
            if archive is not None:
                archive.close()
                done.append((name, out.tell(), members))
                out.close()
                out, archive, members = None, None, 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if archive is None:
                    name = f"{root}/{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(name)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{members:09d}.{'null' if key is None else key}.{len(raw)}.png")
                archive.writestr(member, to_png(pad(raw)))
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "bytes", "members"])

    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    return materialize(small_batches(df.select(key_col, text_col)).mapInArrow(released(run), "archive string, bytes long, members long"), "manifest")


@dataclass
class ByteRanges(InputPartition):
    """Ranges (archive, start, end) that one task reads."""

    ranges: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options.get("manifest")
        self.range_bytes, self.most = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("maxpartitions", MAX_PARTITIONS))

    def _files(self) -> list[tuple[str, int]]:
        if self.manifest:
            from pyarrow import dataset

            fs, root = open_fs(self.manifest)
            rows = dataset.dataset(root, filesystem=fs, format="parquet").to_table(columns=["archive", "bytes"])
            return sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))
        from pyarrow import fs as pafs

        fs, root = open_fs(self.folder)
        return sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".zip"))

    def partitions(self) -> list[ByteRanges]:
        files = self._files()
        step = max(self.range_bytes, -(-sum(size for _, size in files) // self.most))
        out, held, room = [], [], step
        for path, size in files:
            at = 0
            while at < size:
                end = min(size, at + room)
                held.append((path, at, end))
                room -= end - at
                at = end
                if not room:
                    out.append(ByteRanges(held))
                    held, room = [], step
        return [*out, ByteRanges(held)] if held or not out else out

    def read(self, part: ByteRanges) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.folder)
        for path, start, end in part.ranges:
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                members = [m for m in archive.infolist() if start <= m.header_offset < end]
                rows, held = [], 0
                for member in members:
                    media, payload = read_member(fs, path, f, member)
                    _, key, n, _ = member.filename.split(".")
                    rows.append((member.filename, None if key == "null" else int(key), int(n), path, member.header_offset, media, payload))
                    held += len(media) + len(payload)
                    if held >= BATCH_BYTES or len(rows) >= 256:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def read_member(fs, path: str, opened, member: zipfile.ZipInfo) -> tuple[bytes, bytes]:
    """(media, payload) of one member, read by its offset; after a failure only this member is read again, by a new handle."""
    for attempt in range(ATTEMPTS):
        try:
            if attempt == 0:
                return _member_at(opened, member)
            with fs.open_input_file(path) as again:
                return _member_at(again, member)
        except (OSError, ValueError, zlib.error):
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(0.1 * 4**attempt)
    raise AssertionError


def _member_at(f, member: zipfile.ZipInfo) -> tuple[bytes, bytes]:
    f.seek(member.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member begins here")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(member.header_offset + 30 + name + extra)
    media = f.read(member.compress_size)
    if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
        raise ValueError("a member is damaged")
    return media, from_png(media)


class ArchiveSource(DataSource):
    """Options: ``path``, the folder; ``manifest``, a parquet table (archive, bytes) of the archives to read, without it all of
    the folder; ``rangeBytes``, the bytes that one partition reads, more where partitions would number over ``maxPartitions``.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()})


def archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, manifest: DataFrame | None = None) -> DataFrame:
    """One row for each member of the archives in ``folder``, or of those in ``manifest``; an empty or missing folder gives no rows."""
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archives").option("rangeBytes", range_bytes)
    return (reader.option("manifest", manifest.scratch_path) if manifest is not None else reader).load(folder)


def media_columns(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store the texts of ``df`` and read them back as media rows (``SCHEMA``), from a new folder or ``folder``.

    A row for each row of ``df``, whatever lies in the folder; null keys and null texts as ``write_archives`` has them.
    """
    folder = folder or scratch(df.sparkSession, "media")
    return archives(df.sparkSession, folder, manifest=write_archives(df, folder, key_col, text_col))


def features(media: DataFrame) -> DataFrame:
    """Append ``feature`` (string), and ``tail_crc32`` (long), the CRC-32 of the payload's last 16 bytes.

    Both are null for a null or empty payload; columns of these names are replaced, others pass through, rows are judged each.
    """
    from pyspark.sql import types as T

    def compute(payloads: pa.Array) -> list[pa.Array]:
        raw = [p.as_py() for p in payloads]
        return [pa.array([feature(p) if p else None for p in raw], pa.string()), pa.array([zlib.crc32(p[-16:]) if p else None for p in raw], pa.int64())]

    return append_columns(media, [T.StructField("feature", T.StringType()), T.StructField("tail_crc32", T.LongType())], compute, ["payload"], rows=256)
