"""Media columns: payloads in zip archives, written and read by a Spark data source.

The writer stores each partition's payloads as members of one archive (PNG images of
8-bit samples, 64 RGB pixels a row), under a name that its commit makes final.  The
reader plans byte ranges over the archives of a directory: a range owns the members
whose header starts within it.  A task reads the archive's own directory (at its end),
then streams its members in offset order through Arrow batches.  A member that can't be
read or fails its checksum is tried again on its own, by its offset, from a newly opened
file, and is reported with an error text if it keeps failing.

Archives lie in a folder that ``pyarrow.fs`` can open (local, HDFS or object stores).

Defined results: a null text is empty, whose payload is 192 spaces; equal texts have equal
payloads, stored bytes and features; repeated rows and rows without an id are members of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from .common import shared_dir, whole_text

FORMAT = "media_archive"
WIDTH = 64  # pixels; three samples each
ROW = 3 * WIDTH
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
READ_SCHEMA = "member string, offset long, payload binary, media binary, error string"
BATCH_BYTES = 4 << 20


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with spaces up to a positive multiple of 192, and how many were text."""
    data = text.encode("utf-8")
    n = len(data)
    return data + b" " * (max(1, -(-n // ROW)) * ROW - n), n


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A lossless 8-bit RGB image whose samples are the payload's bytes, row by row."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # the first byte of a line: no filter
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 2, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; raises ValueError on damage."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not an image")
    at, body, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk fails its checksum")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:4] != (8, 2):
        raise ValueError("not an 8-bit RGB image of this width")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], ROW + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples and an 8 x 8 average hash."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    live = share[share > 0]
    entropy = float(-(live * np.log2(live)).sum())
    bounds = np.linspace(0, len(samples), 65).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    means = (running[bounds[1:]] - running[bounds[:-1]]) / np.diff(bounds)
    bits = np.packbits(means > samples.mean()).tobytes().hex()
    return f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={entropy:.4f};ahash={bits}"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Archived(WriterCommitMessage):
    written: str | None
    final: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """One archive for each partition; rows have ``member`` (string) and ``payload``."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archived:
        files, folder = _filesystem(self.folder)
        files.create_dir(folder, recursive=True)
        name = uuid.uuid4().hex
        target = f"{folder}/.{name}.writing"
        count = 0
        with files.open_output_stream(target) as out, zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED) as archive:
            for batch in iterator:
                for member, payload in zip(batch.column("member"), batch.column("payload")):
                    info = zipfile.ZipInfo(f"{count:09d}/{member.as_py()}.png", (1980, 1, 1, 0, 0, 0))
                    archive.writestr(info, to_png(payload.as_py()))
                    count += 1
        if not count:
            files.delete_file(target)
            return Archived(None, None)
        return Archived(target, f"{folder}/{name}.zip")

    def commit(self, messages: list[Archived | None]) -> None:
        files, folder = _filesystem(self.folder)
        files.create_dir(folder, recursive=True)
        for m in messages:
            if m is not None and m.written:
                files.move(m.written, m.final)

    def abort(self, messages: list[Archived | None]) -> None:
        files, _ = _filesystem(self.folder)
        for m in messages:
            if m is not None and m.written:
                files.delete_file(m.written)


class _Forward(io.RawIOBase):
    """A write-only file that only goes forward, as object stores give it."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int):
        self.folder, self.range_bytes, self.attempts = folder, range_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from names and sizes alone; no archive is opened here."""
        from pyarrow import fs

        files, folder = _filesystem(self.folder)
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        ranges = [
            ByteRange(x.path, at, min(at + self.range_bytes, x.size))
            for x in sorted(found, key=lambda x: x.path)
            if x.path.endswith(".zip")
            for at in range(0, x.size, self.range_bytes)
        ]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _filesystem(self.folder)
        rows, held = [], 0
        with files.open_input_file(partition.path) as file:
            with zipfile.ZipFile(file) as archive:
                members = sorted(
                    (x for x in archive.infolist() if partition.start <= x.header_offset < partition.end),
                    key=lambda x: x.header_offset,
                )
            for info in members:
                payload, media, error = self._member(files, partition.path, file, info)
                rows.append((info.filename, info.header_offset, payload, media, error))
                held += len(payload or b"") + len(media or b"")
                if held >= BATCH_BYTES:
                    yield _read_batch(rows)
                    rows, held = [], 0
        if rows:
            yield _read_batch(rows)

    def _member(self, files, path: str, file, info: zipfile.ZipInfo) -> tuple[bytes | None, bytes | None, str | None]:
        error = None
        for attempt in range(self.attempts):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with files.open_input_file(path) as again:
                        media = _stored_member(again, info)
                else:
                    media = _stored_member(file, info)
                return from_png(media), media, None
            except (OSError, ValueError, zlib.error, struct.error, pa.ArrowException) as e:
                error = f"{type(e).__name__}: {e}"
        return None, None, error


def _stored_member(file, info: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, found by its offset and checked against the directory."""
    file.seek(info.header_offset)
    header = file.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    names, extra = struct.unpack_from("<HH", header, 26)
    file.seek(info.header_offset + 30 + names + extra)
    media = file.read(info.compress_size)
    if len(media) != info.compress_size or zlib.crc32(media) != info.CRC:
        raise ValueError("the member fails its checksum")
    return media


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    names = ["member", "offset", "payload", "media", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("path", folder).load()``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(
            self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("attempts", 4))
        )

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(docs: DataFrame, folder: str) -> None:
    """Store each text's payload as a member named by its document and byte count."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole_text().alias("text"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, payloads, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                payload, n = padded(text.as_py())
                names.append(json.dumps({"doc_id": doc_id.as_py(), "n_bytes": n}))
                payloads.append(payload)
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(payloads, pa.binary())], ["member", "payload"])
                    names, payloads, held = [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(payloads, pa.binary())], ["member", "payload"]
            )

    rows = texts.mapInArrow(members, "member string, payload binary")
    rows.write.format(FORMAT).option("path", folder).mode("append").save()


def read_archives(spark: SparkSession, folder: str, range_bytes: int = 8 << 20, attempts: int = 4) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    reader = spark.read.format(FORMAT).option("path", folder)
    return reader.option("range_bytes", range_bytes).option("attempts", attempts).load()


_ROW = (
    "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, error string"
)


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the texts as images, read the stored bytes back and describe them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/media/{uuid.uuid4().hex}"
    write_archives(docs, folder)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, payload, media, error in zip(*(batch.column(c) for c in ("member", "payload", "media", "error"))):
                about = json.loads(member.as_py().split("/", 1)[1].removesuffix(".png"))
                own = (about["doc_id"], about["n_bytes"])
                if error.as_py() is not None:
                    rows.append((*own, None, None, None, None, None, None, error.as_py()))
                    continue
                data, stored_form = payload.as_py(), media.as_py()
                rows.append(
                    (
                        *own,
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        zlib.crc32(data[-16:]),
                        len(stored_form),
                        hashlib.sha256(stored_form).hexdigest(),
                        feature(data),
                        None,
                    )
                )
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [x.split()[0] for x in _ROW.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = read_archives(spark, folder).mapInArrow(describe, _ROW)
    return rows.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
