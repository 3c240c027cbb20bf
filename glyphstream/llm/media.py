"""Media columns: payloads stored as images in archives, and a data source that reads them back.

A payload becomes an 8-bit grey PNG of 64 samples a row.  Tasks put the images into ZIP archives
(stored, not packed again) in a folder that all executors share.  Every attempt of a task names its
archives anew, and the table of the archives (manifest) is written with Spark's commit protocol, so it lists
those of one attempt of each task whatever ran twice, in whatever order.  The data source plans byte
ranges of the listed archives from the manifest alone; a range's task compares the archive's directory
with it and takes the members whose headers start in the range, one read for each, checked and
tried anew on its own.  An archive that is lost or differs is an error.
"""

from __future__ import annotations

import atexit
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphstream.llm.common import checkpoint_dir, slices

ROW = 64
MEMBER_SCHEMA = "doc_id bigint, member string, offset bigint, media binary, attempts int, error string"
_PNG = b"\x89PNG\r\n\x1a\n"


def filesystem(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(raw: bytes) -> bytes:
    """raw, padded by zeros to a positive multiple of 64, as samples; its own length is in a text chunk."""
    height = max(1, -(-len(raw) // ROW))
    rows = np.zeros((height, ROW + 1), np.uint8)  # a row begins with its filter, none
    rows[:, 1:] = np.frombuffer(raw.ljust(height * ROW, b"\0"), np.uint8).reshape(height, ROW)
    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(rows, 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of an image that to_png made; ValueError for any other."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        found[kind] = found.get(kind, b"") + data
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(-1, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes(), int(found[b"tEXt"].partition(b"\0")[2])


def features(payload: bytes) -> str:
    """Mean, spread, entropy and share of equal neighbours of the samples."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    same = float((x[1:] == x[:-1]).mean())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};same={same:.4f};zeros={n[0]}"


MANIFEST = "archive string, size bigint, members bigint, directory bigint, directory_size bigint, directory_crc32 bigint"


def write_archives(docs: DataFrame, root: str, *, most: int = 32 << 20) -> DataFrame:
    """Writes doc_id, text as images into archives of about `most` bytes under root; a row of MANIFEST for each.

    A null text is stored as an empty one, a null doc_id in the member's name; equal rows are stored each for itself.
    An empty table gives no archive.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(root)
        where.create_dir(path, recursive=True)
        attempt, found = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", []
        name = sink = out = None

        def close():
            nonlocal out
            members = len(out.namelist())
            out.close()
            sink.close()
            out = None
            found.append((name, *directory_of(where, f"{path}/{name}", members)))

        size = 0
        try:
            for batch in slices(batches, "text", 4 << 20):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None:
                        name, size = f"{attempt}-{len(found):05d}.zip", 0
                        sink = where.open_output_stream(f"{path}/{name}")
                        out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    media = to_png((text or "").encode("utf-8", "replace"))
                    out.writestr(zipfile.ZipInfo(f"{len(out.filelist):07d}-{'null' if doc is None else doc}.png"), media)
                    size += len(media)
                    if size >= most:
                        close()
            if out is not None:
                close()
        except BaseException:
            with suppress(Exception):
                sink.close()
            for gone in {name, *(f[0] for f in found)} - {None}:
                with suppress(OSError):
                    where.delete_file(f"{path}/{gone}")
            raise
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, MANIFEST)


def store(docs: DataFrame, root: str, *, most: int = 32 << 20) -> None:
    """write_archives() with the manifest under root; an older manifest there is replaced, and archives that none lists are deleted."""
    from pyarrow import fs

    where, path = filesystem(root)
    where.create_dir(path, recursive=True)
    write_archives(docs, root, most=most).write.mode("overwrite").parquet(f"{root.rstrip('/')}/manifest")
    listed = {f.archive for f in manifest(where, path)}
    for x in where.get_file_info(fs.FileSelector(path)):
        if x.is_file and x.base_name.endswith(".zip") and x.base_name not in listed:
            with suppress(OSError):
                where.delete_file(x.path)


@dataclass(frozen=True)
class Archive:
    archive: str
    size: int
    members: int | None
    directory: int  # where the directory starts and how long it is
    directory_size: int
    directory_crc32: int | None


@dataclass
class ByteRanges(InputPartition):
    ranges: list[tuple[Archive, int, int]]


def manifest(where, path: str) -> list[Archive] | None:
    """The archives that the manifest under path lists, by name; None without one."""
    from pyarrow import fs, parquet

    folder = where.get_file_info(f"{path}/manifest")
    if folder.type != fs.FileType.Directory:
        return None
    files = [x.path for x in where.get_file_info(fs.FileSelector(folder.path)) if x.base_name.endswith(".parquet")]
    return sorted((Archive(**r) for f in files for r in parquet.read_table(f, filesystem=where).to_pylist()), key=lambda a: a.archive)


def directory_end(read, size: int) -> tuple[int, int]:
    """Start and length of a ZIP archive's directory; read(offset, length) gives bytes."""
    tail = read(max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no directory")
    length, start = struct.unpack_from("<II", tail, at + 12)
    if start == 0xFFFFFFFF or length == 0xFFFFFFFF:
        at64 = tail.rfind(b"PK\6\6")
        length, start = struct.unpack_from("<QQ", tail, at64 + 40)
    return start, length


def directory_of(where, path: str, members: int | None) -> tuple[int, int | None, int, int, int]:
    """Size, members, and start, length and checksum of the directory of the archive at path."""
    size = where.get_file_info(path).size
    with where.open_input_file(path) as f:
        start, length = directory_end(lambda o, n: (f.seek(o), f.read(n))[1], size)
        f.seek(start)
        return size, members, start, length, zlib.crc32(f.read(length))


def directory_entries(data: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, header offset, stored size, crc32, method) of each member; sizes beyond 32 bits stand in an extra field."""
    at = 0
    while data[at : at + 4] == b"PK\1\2":
        method, _, _, crc, size, full, n, extra, note = struct.unpack_from("<HHHIIIHHH", data, at + 10)
        offset = struct.unpack_from("<I", data, at + 42)[0]
        field, end = at + 46 + n, at + 46 + n + extra
        while field + 4 <= end:
            kind, length = struct.unpack_from("<HH", data, field)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", data, field + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                size = next(wide) if size == 0xFFFFFFFF else size
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            field += 4 + length
        yield data[at + 46 : at + 46 + n].decode(), offset, size, crc, method
        at = end + note


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 8 << 20)))
        self.batch_bytes = int(options.get("batchbytes", options.get("batchBytes", 4 << 20)))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRanges]:
        """Ranges of about rangeBytes; small archives share one.  Only a folder without manifest is listed, and its archives' ends read."""
        from pyarrow import fs

        where, path = filesystem(self.root)
        found = manifest(where, path)
        if found is None:
            listed = sorted(x.path for x in where.get_file_info(fs.FileSelector(path)) if x.path.endswith(".zip") and x.size)
            found = [Archive(x.removeprefix(f"{path}/"), *directory_of(where, x, None)) for x in listed]
        out, room = [], 0
        for a in found:
            for first in range(0, a.directory, self.range_bytes):
                end = min(first + self.range_bytes, a.directory)
                if end - first > room:
                    out.append(ByteRanges([]))
                    room = self.range_bytes
                out[-1].ranges.append((a, first, end))
                room -= end - first
        return out or [ByteRanges([])]

    def _member(self, where, archive: str, entry: tuple) -> tuple[bytes | None, int, str | None]:
        """A member's bytes by its own offset; a failed try opens the archive anew."""
        _, offset, size, crc, method = entry
        why = None
        for k in range(1, self.tries + 1):
            try:
                with where.open_input_file(archive) as f:
                    return self._read(f, offset, size, crc, method), k, None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                why = f"{type(e).__name__}: {e}"
        return None, self.tries, why

    @staticmethod
    def _read(f, offset: int, size: int, crc: int, method: int) -> bytes:
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no member at its offset")
        n, extra = struct.unpack_from("<HH", head, 26)
        f.seek(offset + 30 + n + extra)
        data = f.read(size)
        if method == 8:
            data = zlib.decompress(data, -15)
        if zlib.crc32(data) != crc:
            raise ValueError("checksum differs")
        return data

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        where, path = filesystem(self.root)
        for a, first, end in partition.ranges:
            yield from self._range(where, f"{path}/{a.archive}", a, first, end)

    def _range(self, where, archive: str, listed: Archive, first: int, end: int) -> Iterator[pa.RecordBatch]:
        with where.open_input_file(archive) as f:
            f.seek(listed.directory)
            directory = f.read(listed.directory_size)
            entries = list(directory_entries(directory))
            if f.size() != listed.size or zlib.crc32(directory) != listed.directory_crc32 or listed.members not in (None, len(entries)):
                raise ValueError(f"{archive} isn't the archive that the manifest lists")
            rows, size = [], 0
            for e in entries:
                if not first <= e[1] < end:
                    continue
                try:
                    got = self._read(f, *e[1:]), 1, None
                except (OSError, ValueError, zlib.error, struct.error):
                    got = self._member(where, archive, e)
                doc = e[0].partition("-")[2].removesuffix(".png")
                rows.append((int(doc) if doc.removeprefix("-").isdigit() else None, e[0], e[1], *got))
                size += len(got[0] or b"")
                if size >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = {"doc_id": pa.int64(), "member": pa.string(), "offset": pa.int64(), "media": pa.binary(), "attempts": pa.int32(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


class ArchiveSource(DataSource):
    """spark.read.format("glyph_archive").load(folder): a row for each member of its ZIP archives."""

    @classmethod
    def name(cls) -> str:
        return "glyph_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def describe(members: DataFrame) -> DataFrame:
    """Lengths, hashes and features of stored payloads (doc_id, media, error); a member with an error gives nulls beside it.

    Null media are an error too; equal rows give equal results, an empty table no row; other columns are ignored.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 8 << 20):
            out = []
            for doc, media, error in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "media", "error"))):
                try:
                    payload, n = from_png(media or b"")
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    out.append((doc, *[None] * 7, error or str(e)))
                    continue
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return members.select("doc_id", "media", "error").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Stores every text of docs (doc_id, text) as an image in archives, reads them back and describes them.

    A null text counts as empty (one row of zeros); a null doc_id stays null; equal rows are stored
    each for itself; an empty table gives no row.  Other columns are ignored.  Without root the
    archives lie in the session's shared folder until the driver ends.
    """
    spark = docs.sparkSession
    if root is None:
        root = f"{checkpoint_dir(spark).rstrip('/')}/glyph-media-{uuid.uuid4().hex}"

        def remove():
            with suppress(OSError):
                where, path = filesystem(root)
                where.delete_dir(path)

        atexit.register(remove)
    store(docs, root)
    spark.dataSource.register(ArchiveSource)
    return describe(spark.read.format("glyph_archive").load(root))
