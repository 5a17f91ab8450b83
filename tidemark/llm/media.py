"""Media columns: payloads stored as 8-bit grey images in archives, read back by a custom Spark data source.

A payload becomes a PNG image of WIDTH pixels a row, one byte a pixel, which is lossless. Tasks write the images into
zip archives (members stored as they are) of about ARCHIVE bytes in a shared folder; an archive has the attempt's id in
its name, and the archives that count are those in the written manifest of the attempts that ended well, so a task
that runs again leaves no doubles. The data source plans byte ranges over the archives: of SPLIT bytes, or larger if
there would be more than PARTITIONS, and a partition holds the ranges of several small archives, so the driver's plan
stays small however large the archives are together. A task opens an archive once, reads its directory from the end,
takes the members that begin in its range, and reads each on its own by offset; only a member whose length or CRC-32 is
wrong is read again, from a newly opened file, RETRIES times at most. Payloads go on in Arrow batches of BATCH bytes.

Defined results: a null or empty text is 64 zero bytes. Equal texts give equal payloads, images and features. Repeated
rows and null ids are members of their own. A very long text is one image of as many rows as it needs, held in one
task's memory. No ties arise, as nothing is ordered or chosen. Other columns are not read, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch

WIDTH = 64
ARCHIVE = 64 << 20
SPLIT, PARTITIONS = 8 << 20, 50_000
BATCH = 4 << 20
RETRIES = 4
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and the text with zero bytes up to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def image(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose pixels are the payload; no row filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def pixels(png: bytes) -> bytes:
    """The pixels of such an image, with its checksums verified."""
    if png[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unknown row filter")
    return rows[:, 1:].tobytes()


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit pattern of which columns are brighter than the mean."""
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    deviation = float(np.sqrt(max(0.0, (counts * values * values).sum() / n - mean * mean)))
    p = counts[counts > 0] / n
    bright = samples.reshape(-1, WIDTH).mean(0) > mean
    return f"mean={mean:.4f};sd={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};columns={np.packbits(bright).tobytes().hex()}"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any store that Arrow knows by its URI; a plain path is local."""
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(path)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads of docs (doc_id, text) as archives below folder, and returns its manifest."""
    spark = docs.sparkSession

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(f"{root}/archives", recursive=True)
        attempt, number = TaskContext.get().taskAttemptId(), 0
        out, archive, members, size = None, None, 0, 0
        done: dict[str, list] = {"archive": [], "members": [], "n_bytes": []}

        def close():
            archive.close()
            raw = out.getvalue()
            name = f"archives/{attempt:08d}-{number:04d}-{uuid.uuid4().hex[:8]}.zip"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(raw)
            for k, v in zip(done, (name, members, len(raw))):
                done[k].append(v)

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if archive is None:
                    out, members, size = io.BytesIO(), 0, 0
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                n, payload = payload_of(text)
                png = image(payload)
                name = f"{members}/{'' if doc_id is None else doc_id}/{n}.png"
                archive.writestr(zipfile.ZipInfo(name), png)
                members, size = members + 1, size + len(png)
                if size >= ARCHIVE:
                    close()
                    archive, number = None, number + 1
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done["archive"], pa.string()), pa.array(done["members"], pa.int64()), pa.array(done["n_bytes"], pa.int64())], list(done))

    rows = docs.select("doc_id", "text").mapInArrow(write, "archive string, members long, n_bytes long")
    rows.write.parquet(f"{folder}/manifest")
    return spark.read.schema("archive string, members long, n_bytes long").parquet(f"{folder}/manifest")


class ByteRanges(InputPartition):
    """(archive, first byte, last byte) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def planned(archives: list[tuple[str, int]], split: int, most: int = PARTITIONS) -> list[list[tuple[str, int, int]]]:
    """Ranges of archives (name, size) in partitions of about split bytes each, or larger ones if there were too many."""
    split = max(split, -(-sum(size for _, size in archives) // most))
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for archive, size in archives:
        at = 0
        while at < size:
            if room <= 0:
                out.append([])
                room = split
            end = min(size, at + room)
            out[-1].append((archive, at, end))
            room, at = room - (end - at), end
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self) -> list[ByteRanges]:
        fs, root = filesystem(self.folder)
        manifest = pyarrow.dataset.dataset(f"{root}/manifest", filesystem=fs, format="parquet", exclude_invalid_files=False)
        archives = [x for b in manifest.to_batches(columns=["archive", "n_bytes"]) for x in zip(b.column("archive").to_pylist(), b.column("n_bytes").to_pylist())]
        return [ByteRanges(r) for r in planned(archives, self.split)] or [ByteRanges([])]

    def read(self, partition: ByteRanges):
        fs, root = filesystem(self.folder)
        rows: list[tuple] = []
        size = 0
        for archive, start, end in partition.ranges:
            path = f"{root}/{archive}"
            with fs.open_input_file(path) as f:
                with zipfile.ZipFile(f) as z:
                    members = [m for m in z.infolist() if start <= m.header_offset < end]
                for m in members:
                    _, doc_id, n = m.filename.removesuffix(".png").split("/")
                    rows.append((int(doc_id) if doc_id else None, int(n), archive, m.header_offset, member(fs, path, m, f)))
                    size += m.file_size
                    if size >= BATCH:
                        yield to_batch(rows)
                        rows, size = [], 0
        if rows:
            yield to_batch(rows)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "archive", "offset", "media"])


def member(fs: pyarrow.fs.FileSystem, path: str, m: zipfile.ZipInfo, opened: pa.NativeFile | None = None) -> bytes:
    """One member by its offset, from the opened file. A failed read is tried again with a newly opened file, and
    other members aren't touched."""
    for attempt in range(RETRIES):
        try:
            if attempt == 0 and opened is not None:
                return checked(opened, m)
            with fs.open_input_file(path) as f:
                return checked(f, m)
        except OSError as e:
            if attempt == RETRIES - 1:
                raise OSError(f"{path}, member {m.filename} at {m.header_offset}: {e}") from e
            time.sleep(0.1 * 2**attempt)
    raise AssertionError


def checked(f: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
    f.seek(m.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError("no member begins here")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(m.header_offset + 30 + name + extra)
    raw = f.read(m.compress_size)
    if len(raw) != m.file_size or zlib.crc32(raw) != m.CRC:
        raise OSError("short or damaged")
    return raw


class MediaArchives(DataSource):
    """Format "tidemark_archives": the members of the archives below a folder. Option split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_archives"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)))


def load(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("tidemark_archives").load(folder)


def described(media: DataFrame) -> DataFrame:
    """Checksums and feature of each stored image and of the payload in it."""

    def run(batches):
        for b in batches:
            rows = []
            for png in b.column("media").to_pylist():
                payload = pixels(png)
                rows.append((
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(),
                    feature(np.frombuffer(payload, np.uint8)),
                ))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores the payloads of all documents, reads them back and describes them."""
    folder = scratch(docs.sparkSession, "media")
    store(docs, folder)
    return described(load(docs.sparkSession, folder))
