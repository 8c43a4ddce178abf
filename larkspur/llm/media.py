"""Media columns: payloads kept as files of a media format in archives, and a data source that reads them back.

A payload becomes a WAV file of 8-bit samples. Files are collected into ZIP archives of bounded size in
a folder that the cluster shares; a manifest lists the archives of the tasks that succeeded, so what a
lost task left behind is never read. The data source plans byte ranges over the archives of each manifest
file: a task reads the directories of the archives in its range, takes the members whose header lies
there, and streams their payloads as Arrow batches of bounded size. A member that cannot be read is tried
again by its offset, alone; one that cannot be read at all becomes a row with its error.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspur.llm.shared import add_columns, quoted, shared_dir

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: Byte ranges that a read is planned in at most; beyond RANGE_BYTES times this they grow.
MOST_RANGES = 50_000
UNIT = 64
RATE = 8000


def to_wav(data: bytes) -> bytes:
    """A WAV file of 8-bit mono samples: ``data``, zero bytes up to a positive multiple of 64, and its true length in a chunk of its own."""
    samples = data + bytes(-len(data) % UNIT or (0 if data else UNIT))
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    true = struct.pack("<4sIQ", b"tlen", 8, len(data))
    body = b"WAVE" + form + true + struct.pack("<4sI", b"data", len(samples)) + samples
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[int, bytes]:
    """True length and samples of a file made by :func:`to_wav`."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        chunks[kind] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return struct.unpack("<Q", chunks[b"tlen"])[0], chunks[b"data"]


def features(samples: bytes) -> str:
    """Length, mean, power, zero crossings, peak and the commonest sample, as JSON; all from exact integer sums."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    return json.dumps(
        {
            "seconds": round(len(x) / RATE, 6),
            "mean": round(int(x.sum()) / len(x), 6),
            "power": round(int((x * x).sum()) / len(x), 6),
            "crossings": int(np.count_nonzero(sign[1:] != sign[:-1])),
            "peak": int(np.abs(x).max()),
            "mode": int(np.bincount(x + 128, minlength=256).argmax()) - 128,
        }
    )


class Archive:
    """A ZIP archive that is built in memory and written in one go."""

    def __init__(self) -> None:
        self.buffer, self.members = io.BytesIO(), 0
        self.zip = zipfile.ZipFile(self.buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)

    def add(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED, 1)
        self.members += 1

    def write(self, fs: pafs.FileSystem, path: str) -> tuple[str, int, int]:
        self.zip.close()
        data = self.buffer.getvalue()
        with fs.open_output_stream(path) as out:
            out.write(data)
        return path, len(data), self.members


def member_name(key: str | None, place: str) -> str:
    """A member's name tells its row's id, null and empty ones apart, whatever characters it has."""
    return f"{'-' if key is None else '=' + quote(key, safe='', errors='surrogatepass')}/{place}.wav"


def write_archives(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Store every row's text as a WAV member; returns the manifest (archive, size, members), a Parquet table in ``folder``.

    A null or empty text is stored as 64 zero samples; null ids are kept as null. Equal rows are stored
    each, under names of their own. Other columns aren't read. ``folder`` is a URI that pyarrow's
    file systems open on driver and executors. A manifest file has the archives of one task that
    succeeded, so what a lost task left behind is never read.
    """
    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        part, row, archive = TaskContext.get().partitionId(), 0, Archive()

        def done(archive: Archive) -> pa.RecordBatch:
            made = archive.write(fs, f"{base}/{part}-{uuid.uuid4().hex}.zip")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in made], names=["archive", "size", "members"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive.add(member_name(key, f"{part}-{row}"), to_wav((text.as_py() or "").encode("utf-8", "surrogatepass")))
                row += 1
                if archive.buffer.tell() >= archive_bytes:
                    yield done(archive)
                    archive = Archive()
        if archive.members:
            yield done(archive)

    rows = df.select(F.col(quoted(id_col)).cast("string").alias("key"), F.col(quoted(text_col)).alias("text"))
    rows.mapInArrow(run, "archive string, size long, members long").write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.parquet(f"{folder}/manifest")


class ByteRange(InputPartition):
    """Bytes ``start`` to ``end`` of the archives of one manifest file, as if they stood one after another."""

    def __init__(self, manifest: str, start: int, end: int):
        self.manifest, self.start, self.end = manifest, start, end


class MediaArchiveReader(DataSourceReader):
    """The driver plans from one row per manifest file; a task reads its manifest file, and the directories of the archives in its range."""

    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["folder"], int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes, self.tries = int(options.get("batch_bytes", BATCH_BYTES)), int(options.get("tries", 3))
        self.manifests = json.loads(options["manifests"])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"manifests": []}  # a task knows its own from its partition

    def partitions(self) -> list[InputPartition]:
        total = sum(size for _, size in self.manifests)
        step = max(self.range_bytes, -(-total // MOST_RANGES))
        return [ByteRange(m, k, min(k + step, size)) for m, size in self.manifests for k in range(0, size, step)] or [ByteRange("", 0, 0)]

    def tried(self, what: Callable[[bool], Any]) -> tuple[Any, str | None]:
        """The result of ``what``, which is told whether it is called again, or why every try failed."""
        for attempt in range(self.tries):
            try:
                return what(attempt > 0), None
            except (OSError, zlib.error, struct.error, zipfile.BadZipFile) as e:
                problem = f"{type(e).__name__}: {e}"
            if attempt + 1 < self.tries:
                time.sleep(0.1 * 2**attempt)
        return None, problem

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.manifest:
            return
        fs, base = pafs.FileSystem.from_uri(self.folder)
        listed = pq.read_table(f"{base}/manifest/{partition.manifest}", filesystem=fs, partitioning=None)
        rows, held, before = [], 0, 0
        for archive, size in zip(listed["archive"].to_pylist(), listed["size"].to_pylist(), strict=True):
            start, end = partition.start - before, partition.end - before
            before += size
            if end <= 0 or start >= size:
                continue
            for row in self.members(fs, archive, start, end):
                rows.append(row)
                held += len(row[2] or b"")
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, fs: pafs.FileSystem, archive: str, start: int, end: int) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
        """archive, name, media and error of the members whose header lies in the range.

        One handle serves all of them; a member that fails is tried again by its offset through a new one.
        What cannot be read in the end is a row with its error and no media; of an archive whose
        directory cannot be read there is one such row, without a name.
        """
        handle: list[Any] = []

        def opened(again: bool):
            if again and handle:
                self.closed(handle)
            if not handle:
                handle.append(fs.open_input_file(archive))
            return handle[0]

        def directory(again: bool) -> list[zipfile.ZipInfo]:
            f = opened(again)
            f.seek(0)
            return zipfile.ZipFile(f).infolist()

        infos, problem = self.tried(directory)
        if problem and start <= 0:
            yield archive, None, None, problem
        for info in infos or []:
            if start <= info.header_offset < end:
                data, problem = self.tried(lambda again, info=info: member(opened(again), info))
                yield archive, info.filename, data, problem
        self.closed(handle)

    def closed(self, handle: list) -> None:
        while handle:
            with contextlib.suppress(OSError):
                handle.pop().close()

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "name", "media", "error"])


def member(f: Any, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes, by its offset in the open archive."""
    f.seek(info.header_offset)
    name, extra = struct.unpack("<HH", f.read(30)[26:30])
    f.seek(info.header_offset + 30 + name + extra)
    data = f.read(info.compress_size)
    data = zlib.decompress(data, -15) if info.compress_type == zipfile.ZIP_DEFLATED else data
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"{info.filename} is damaged")
    return data


class MediaArchives(DataSource):
    """``spark.read.format("media_archives")``: archive, name, media bytes and error of every member of the archives in the manifest."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, name string, media binary, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MediaArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The members of the manifest's archives. The driver gets one name and size for each task that wrote archives, not for each archive."""
    spark.dataSource.register(MediaArchives)
    files = manifest.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.sum("size").alias("size")).orderBy("file")
    manifests = [[r["file"], r["size"]] for r in files.toLocalIterator()]
    return spark.read.format("media_archives").option("folder", folder).option("manifests", json.dumps(manifests)).option("range_bytes", range_bytes).load()


def media_features(df: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error of every stored member.

    A member that could not be read has its error and nulls; an unreadable archive has one such row, without an id.
    """
    fields = [
        T.StructField(n, t)
        for n, t in (
            ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
            ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
        )
    ]

    def make():
        def work(media: pa.Array) -> list:
            rows = []
            for x in media:
                data = x.as_py()
                if data is None:
                    rows.append((None,) * len(fields))
                    continue
                true, samples = from_wav(data)
                rows.append((true, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(samples)))
            return [list(c) for c in zip(*rows, strict=True)] or [[] for _ in fields]

        return work

    key = F.substring_index("name", "/", 1)
    made = add_columns(df, ["media"], make, fields, keep=["name", "error"])
    return made.select(F.when(key.startswith("="), F.url_decode(F.substr(key, F.lit(2))).cast(id_type)).alias("doc_id"), *[f.name for f in fields], "error")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read them back and describe what was read; one row per row of ``df``."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    manifest = write_archives(df, folder, id_col, text_col)
    return media_features(read_archives(spark, folder, manifest), df.schema[id_col].dataType.simpleString())
