"""Media columns: payloads kept as media members of archives, read by the Spark data source "media_zip".

The writer stores each payload losslessly as an 8-bit grey PNG of 64 samples a line (padded with zero bytes to whole
lines, one at least; the unpadded length goes into a text chunk) as a member of ZIP archives of bounded size. The reader
plans byte ranges over the archives of a folder; a task owns the members whose header starts in its range, streams them
as Arrow batches, and when a member can't be read (or fails its check sum) opens the archive anew and tries that member
again by its offset, while the others stay as they are.

A member that still fails at the third try fails its task, which Spark runs again elsewhere; after that the job fails: a
damaged member is an error, never a lost row. ``from_png`` reads what ``to_png`` writes (8-bit grey, no filters, not
interlaced); other PNGs are an error.

Edge cases: a null text is the empty text, stored as one line of zeros; texts may have any length (a member is held whole
in its task); equal texts give equal members and values; null ids are read back as null. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from strandlake.llm.archives import ByteRange, Written, commit, discard, file_system, part_name, ranges
from strandlake.llm.common import new_folder

SUFFIX, WIDTH, LEVEL, TRIES = ".zip", 64, 2, 3
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 8 << 20
SCHEMA = "member_id string, archive string, offset long, media binary"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    lines = max(1, -(-len(payload) // WIDTH))
    rows = np.zeros((lines, WIDTH + 1), np.uint8)  # each line begins with its filter, 0: none
    rows[:, 1:] = np.frombuffer(payload.ljust(lines * WIDTH, b"\0"), np.uint8).reshape(lines, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, lines, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0" + str(len(payload)).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """The samples and the unpadded length of a PNG as ``to_png`` writes them."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, head, packed, length = len(SIGNATURE), None, [], None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk fails its check sum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            length = int(data[6:])
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG without interlace")
    width, lines = head[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(lines, width + 1)
    if rows[:, 0].any():
        raise ValueError("a PNG line is filtered")
    return np.ascontiguousarray(rows[:, 1:]).reshape(-1), length if length is not None else width * lines


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    n = np.bincount(samples, minlength=256)
    p, v = n / n.sum(), np.arange(256)
    mean = float(p @ v)
    deviation = float(np.sqrt(max(0.0, p @ (v - mean) ** 2)))
    q = p[p > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float(-(q * np.log2(q)).sum())):.4f};step={step:.4f}"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        names, out, archive, size = [], None, None, 0

        def close() -> None:
            if archive is not None:
                archive.close()
                out.close()

        try:
            for b in iterator:
                for key, payload in zip(b.column("member_id").to_pylist(), b.column("payload").to_pylist(), strict=True):
                    if archive is None:
                        names.append(part_name(SUFFIX))
                        out = system.open_output_stream(f"{path}/{names[-1]}", compression=None)
                        archive, size = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                    media = to_png(payload)
                    archive.writestr(zipfile.ZipInfo(f"{len(archive.filelist):07d}{'' if key is None else f'-{key}'}.png"), media)
                    size += len(media) + 128
                    if size >= ARCHIVE_BYTES:
                        close()
                        archive = None
        finally:
            close()
        return Written(names)

    def commit(self, messages) -> None:
        commit(self.folder, messages)

    def abort(self, messages) -> None:
        discard(self.folder, messages)


def members(opened: Callable[[], object], start: int, end: int) -> Iterator[tuple[int, str, bytes]]:
    """(offset, name, bytes) of the members of an archive whose header starts in [start, end)."""
    f = opened()
    archive = zipfile.ZipFile(f)
    for info in archive.infolist():
        if start <= info.header_offset < end:
            for left in range(TRIES - 1, -1, -1):
                try:
                    media = archive.read(info)
                    break
                except (OSError, zipfile.BadZipFile, EOFError, zlib.error):
                    if not left:
                        raise
                    f.close()
                    f = opened()
                    archive.fp = f  # the directory stays; the member is read again from its offset
            yield info.header_offset, info.filename, media
    f.close()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        return ranges(self.folder, SUFFIX, self.split)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        kinds = pa.schema([("member_id", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        system, path = file_system(self.folder)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for offset, name, media in members(lambda: system.open_input_file(f"{path}/{partition.file}"), partition.start, partition.end):
            rows.append((name[8:-4] if name[7] == "-" else None, partition.file, offset, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


class MediaSource(DataSource):
    """spark.read.format("media_zip").option("splitBytes", n).load(folder); df(member_id, payload).write.format("media_zip").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "media_zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write_media(payloads: DataFrame, folder: str) -> None:
    """payloads: member_id string, payload binary."""
    payloads.sparkSession.dataSource.register(MediaSource)
    payloads.write.format("media_zip").mode("append").save(folder)


def read_media(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_zip").option("splitBytes", split_bytes).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """A row a member: member_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    out = "member_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for key, m in zip(b.column("member_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                samples, n = from_png(m)
                payload = samples.tobytes()
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in out.split(", ")])

    return media.select("member_id", "media").mapInArrow(run, out)


def text_media(docs: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stores the texts of docs as media in a new folder of the shared folder; the features of what is read back, by doc_id."""
    folder = new_folder(docs.sparkSession, "media")
    kind = docs.schema["doc_id"].dataType
    write_media(docs.select(F.col("doc_id").cast("string").alias("member_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("payload")), folder)
    rows = media_features(read_media(docs.sparkSession, folder, split_bytes))
    return rows.select(F.col("member_id").cast(kind).alias("doc_id"), *[c for c in rows.columns if c != "member_id"])
