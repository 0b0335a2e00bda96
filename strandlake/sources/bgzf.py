"""Blocked gzip: read by several tasks, and written.

A blocked file is a sequence of gzip members of at most 64 KB that state their own size, so a range of the file can find the
first block in it, and blocks can be read from there on. A range owns the blocks that begin in it; what of their text belongs
to it, lines or records, is found as in a plain file: it begins behind the first byte of the range's text and before the
second byte of the next range's (that first byte tells whether a line ends there). A block counts as one where its header,
size, text length and checksum hold. Whatever else
is in the file is an error, never passed over.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlake.sources.files import files_of, system_of

# fixed values of the format: first bytes of a block, its extra field, the empty block that ends a file
MAGIC = b"\x1f\x8b\x08\x04"
EXTRA = b"\x06\x00BC\x02\x00"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LARGEST, TEXT = 1 << 16, 0xFF00

WINDOW, BATCH_BYTES = 1 << 20, 8 << 20
LINES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("nth", pa.int64()), ("value", pa.string())])


def block(text: bytes) -> bytes:
    """One block that holds text, of ``TEXT`` bytes at most."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    size = len(data) + 26
    return MAGIC + b"\0\0\0\0\0\xff" + EXTRA + (size - 1).to_bytes(2, "little") + data + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def blocks_of(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces' bytes, one behind the other, as blocks."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) >= TEXT:
            whole = len(held) - len(held) % TEXT
            for at in range(0, whole, TEXT):
                yield block(bytes(held[at : at + TEXT]))
            del held[:whole]
    if held:
        yield block(bytes(held))


def block_size(head: bytes) -> int | None:
    """The size that a block's header states; None where no such header begins."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(extra):
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def inflate(raw: bytes) -> bytes:
    """The text of one whole block."""
    try:
        unpacker = zlib.decompressobj(-15)
        text = unpacker.decompress(raw[12 + int.from_bytes(raw[10:12], "little") : -8], LARGEST + 1)
    except zlib.error as e:
        raise ValueError(f"a block can't be read: {e}") from e
    if not unpacker.eof or len(text) != int.from_bytes(raw[-4:], "little") or zlib.crc32(text) != int.from_bytes(raw[-8:-4], "little"):
        raise ValueError("a block doesn't hold what it states")
    return text


def first_block(f, at: int, end: int) -> int | None:
    """Where the first block begins from at on, before end."""
    base = at
    while base < end:
        f.seek(base)
        data = f.read(2 * LARGEST)
        p = data.find(MAGIC)
        while 0 <= p < min(LARGEST, end - base):
            size = block_size(data[p : p + LARGEST])
            if size and p + size <= len(data):
                try:
                    inflate(data[p : p + size])
                except ValueError:
                    pass
                else:
                    return base + p
            p = data.find(MAGIC, p + 1)
        base += LARGEST
    return None


class BlockText:
    """The text of the blocks of f from one on, by place in that text, read a block at a time."""

    def __init__(self, f, first: int):
        self.f, self.at = f, 0
        self.places, self.starts = [first], [0]  # of the blocks known, and of the next one, in the file and in the text
        self.held, self.base, self.window = (-1, b""), 0, b""

    def _bytes(self, at: int, n: int) -> bytes:
        if not self.base <= at <= at + n <= self.base + len(self.window):
            self.f.seek(at)
            self.base, self.window = at, self.f.read(max(n, WINDOW))
        return self.window[at - self.base : at - self.base + n]

    def _grow(self) -> bool:
        """Takes the next block in; False at the end of the file."""
        at = self.places[-1]
        head = self._bytes(at, 18)
        if not head:
            return False
        if head[:4] == MAGIC:
            head = self._bytes(at, 12 + int.from_bytes(head[10:12], "little"))
        size = block_size(head)
        length = self._bytes(at + size - 4, 4) if size else b""
        if len(length) < 4:
            raise ValueError(f"no whole block at byte {at}")
        self.places.append(at + size)
        self.starts.append(self.starts[-1] + int.from_bytes(length, "little"))
        return True

    def owned(self, end: int) -> int:
        """The length of the text of the blocks that begin before end."""
        while self.places[-1] < end and self._grow():
            pass
        return self.starts[-1]

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self.starts[-1] <= self.at:
                if self._grow():
                    continue
                break
            k = bisect_right(self.starts, self.at) - 1
            if self.held[0] != k:
                self.held = k, inflate(self._bytes(self.places[k], self.places[k + 1] - self.places[k]))
            skip = self.at - self.starts[k]
            out.append(self.held[1][skip : skip + n])
            n -= len(out[-1])
            self.at += len(out[-1])
        return b"".join(out)


def text_of(f, start: int, end: int, size: int) -> tuple[BlockText, int, int] | None:
    """(text, from, to): what begins at places from to to of the text belongs to the range of a file of size bytes; None where
    no block does. The block that follows the range's last one has to be the next that can be read, so none is passed over."""
    first = first_block(f, start, end)
    if start == 0 and first != 0:
        raise ValueError("the file doesn't begin with a block that can be read")
    if first is None:
        return None
    text = BlockText(f, first)
    length = text.owned(end)
    if (first_block(f, end, size) if end < size else None) != (text.places[-1] if text.places[-1] < size else None):
        raise ValueError(f"no block that can be read at byte {text.places[-1]}")
    return text, int(start > 0), 1 + length


def is_blocked(system: fs.FileSystem, path: str) -> bool:
    with system.open_input_file(path) as f:
        return block_size(f.read(1 << 10)) is not None


def all_blocked(path: str) -> bool:
    """Whether the file, or each file of the folder, is one in blocks. Of a file system that only Spark knows, none is."""
    try:
        system, _ = system_of(path)
    except pa.ArrowInvalid:
        return False
    found = files_of(path)
    return bool(found) and all(uri.endswith((".gz", ".bgz")) and is_blocked(system, info.path) for uri, info in found)


def lines_of(text, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin at places from start to before end, without their ends."""
    text.seek(max(start - 1, 0))
    at, held, skipping = max(start - 1, 0), b"", start > 0
    while at < end:
        data = text.read(LARGEST)
        held += data
        *whole, held = held.split(b"\n") if data else (*held.split(b"\n"), b"")
        for line in whole:
            if at >= end:
                return
            at += len(line) + 1
            if skipping:
                skipping = False
            elif data or line:
                yield line.removesuffix(b"\r")
        if not data:
            return


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class _LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Range]:
        return [Range(uri, a, min(a + self.split, info.size)) for uri, info in files_of(self.path) for a in range(0, info.size, self.split)] or [Range(self.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:
            return
        system, path = system_of(part.file)
        with system.open_input_file(path) as f:
            found, nth, held, rows = text_of(f, part.start, part.end, f.size()), 0, 0, []
            for line in lines_of(*found) if found else ():
                rows.append(line.decode(errors="replace"))
                held += len(line) + 64
                if held >= BATCH_BYTES:
                    yield self._batch(part, nth, rows)
                    nth, held, rows = nth + len(rows), 0, []
            if rows:
                yield self._batch(part, nth, rows)

    @staticmethod
    def _batch(part: Range, nth: int, rows: list[str]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(nth, nth + n), pa.int64()), pa.array(rows, pa.string())], schema=LINES)


@dataclass
class Written(WriterCommitMessage):
    file: str


class BlockWriter(DataSourceArrowWriter):
    """A folder of files of blocks, one a task, whose order of names is that of the partitions. Files of tasks that were lost or
    run twice go with the commit. ``head`` and ``end`` are files before and behind them, or None; where there is no ``end``, each
    file ends with an empty block. A folder that holds anything is written only in mode overwrite, and emptied by the commit."""

    head: bytes | None = None
    end: bytes | None = None
    ending = ".gz"

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        system, folder = system_of(self.path)
        if not overwrite and system.get_file_info(folder).type != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(folder)):
            raise ValueError(f"{self.path} is there and not empty")
        system.create_dir(folder, recursive=True)

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for value in batch.column("value").to_pylist():
                yield b"" if value is None else value.encode() + b"\n"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = system_of(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.ending}"
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for data in blocks_of(self.pieces(iterator)):
                out.write(data)
            if self.end is None:
                out.write(END)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = system_of(self.path)
        kept = {m.file for m in messages if m}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.is_file and info.base_name not in kept:
                system.delete_file(info.path)
        for name, data in (("head", self.head), ("tail", self.end)):
            if data is not None:
                with system.open_output_stream(f"{folder}/{name}{self.ending}", compression=None) as out:
                    out.write(data)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = system_of(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{folder}/{m.file}")


class BlockedLines(DataSource):
    """spark.read.format("blocked_lines").load(file or folder): the lines of blocked gzip; df.write of a column value makes it."""

    @classmethod
    def name(cls) -> str:
        return "blocked_lines"

    def schema(self) -> str:
        return "file string, offset long, nth long, value string"

    def reader(self, schema) -> _LinesReader:
        return _LinesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(dict(self.options), overwrite)


def read_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """file, offset, nth, value: offset is that of the range of the file, nth the line's number in it."""
    spark.dataSource.register(BlockedLines)
    return spark.read.format("blocked_lines").option("splitBytes", split_bytes).load(path)


def write_lines(df: DataFrame, value: Column, path: str) -> None:
    """A line a row, in the order of partitions and rows, as a folder of blocked files; null is no line."""
    df.sparkSession.dataSource.register(BlockedLines)
    df.select(value.alias("value")).where(F.col("value").isNotNull()).write.format("blocked_lines").mode("append").save(path)
