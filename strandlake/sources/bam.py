"""Reads without alignment as binary alignment records in blocked gzip, written by all tasks and read back.

A written folder holds a file with the header, one of records for each task, and one with the empty block that ends a file:
their bytes in order of name are one valid file. A task that is lost leaves nothing in it (``bgzf.BlockWriter``).

Edge cases: a null or empty name is ``*``; one of more than 254 bytes is an error, as the format can't hold it. Letters but
``=ACMGRSVTWYHKDBN`` are N, lower case is upper case. A quality that is null, or ``*`` beside bases, is missing; one of another
length than the bases is an error. The value of an ``i`` token is the whole number that it begins with, 0 without one, cut to
32 bits. Tokens that are not XX:Z:value or XX:i:value are left out. Texts are ASCII in the format; other letters of names
and values are written in UTF-8.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandlake.sources.bgzf import BATCH_BYTES, BlockText, BlockWriter, END, Range, block
from strandlake.sources.files import files_of, system_of

# fixed values of the format: first bytes, codes of bases, bin of a read without a place
START, BASES, BIN = b"BAM\1", b"=ACMGRSVTWYHKDBN", 4680
FIXED = struct.Struct("<iiBBHHHiiii")

HEADER_TEXT = b"@HD\tVN:1.6\tSO:unknown\n"
SCHEMA = "file string, nth long, name string, flag int, seq string, qual string, tags array<string>"
ROWS = pa.schema([("file", pa.string()), ("nth", pa.int64()), ("name", pa.string()), ("flag", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string()))])

_CODE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASES):
    _CODE[_c] = _CODE[ord(chr(_c).lower())] = _i
_LETTER = np.frombuffer(BASES, np.uint8)
_TOKEN = re.compile(r"([A-Za-z][A-Za-z0-9]):([Zi]):(.*)", re.DOTALL)


def header() -> bytes:
    return START + len(HEADER_TEXT).to_bytes(4, "little") + HEADER_TEXT + bytes(4)


def encode(name: str | None, flag: int, seq: str | None, qual: str | None, tags: list[str] | None) -> bytes:
    """One record with its length."""
    called = (name or "*").encode()
    if len(called) > 254:
        raise ValueError(f"a name of {len(called)} bytes has no place in a record: {name[:40]}...")
    bases = b"" if seq in (None, "*") else seq.encode("ascii", "replace")
    if qual is None or (qual == "*" and len(bases) != 1):
        marks = b"\xff" * len(bases)
    else:
        marks = (np.frombuffer(qual.encode("ascii", "replace"), np.uint8) - 33).tobytes()
    if len(marks) != len(bases):
        raise ValueError(f"{len(bases)} bases and {len(marks)} qualities in {name}")
    codes = _CODE[np.frombuffer(bases + b"=" * (len(bases) % 2), np.uint8)]
    aux = []
    for token in tags or ():
        if m := _TOKEN.fullmatch(token or ""):
            head = m[1].encode() + m[2].encode()
            if m[2] == "Z":
                aux.append(head + m[3].replace("\0", "").encode() + b"\0")
            else:
                number = re.match(r"\s*([+-]?[0-9]+)", m[3])
                aux.append(head + (int(number[1]) & 0xFFFFFFFF if number else 0).to_bytes(4, "little"))
    body = FIXED.pack(-1, -1, len(called) + 1, 0, BIN, 0, flag, len(bases), -1, -1, 0) + called + b"\0" + (codes[::2] << 4 | codes[1::2]).tobytes() + marks + b"".join(aux)
    return len(body).to_bytes(4, "little") + body


def decode(body: bytes) -> tuple[str, int, str, str, list[str]]:
    """name, flag, seq, qual, tags of a record without its length, as SAM shows them."""
    _, _, named, _, _, cigar, flag, n, *_ = FIXED.unpack_from(body)
    at = FIXED.size
    name = body[at : at + named - 1].decode(errors="replace")
    at += named + 4 * cigar
    packed = np.frombuffer(body, np.uint8, (n + 1) // 2, at)
    seq = _LETTER[np.stack([packed >> 4, packed & 15], 1).ravel()[:n]].tobytes().decode()
    at += (n + 1) // 2
    marks = np.frombuffer(body, np.uint8, n, at)
    qual = "*" if n == 0 or marks[0] == 255 else (marks + 33).tobytes().decode("latin-1")
    at, tags = at + n, []
    while at < len(body):
        kind = body[at + 2 : at + 3]
        if kind == b"Z":
            stop = body.index(b"\0", at)
            value = body[at + 3 : stop].decode(errors="replace")
        elif kind == b"i":
            stop = at + 6
            value = str(int.from_bytes(body[at + 3 : at + 7], "little", signed=True))
        else:
            raise ValueError(f"a tag of kind {kind!r} is not one of those written here")
        tags.append(f"{body[at : at + 2].decode()}:{kind.decode()}:{value}")
        at = stop + 1
    return name, flag, seq or "*", qual, tags


class _Writer(BlockWriter):
    head, end, ending = block(header()), END, ".bam"

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "flag", "seq", "qual", "tags")), strict=True):
                yield encode(*row)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Range]:
        return [Range(uri, 0, info.size) for uri, info in files_of(self.path)] or [Range(self.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.end:
            return
        system, path = system_of(part.file)
        with system.open_input_file(path) as f:
            nth, held, rows = 0, 0, []
            for body in bodies(BlockText(f, 0)):
                rows.append(decode(body))
                held += len(body) + 64
                if held >= BATCH_BYTES:
                    yield self._batch(part.file, nth, rows)
                    nth, held, rows = nth + len(rows), 0, []
            if rows:
                yield self._batch(part.file, nth, rows)

    @staticmethod
    def _batch(file: str, nth: int, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[file] * len(rows), range(nth, nth + len(rows)), *zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, ROWS, strict=True)], schema=ROWS)


def bodies(text: BlockText) -> Iterator[bytes]:
    """The records of a file, or of a part of one without a header; one that is cut off is an error."""

    def number() -> int:
        return int.from_bytes(exactly(4), "little")

    def exactly(n: int) -> bytes:
        data = text.read(n)
        if len(data) < n:
            raise ValueError("the file ends within a record")
        return data

    head = text.read(4)
    if head == START:
        exactly(number())
        for _ in range(number()):
            exactly(number() + 4)
        head = text.read(4)
    while head:
        if len(head) < 4:
            raise ValueError("the file ends within a record")
        yield exactly(int.from_bytes(head, "little"))
        head = text.read(4)


class UnalignedSource(DataSource):
    """spark.read.format("unaligned_bam").load(file or folder of parts), and df.write of name, flag, seq, qual, tags."""

    @classmethod
    def name(cls) -> str:
        return "unaligned_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, name, flag, seq, qual, tags of records without alignment; file and nth give the order. A file is one task, so
    a written folder is read by as many as wrote it."""
    spark.dataSource.register(UnalignedSource)
    return spark.read.format("unaligned_bam").load(path)


def write_bam(records: DataFrame, path: str) -> None:
    """Records as ``sinks.sam_fields`` gives them, in order of read_id and nth, to a new folder."""
    records.sparkSession.dataSource.register(UnalignedSource)
    rows = records.repartitionByRange("read_id").sortWithinPartitions("read_id", "nth")
    rows.select("name", F.col("flag").cast("int").alias("flag"), "seq", "qual", F.col("tags").cast("array<string>").alias("tags")).write.format("unaligned_bam").mode("append").save(path)
