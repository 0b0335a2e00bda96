"""FASTA as pieces of contigs: byte ranges that may begin anywhere, so that several tasks read one contig.

A range doesn't know which contig it begins in, nor whether its first bytes belong to a header. A first pass sums up each
range in one row; what comes before a range follows from these, and is added to the pieces of the second pass.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandlake.sources.fastx import SPLIT_BYTES, Part
from strandlake.sources.files import files_of, system_of

#: bytes that are read at once, bases of a piece, and bases of a batch of them
WINDOW, PIECE, BATCH_BASES = 1 << 20, 1 << 16, 8 << 20
PIECES = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("lead", pa.bool_()), ("name", pa.string()), ("at", pa.int64()), ("bases", pa.string())])
SUMS = pa.schema([("part", pa.int32()), ("lead", pa.int64()), ("ended", pa.bool_()), ("over", pa.bool_()), ("headers", pa.int32()), ("tail", pa.int64()), ("name", pa.string())])


def header_name(line: bytes) -> str:
    """The name in a header, up to the first white space; bytes that are no UTF-8 are replaced."""
    word = line[1:].replace(b"\t", b" ").replace(b"\v", b" ").replace(b"\f", b" ").partition(b" ")[0]
    return word.rstrip(b"\r").decode(errors="replace")


def tokens(f, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """What bytes start to end of f hold, in order: ``lead`` (bytes before the first line that begins there, which may belong
    to a header), ``line`` (that line begins, once, if there was a lead), ``header`` and ``bases``. A header that begins in
    the range is read to its end, wherever that is (``over``: the range ends within it); bases have no line ends. end < 0: up to
    the end of a stream."""
    if end < 0:
        fresh = True
    else:
        f.seek(max(start - 1, 0))
        fresh = start == 0 or f.read(1) == b"\n"
    lead, at = not fresh, start
    while end < 0 or at < end:
        data = f.read(WINDOW if end < 0 else min(WINDOW, end - at))
        if not data:
            return
        at += len(data)
        if lead:
            stop = data.find(b"\n")
            if stop < 0:
                yield "lead", data
                continue
            yield "lead", data[:stop]
            yield "line", b""
            lead, fresh, data = False, True, data[stop + 1 :]
        while data:
            head = 0 if fresh and data[:1] == b">" else data.find(b"\n>") + 1
            if head == 0 and not (fresh and data[:1] == b">"):
                yield "bases", data.translate(None, b"\r\n")
                fresh = data.endswith(b"\n")
                break
            if head:
                yield "bases", data[:head].translate(None, b"\r\n")
            stop, data = data.find(b"\n", head), data[head:]
            if stop >= 0:
                yield "header", data[: stop - head]
                data, fresh = data[stop - head + 1 :], True
                continue
            rest = f.readline()
            at += len(rest)
            yield "header", data + rest.rstrip(b"\n")
            data, fresh = b"", True
            if 0 <= end < at:
                yield "over", b""


def rows(f, part: Part) -> Iterator[tuple]:
    """Pieces of a range: part, contigs begun before in it, whether a lead, the name, place, bases. Places count from the
    last header of the range, or from its beginning, without the lead; a contig without bases is one empty piece."""
    nth, name, lead = 0, None, False
    at, held, size, empty = 0, [], 0, False

    def cut(least: int) -> Iterator[tuple]:
        nonlocal at, held, size, empty
        if size < least or not (size or empty):
            return
        text, done = b"".join(held).decode("latin-1"), 0
        while len(text) - done >= max(least, 1) or (least == 0 and empty):
            piece = text[done : done + PIECE]
            yield part.number, nth, lead, name, at, piece
            done, at, empty = done + len(piece), at + len(piece), False
        held, size = ([text[done:].encode("latin-1")], len(text) - done) if done < len(text) else ([], 0)

    for kind, data in tokens(f, part.start, part.end):
        if kind in ("lead", "bases"):
            lead = kind == "lead"
            held.append(data.translate(None, b"\r"))
            size += len(held[-1])
            yield from cut(PIECE)
            continue
        yield from cut(0)
        lead = False
        if kind == "line":
            at = 0
        if kind == "header":
            nth, name, at, empty = nth + 1, header_name(data), 0, True
    yield from cut(0)


def sums(f, part: Part) -> tuple:
    """A range in one row: bases of its lead, whether a line begins in it, whether it ends within a header, headers, bases
    behind the last one or, where there is none, all but the lead, and the last name."""
    lead, tail, headers, name, ended, over = 0, 0, 0, None, part.start == 0, False
    for kind, data in tokens(f, part.start, part.end):
        if kind == "lead":
            lead += len(data) - data.count(b"\r")
        elif kind == "bases":
            tail, ended = tail + len(data), True
        elif kind == "header":
            headers, tail, name, ended = headers + 1, 0, header_name(data), True
        else:
            ended, over = True, kind == "over"
    return part.number, lead, ended, over, headers, tail, name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.summary = options["path"], int(options.get("splitbytes", SPLIT_BYTES)), options.get("summary") == "true"

    def partitions(self) -> list[Part]:
        cuts: list[tuple[str, int, int]] = []
        for uri, info in files_of(self.path):
            if uri.endswith(".gz"):
                cuts.append((uri, 0, -1))
            else:
                cuts += [(uri, a, min(a + self.split, info.size)) for a in range(0, info.size, self.split)]
        return [Part(n, *c, False) for n, c in enumerate(cuts or [(self.path, 0, 0)])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:  # nothing is there
            return
        system, path = system_of(part.file)
        with system.open_input_file(path) as f:
            data = gzip.GzipFile(fileobj=f) if part.end < 0 else io.BufferedReader(f, WINDOW)
            if self.summary:
                yield _batch([sums(data, part)], SUMS)
                return
            held, size = [], 0
            for row in rows(data, part):
                held.append(row)
                size += len(row[-1]) + 64
                if size >= BATCH_BASES:
                    yield _batch(held, PIECES)
                    held, size = [], 0
            if held:
                yield _batch(held, PIECES)


def _batch(found: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)


class FastaSource(DataSource):
    """spark.read.format("fasta_ranges").load(file or folder): pieces by range or, with summary, a row a range."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        if self.options.get("summary") == "true":
            return "part int, lead long, ended boolean, over boolean, headers int, tail long, name string"
        return "part int, nth int, lead boolean, name string, at long, bases string"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def carried(parts: list[tuple]) -> list[tuple]:
    """What comes before each range, from all ranges' sums in order: (part, number and name of the contig it begins in, its
    bases before the range, whether the range begins in a header, the bases of its lead)."""
    out, number, name, offset, inside = [], -1, None, 0, False
    for part, lead, ended, over, headers, tail, last in parts:
        lead = 0 if inside else lead
        out.append((part, number, name, offset, inside, lead))
        if headers:
            number, name, offset = number + headers, last, tail
        else:
            offset += lead + tail
        inside = over or (inside and not ended)
    return out


def read_pieces(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ordinal, name, start, bases): contigs of FASTA, a file or a folder of files, in pieces of ``PIECE`` bases at most.

    A plain file is read by ranges of ``split_bytes`` bytes, wherever its lines end; no task, row or group holds a contig. A
    ``.gz`` file is one task, which holds a piece at a time. Contigs are numbered from 0 on in order of files and places; one
    without bases is an empty piece, names may repeat. A file of a folder that begins without a header goes on with the
    contig of the file before, as files that Spark cut out of one text do; bases before any header are left out. Blank lines
    and carriage returns don't count; a base is a byte. An empty file gives no rows. The files are read twice; the driver
    holds a row a range, as its list of tasks does.
    """
    spark.dataSource.register(FastaSource)
    source = spark.read.format("fasta_ranges").option("splitBytes", split_bytes)
    before = carried(sorted(map(tuple, source.option("summary", "true").load(path).collect())))
    table = spark.createDataFrame(before, "part int, _number long, _name string, _offset long, _inside boolean, _lead long")
    found = spark.read.format("fasta_ranges").option("splitBytes", split_bytes).load(path).join(F.broadcast(table), "part")  # a row a range
    found = found.where(~(F.col("lead") & F.col("_inside"))).withColumn("ordinal", F.col("_number") + F.col("nth")).where("ordinal >= 0")
    ahead = F.when(F.col("nth") == 0, F.col("_offset") + F.when(F.col("lead"), F.lit(0)).otherwise(F.col("_lead"))).otherwise(F.lit(0))
    return found.select("ordinal", F.when(F.col("nth") == 0, F.col("_name")).otherwise(F.col("name")).alias("name"), (F.col("at") + ahead).cast("long").alias("start"), "bases")
