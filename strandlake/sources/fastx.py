"""FASTA and FASTQ files as a Spark data source that splits plain files and blocked gzip at records, and reads made of them."""

from __future__ import annotations

import gzip
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import bgzf
from strandlake.sources.files import files_of, system_of

SPLIT_BYTES, BATCH_ROWS, BATCH_BYTES, WINDOW = 64 << 20, 20_000, 16 << 20, 1 << 20
SCHEMA = "part int, nth long, name string, comment string, seq string, qual string"


@dataclass
class Part(InputPartition):
    number: int
    file: str
    start: int
    end: int
    fastq: bool = True
    blocked: bool = False


def parse_records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of FASTA or FASTQ lines; sequences may take several lines.

    A record whose quality is missing or has another length ends the file, as do records after it.
    """
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (b">", b"@"):
            line = next(lines, None)
            continue
        name, _, comment = re.sub(rb"\s", b" ", line[1:], count=1).partition(b" ")
        seq = []
        line = next(lines, None)
        while line is not None and line[:1] not in (b">", b"@", b"+"):
            seq.append(line)
            line = next(lines, None)
        bases = b"".join(seq)
        if line is None or line[:1] != b"+":
            yield name.decode(), comment.decode(), bases.decode(), None
            continue
        qual, size = [], 0
        while size < len(bases) and (line := next(lines, None)) is not None:
            qual.append(line)
            size += len(line)
        if size != len(bases):
            return
        yield name.decode(), comment.decode(), bases.decode(), b"".join(qual).decode()
        line = next(lines, None)


def _lines(f) -> Iterator[bytes]:
    for line in f:
        yield line.rstrip(b"\r\n")


def record_start(data: bytes, fastq: bool, last: bool = True) -> tuple[int | None, int]:
    """(where the first record begins in data, the line end to look on from where there is none yet).

    data is cut out of a file, up to its end if last. A FASTA record begins at a line with >, a FASTQ record at a line with @
    that a line, a line with + and a quality as long as the first one follow (a quality may begin with @ or > too). A line
    with @ is a record only where all four lines are there; at the end of the file the last one needs no line end.
    """
    at = data.find(b"\n")
    while at >= 0:
        p = at + 1
        head = data[p : p + 1]
        if not head and not last:
            return None, at
        if head == b">" and not fastq:
            return p, at
        if head == b"@" and fastq:
            ends, q = [], p
            while len(ends) < 4 and (q := data.find(b"\n", q)) >= 0:
                ends.append(q)
                q += 1
            if last and len(ends) == 3:
                ends.append(len(data))
            if len(ends) < 4 and not last:
                return None, at
            if len(ends) == 4:
                seq, plus, qual = (data[i + 1 : j] for i, j in zip(ends, ends[1:], strict=False))
                if plus[:1] == b"+" and len(seq.rstrip(b"\r")) == len(qual.rstrip(b"\r")):
                    return p, at
        at = data.find(b"\n", p)
    return None, len(data)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        """Parts of the file, or of the files of a folder in order of name, as Spark writes them."""
        system, _ = system_of(self.path)
        cuts = [c for uri, info in files_of(self.path) for c in self._cuts(system, uri, info)]
        return [Part(n, *c) for n, c in enumerate(cuts or [(self.path, 0, 0)])]

    def _cuts(self, system: fs.FileSystem, uri: str, info: fs.FileInfo) -> list[tuple[str, int, int, bool, bool]]:
        packed = uri.endswith((".gz", ".bgz"))
        blocked = packed and bgzf.is_blocked(system, info.path)
        if packed and not blocked:
            return [(uri, 0, -1, True, False)]
        with system.open_input_file(info.path) as f:
            head = (bgzf.BlockText(f, 0) if blocked else f).read(WINDOW)
        multiline, fastq = self._multiline(head), head[:1] == b"@"
        step = max(info.size, 1) if multiline else self.split
        return [(uri, a, min(a + step, info.size), fastq, blocked) for a in range(0, max(info.size, 1), step)]

    @staticmethod
    def _multiline(head: bytes) -> bool:
        """FASTQ with sequences over several lines can't be split safely."""
        lines = head.split(b"\n")
        return lines[0][:1] == b"@" and len(lines) > 2 and lines[2][:1] != b"+"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start == part.end:  # nothing is there
            return
        kinds = pa.schema([("part", pa.int32()), ("nth", pa.int64()), *((n, pa.string()) for n in ("name", "comment", "seq", "qual"))])
        system, path = system_of(part.file)
        with system.open_input_file(path) as f:
            if part.end < 0:
                found = parse_records(_lines(io.BufferedReader(gzip.GzipFile(fileobj=f))))
            elif part.blocked:
                mine = bgzf.text_of(f, part.start, part.end, f.size())
                found = self._range(mine[0], replace(part, start=mine[1], end=mine[2]), sys.maxsize) if mine else ()
            else:
                found = self._range(f, part, f.size())
            rows: list[tuple] = []
            nth = held = 0
            for r in found:
                rows.append((part.number, nth, *r))
                nth += 1
                held += len(r[2])
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    @staticmethod
    def _range(f, part: Part, size: int) -> Iterator[tuple]:
        """The records that begin in the range."""

        def begin(at: int, until: int) -> int:
            """The first record from at on, however far: both parts at a border find the same one. The end of the file if
            none begins before until."""
            if at >= size or at == 0:
                return at
            base, data, ahead = at - 1, b"", WINDOW  # a record at the border begins behind the line end before it
            while True:
                f.seek(base + len(data))
                more = f.read(ahead)
                data += more
                last = not more or base + len(data) >= size
                found, on = record_start(data, part.fastq, last)
                if found is not None:
                    return base + found
                if last or base + on + 1 >= until:
                    return size
                ahead = max(WINDOW, len(data) - on)  # a record longer than the window is read in pieces that double
                base, data = base + on, data[on:]

        start = begin(part.start, part.end)
        end = begin(part.end, size) if start < part.end else start
        return parse_records(_lines(_pieces(f, start, end)))


def _pieces(f, start: int, end: int) -> io.BufferedReader:
    """The bytes of f from start to end as a stream, read a window at a time."""

    class Piece(io.RawIOBase):
        at = start

        def readable(self) -> bool:
            return True

        def readinto(self, to) -> int:
            f.seek(self.at)
            data = f.read(min(len(to), end - self.at)) if self.at < end else b""
            to[: len(data)] = data
            self.at += len(data)
            return len(data)

    return io.BufferedReader(Piece(), WINDOW)


class FastxSource(DataSource):
    """spark.read.format("fastx").load(file or folder): FASTA or FASTQ, plain, .gz or .gz in blocks (split too); part and nth give the order."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_fastx(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(ordinal, seg): the records of a file, or of a folder of files, with their number, from 0 on. Parts are counted first; a
    part is a row there."""
    spark.dataSource.register(FastxSource)
    rows = spark.read.format("fastx").option("splitBytes", split_bytes).load(path)
    sizes = sorted(map(tuple, rows.groupBy("part").agg(F.count(F.lit(1))).collect()))
    offsets, at = [], 0
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    table = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))  # a row a part of the file
    seg = F.struct("name", "comment", "seq", F.coalesce("qual", F.expr("repeat('K', length(seq))")).alias("qual"))
    return rows.join(table, "part").select((F.col("nth") + F.col("before")).alias("ordinal"), seg.alias("seg"))


def read_reads(spark: SparkSession, runs: list[list[str]], interleaved: int = 0, run_ids: list[int] | None = None) -> DataFrame:
    """Reads of runs of files in lock step (up to the shortest), one run after the other; interleaved: segments in one file."""
    out, at = None, 0
    for k, files in enumerate(runs):
        run_id = run_ids[k] if run_ids else k
        if interleaved:
            rows = read_fastx(spark, files[0]).withColumn("read", F.floor(F.col("ordinal") / interleaved))
            reads = rows.groupBy("read").agg(F.sort_array(F.collect_list(F.struct("ordinal", "seg"))).alias("s")).where(F.size("s") == interleaved)
            reads = reads.select(F.col("read").alias("ordinal"), F.transform("s", lambda x: x.seg).alias("segs"))
        else:
            reads = read_fastx(spark, files[0]).select("ordinal", F.col("seg").alias("seg0"))
            for j, f in enumerate(files[1:], 1):
                reads = reads.join(read_fastx(spark, f).select("ordinal", F.col("seg").alias(f"seg{j}")), "ordinal")
            reads = reads.select("ordinal", F.array(*[f"seg{j}" for j in range(len(files))]).alias("segs"))
        reads = reads.select((F.col("ordinal") + at).alias("read_id"), F.lit(run_id).alias("run_id"), "segs")
        if k + 1 < len(runs):
            at += reads.count()
        out = reads if out is None else out.unionByName(reads)
    return out


def read_batch(spark: SparkSession, lines: list[str], interleaved: int = 0) -> DataFrame:
    """Reads of the runs of a batch table (``name file file ...`` a line); run_id is the number of the name."""
    from strandlake.operators.assign import remultiplexed

    rows = remultiplexed(spark, lines)
    return read_reads(spark, [files for _, _, files in rows], interleaved, [number for _, number, _ in rows])
