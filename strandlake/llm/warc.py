"""WARC archives: a writer and a splittable reader, as the Spark data source "warc".

The writer makes one gzip member a record (WARC/1.1). Of records with equal payloads the one with the largest page_id is
a ``response`` with the payload; the others are ``revisit`` records of it that hold the HTTP header alone, whose
Content-Length, with the payload digest, still describes the full payload.

The reader splits files of any size: a task scans its byte range for the gzip magic, takes a candidate for a member only
if it decodes to a whole WARC header, however long, owns the records that start in its range (a last one is read beyond
its end) and goes on behind each record. A read error fails the task, as does a member that is cut off or damaged, if it
begins like a record or where a member has to begin.

Edge cases: a null html is an empty payload; payloads equal by SHA-1 and length are equal. Rows of the largest page_id
that repeat its payload are each a response; null page_ids lose to others and are read back as null. Line ends and blanks
in urls are percent-encoded; a record without url names its page. An empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage

from strandlake.llm.archives import ByteRange, Written, commit, discard, file_system, part_name, ranges
from strandlake.llm.common import group_lookup, new_folder

SUFFIX, MAGIC, START, PIECE = ".warc.gz", b"\x1f\x8b\x08", b"WARC/1.", 1 << 14
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES, LEVEL = 1 << 30, 64 << 20, 8 << 20, 3
SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, http_length long, payload binary, file string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record_type: str, record_id: str, target_uri: str, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A record as a gzip member. The payload of a revisit is described, not held."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target_uri}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode()) + press.compress(block + b"\r\n\r\n") + press.flush()


def _whole_head(data: bytearray, at: int) -> bool | None:
    """Whether data begins with a whole WARC header, which has no end before at; None if more of it is needed to tell."""
    if data[: len(START)] != START[: len(data)]:
        return False
    end = data.find(b"\r\n\r\n", at)
    return None if end < 0 else b"\r\ncontent-length:" in data[: end + 2].lower()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse(record: bytes) -> dict:
    end = record.index(b"\r\n\r\n")
    f = _fields(record[:end])
    block = record[end + 4 : end + 4 + int(f["content-length"])]
    if len(block) < int(f["content-length"]):
        raise ValueError("a WARC record ends before its block")
    http_length, payload = None, block
    if f.get("content-type", "").startswith("application/http"):
        at = block.index(b"\r\n\r\n")
        length = _fields(block[:at]).get("content-length")
        http_length, payload = int(length) if length else None, block[at + 4 :]
    return {
        "record_type": f.get("warc-type"), "record_id": f.get("warc-record-id", "").strip("<>"), "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
        "target_uri": f.get("warc-target-uri"), "payload_digest": f["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in f else None, "http_length": http_length, "payload": payload,
    }


def records(f, start: int, end: int, size: int, step: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) for the records of file f that start in [start, end)."""
    buf, base, at = b"", start, start
    border = None if start else 0  # where a member has to begin, as far as that is known

    def ahead(place: int, n: int) -> None:
        """Reads on, and forgets what lies before place, unless n bytes from place on are there (or the file ends)."""
        nonlocal buf, base
        if place + n > base + len(buf) < size:
            buf, base = buf[place - base :], place
            while len(buf) < min(max(n, step), size - base):
                f.seek(base + len(buf))
                more = f.read(min(max(n, step), size - base) - len(buf))
                if not more:
                    raise OSError("the file ends early")
                buf += more

    def cut_off(place: int) -> None:
        """The file ends in what may be a member from place on: fails if it is one, for which the file is read from its start."""
        if place == border:
            raise OSError("a gzip member is cut off")
        if start:
            for _ in records(f, 0, place + 1, size, step):
                pass

    while at < end:
        ahead(at, 3)
        if size - at < 3 and MAGIC.startswith(buf[at - base :]):
            cut_off(at)
        hit = buf.find(MAGIC, at - base)
        if hit < 0:
            at = max(at + 1, base + len(buf) - 2)
            continue
        at = base + hit
        if at >= end:
            return
        gunzip, out, used, seen, valid = zlib.decompressobj(31), [], at, bytearray(), None
        try:
            while not gunzip.eof and valid is not False and used < size:
                ahead(used, PIECE)
                piece = buf[used - base : used - base + PIECE]
                if len(seen) < len(START):  # the first bytes come alone: what is wrong behind them doesn't hide them
                    out.append(gunzip.decompress(piece, len(START) - len(seen)))
                    seen += out[-1]
                    valid = _whole_head(seen, 0)
                    piece, used = gunzip.unconsumed_tail, used + len(piece) - len(gunzip.unconsumed_tail) - len(gunzip.unused_data)
                if piece and valid is not False and not gunzip.eof:
                    out.append(gunzip.decompress(piece))
                    used += len(piece) - len(gunzip.unused_data)
                    if valid is None:
                        known = len(seen)
                        seen += out[-1]
                        valid = _whole_head(seen, max(known - 3, 0))
        except zlib.error:
            if valid or len(seen) >= len(START) or at == border:
                raise
            valid = False
        if valid is not False and not gunzip.eof:
            if valid or len(seen) >= len(START):
                raise OSError("a gzip member is cut off")
            cut_off(at)
        if not valid:
            at += 1
            ahead(at, 0)
            if at < base:  # reading on for the candidate has passed it by
                buf, base = b"", at
            continue
        yield at, b"".join(out)
        at = border = used


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        try:
            for b in iterator:
                for r in b.to_pylist():
                    if out is None:
                        names.append(part_name(SUFFIX))
                        out, size = system.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    m = member(r["record_type"], r["record_id"], r["target_uri"], r["payload"], r["refers_to"])
                    out.write(m)
                    size += len(m)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        commit(self.folder, messages)

    def abort(self, messages) -> None:
        discard(self.folder, messages)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        return ranges(self.folder, SUFFIX, self.split)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
        if partition is None:  # there is no file
            return
        system, path = file_system(self.folder)
        rows, size = [], 0
        with system.open_input_file(f"{path}/{partition.file}") as f:
            for offset, record in records(f, partition.start, partition.end, f.size()):
                rows.append(parse(record) | {"file": partition.file, "offset": offset})
                size += len(record)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class WarcSource(DataSource):
    """spark.read.format("warc").option("splitBytes", n).load(folder); df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(folder)


def page_records(pages: DataFrame) -> DataFrame:
    """The WARC records of pages: what the writer takes."""
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumns({"_sha": F.unhex(F.sha1("payload")), "_bytes": F.octet_length("payload")})
    page = group_lookup(page, ["_sha", "_bytes"], F.col("page_id"), {"_first": (F.col("page_id"), "max")})

    def urn(c: str) -> Column:
        return F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))

    first = F.col("page_id").eqNullSafe(F.col("_first"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), "[ \t]", "%20")
    return page.select(
        F.when(first, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"), urn("page_id").alias("record_id"), F.when(~first, urn("_first")).alias("refers_to"),
        F.coalesce(uri, urn("page_id")).alias("target_uri"), "payload",
    )


def write_pages(pages: DataFrame, folder: str) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    page_records(pages).write.format("warc").mode("append").save(folder)


def page_report(archive: DataFrame) -> DataFrame:
    """A row a record that ``write_pages`` wrote: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def base32(hexadecimal: Column) -> Column:
        fives = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
        return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def page(c: str) -> Column:
        return F.nullif(F.regexp_extract(c, "^urn:x-page:(.*)$", 1), F.lit("")).cast("long")

    held = F.col("record_type") == "response"
    return archive.select(
        page("record_id").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(held, base32(F.sha1("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages to a new folder of the shared folder and reports what is read back."""
    folder = new_folder(pages.sparkSession, "warc")
    write_pages(pages, folder)
    return page_report(read_warc(pages.sparkSession, folder, split_bytes))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i * 5 + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
