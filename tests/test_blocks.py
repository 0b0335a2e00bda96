"""Blocked gzip and binary alignment records: every split, every part, broken files."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import bam, bgzf, tables
from strandlake.sources.fastx import Part, _Reader, read_fastx


def _blocked(text: bytes, sizes: list[int]) -> bytes:
    """text in blocks of the given sizes, in turn; 0 is an empty block."""
    out, at, k = b"", 0, 0
    while at < len(text):
        out += bgzf.block(text[at : at + sizes[k % len(sizes)]])
        at, k = at + sizes[k % len(sizes)], k + 1
    return out + bgzf.END


def _fastq(n: int, seed: int = 1) -> bytes:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 7, 40])
        qual = "".join(rng.choices("@+>I#", k=size))
        rows.append(f"@r{i} c{i}\n{''.join(rng.choices('ACGT', k=size))}\n+\n{qual}\n")
    return "".join(rows).encode()


def _by_ranges(data: bytes, split: int) -> list[bytes]:
    f, out = io.BytesIO(data), []
    for a in range(0, len(data), split):
        found = bgzf.text_of(f, a, min(a + split, len(data)), len(data))
        out += list(bgzf.lines_of(*found)) if found else []
    return out


@pytest.mark.parametrize("sizes", [[1], [5, 0, 3], [40], [1000]])
def test_lines_at_every_split(sizes):
    for text in (b"", b"a", b"a\n", b"\n\n", b"one\ntwo\r\n\nthree", b"\n" + b"x" * 90 + b"\nyy\n", _fastq(6)):
        data = _blocked(text, sizes)
        assert gzip.decompress(data) == text
        want = [x.removesuffix(b"\r") for x in text.split(b"\n")]
        want = want[:-1] if want[-1] == b"" else want
        for split in (*range(1, 60, 7), 97, 1000, 1 << 20):
            assert _by_ranges(data, split) == want, (text, split)


def test_lines_longer_than_a_block():
    text = b"a" * 200_000 + b"\nb\n" + b"c" * 70_000
    data = b"".join(bgzf.blocks_of([text])) + bgzf.END
    assert _by_ranges(data, 100) == _by_ranges(data, 1 << 20) == text.split(b"\n")


@pytest.mark.parametrize("split", [1, 50, 333, 5000, 1 << 20])
def test_records_at_every_split(spark, tmp_path, split):
    text = _fastq(60)
    (tmp_path / "r.fastq.gz").write_bytes(_blocked(text, [33, 100, 0, 7]))
    (tmp_path / "p.fastq").write_bytes(text)
    reader = _Reader({"path": str(tmp_path / "r.fastq.gz"), "splitbytes": str(split)})
    got = [row for part in reader.partitions() for b in reader.read(part) for row in zip(*(b.column(c).to_pylist() for c in ("name", "comment", "seq", "qual")), strict=True)]
    plain = _Reader({"path": str(tmp_path / "p.fastq")})
    want = [row for part in plain.partitions() for b in plain.read(part) for row in zip(*(b.column(c).to_pylist() for c in ("name", "comment", "seq", "qual")), strict=True)]
    assert got == want and len(want) == 60
    assert len(reader.partitions()) > 1 or split > 2000


def test_blocked_file_through_spark(spark, tmp_path):
    text = _fastq(5000, 3)
    (tmp_path / "r.fq.gz").write_bytes(b"".join(bgzf.blocks_of([text])) + bgzf.END)
    (tmp_path / "p.fq").write_bytes(text)
    rows = read_fastx(spark, str(tmp_path / "r.fq.gz"), split_bytes=20_000)
    assert rows.rdd.getNumPartitions() > 1
    assert rows.orderBy("ordinal").collect() == read_fastx(spark, str(tmp_path / "p.fq")).orderBy("ordinal").collect()


def test_plain_gzip_and_fake_blocks(spark, tmp_path):
    (tmp_path / "r.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\nII\n"))
    assert [r.seg.seq for r in read_fastx(spark, str(tmp_path / "r.fq.gz")).collect()] == ["AC"]
    real = bgzf.block(b"one\ntwo\n")
    fake = bgzf.MAGIC + b"\0\0\0\0\0\xff" + bgzf.EXTRA + (40).to_bytes(2, "little") + b"z" * 30
    assert bgzf.first_block(io.BytesIO(fake + real), 0, 1000) == len(fake)
    assert bgzf.first_block(io.BytesIO(fake), 0, 1000) is None


def test_broken_blocks_are_errors():
    data = bytearray(bgzf.block(b"one\ntwo\n") + bgzf.block(b"three\n"))
    data[-9] ^= 1
    with pytest.raises(ValueError):
        bgzf.BlockText(io.BytesIO(bytes(data)), 0).read(100)
    with pytest.raises(ValueError):
        bgzf.BlockText(io.BytesIO(bytes(data[:-3])), 0).read(100)


@pytest.mark.parametrize("broken", [0, 1, 2, 3])
def test_no_range_passes_over_a_broken_block(broken):
    blocks = [bytearray(bgzf.block(f"line {k}\n".encode())) for k in range(4)]
    blocks[broken][20] ^= 0xFF
    data = b"".join(bytes(b) for b in blocks) + bgzf.END
    for split in (1, 10, 37, 60, 1000):
        with pytest.raises(ValueError):
            _by_ranges(data, split)
    whole = b"".join(bgzf.block(f"line {k}\n".encode()) for k in range(4))
    for split in (1, 10, 37, 60, 1000):
        with pytest.raises(ValueError):
            _by_ranges(whole + b"garbage", split)


def test_names_become_tags(spark):
    from strandlake.sources.sinks import sam_fields

    seg = "named_struct('name', {}, 'comment', {}, 'seq', 'AC', 'qual', 'II')"
    df = spark.sql(f"SELECT 1L AS read_id, true AS passes, true AS assigned, false AS discard, array({seg.format("'r::[a][b c]'", "'XA:Z:1 no XB:i:2'")}, {seg.format("'s'", 'NULL')}) AS out")
    got = sam_fields(df, 2).orderBy("nth").collect()
    assert [(r.name, r.flag, r.tags) for r in got] == [("r", 77, ["YM:Z:a:b c", "XA:Z:1", "XB:i:2"]), ("s", 141, [])]
    assert [r.flag for r in sam_fields(df, 2, [0]).collect()] == [12]


def test_written_lines(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 10 != 3, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("v"))
    bgzf.write_lines(df.repartitionByRange(5, "v"), F.col("v"), str(tmp_path / "t"))
    files = sorted(p for p in (tmp_path / "t").iterdir() if p.suffix == ".gz")
    whole = gzip.decompress(b"".join(p.read_bytes() for p in files)).decode().split("\n")[:-1]
    want = [f"é{i}" for i in range(3000) if i % 10 != 3]
    assert sorted(whole) == sorted(want) and len(files) == 5
    got = bgzf.read_lines(spark, str(tmp_path / "t"), 500).orderBy("file", "offset", "nth").collect()
    assert [r.value for r in got] == whole
    with pytest.raises(Exception, match="not empty"):
        bgzf.write_lines(df, F.col("v"), str(tmp_path / "t"))
    bgzf.write_lines(df.limit(0), F.col("v"), str(tmp_path / "none"))
    assert bgzf.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_variants_in_blocks(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n"
    text = head + "".join(f"c1\t{i + 1}\tv{i}\tA\tC\t.\tPASS\t.\tGT\t0/1\n" for i in range(4000))
    (tmp_path / "v.vcf.gz").write_bytes(b"".join(bgzf.blocks_of([text.encode()])) + bgzf.END)
    rows = tables.read_vcf(spark, str(tmp_path / "v.vcf.gz"), "s", split_bytes=3000)
    assert rows.select("block").distinct().count() > 1
    assert [r.pos for r in rows.orderBy("block", "ordinal").collect()] == list(range(4000))


ROWS = [
    ("r1", 12, "ACGTN", "IIII!", ["XA:Z:a b", "XI:i:-7"]), ("*", 77, "*", "*", []), ("r" * 254, 141, "A", "*", ["XZ:Z:"]), ("é", 4, "=ACMGRSVTWYHKDBN", "*", []), ("x", 12, "AC" * 50_000, "#" * 100_000, ["XI:i:2147483647"]),
]


def test_records_decode_to_what_was_written():
    for row in ROWS:
        data = bam.encode(*row)
        want = list(row)
        if row[2] == "A" and row[3] == "*":  # one base of quality 9
            want[3] = "*"
        assert int.from_bytes(data[:4], "little") == len(data) - 4
        assert list(bam.decode(data[4:])) == want, row[0][:9]
    assert bam.decode(bam.encode(None, 4, None, None, None)[4:]) == ("*", 4, "*", "*", [])
    assert bam.decode(bam.encode("a", 4, "acgtu.", None, ["bad", "XX:f:1", "XI:i:12x", "XJ:i:x", None])[4:]) == ("a", 4, "ACGTNN", "*", ["XI:i:12", "XJ:i:0"])
    with pytest.raises(ValueError, match="255 bytes"):
        bam.encode("r" * 255, 4, "A", "I", [])
    with pytest.raises(ValueError, match="qualities"):
        bam.encode("r", 4, "ACG", "I", [])


def test_known_bytes():
    """A record laid out by hand."""
    want = bytes.fromhex("ffffffff" "ffffffff" "02" "00" "4812" "0000" "0c00" "03000000" "ffffffff" "ffffffff" "00000000") + b"r\0" + bytes.fromhex("1240" "282828") + b"XIi" + bytes.fromhex("05000000")
    assert bam.encode("r", 12, "ACG", "III", ["XI:i:5"]) == len(want).to_bytes(4, "little") + want


def test_folder_is_one_file_in_order(spark, tmp_path):
    rows = [(i, 0, f"r{i}", 12, "ACGT" * (i % 9) or "*", "IIII" * (i % 9) or "*", [f"XN:i:{i}"]) for i in range(2000)]
    df = spark.createDataFrame(rows, "read_id long, nth int, name string, flag int, seq string, qual string, tags array<string>").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bam.write_bam(df, str(tmp_path / "b"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(p for p in (tmp_path / "b").iterdir() if p.suffix == ".bam")
    assert files[0].name == "head.bam" and files[-1].name == "tail.bam" and len(files) > 3
    (tmp_path / "one.bam").write_bytes(b"".join(p.read_bytes() for p in files))
    whole = gzip.decompress((tmp_path / "one.bam").read_bytes())
    assert whole.startswith(bam.header())
    for path in ("b", "one.bam"):
        got = bam.read_bam(spark, str(tmp_path / path)).orderBy("file", "nth").drop("file", "nth").collect()
        assert [tuple(r) for r in got] == [r[2:] for r in rows], path


def test_no_records(spark, tmp_path):
    df = spark.createDataFrame([], "read_id long, nth int, name string, flag int, seq string, qual string, tags array<string>")
    bam.write_bam(df, str(tmp_path / "b"))
    assert bam.read_bam(spark, str(tmp_path / "b")).count() == 0
    (tmp_path / "cut.bam").write_bytes(bgzf.block(bam.header() + bam.encode(*ROWS[0])[:-2]))
    with pytest.raises(Exception, match="ends within a record"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def test_part_is_picklable():
    import pickle

    assert pickle.loads(pickle.dumps(Part(1, "f", 0, 2, True, True))).blocked
