"""Contigs read by ranges that several tasks share, and sequences compared in pieces."""

import gzip
import io
import random

import pytest

from strandlake.operators import lift, pieces, unmask
from strandlake.sources import fasta
from strandlake.sources.fastx import Part

TEXT = b"stray\nACGT\n>one first\nACGT\r\nAC\r\n\n>two\n>three\tx\nGGGG\nTT\nA\n>" + b"l" * 40 + b" y\n" + b"ACGTT" * 20 + b"\n>last"
WANT = [(0, "one", "ACGTAC"), (1, "two", ""), (2, "three", "GGGGTTA"), (3, "l" * 40, "ACGTT" * 20), (4, "last", "")]


def _by_ranges(texts: list[bytes], split: int) -> list[tuple]:
    """What read_pieces gives, of ranges read one by one."""
    ranges = [(t, a, min(a + split, len(t))) for t in texts for a in range(0, len(t), split)]
    parts = [(io.BytesIO(t), Part(k, "", a, b, False)) for k, (t, a, b) in enumerate(ranges)]
    before, out = fasta.carried([fasta.sums(f, p) for f, p in parts]), {}
    for (f, p), (_, number, name, offset, inside, lead) in zip(parts, before, strict=True):
        for _, nth, first, own, at, bases in fasta.rows(f, p):
            if number + nth < 0 or (first and inside):
                continue
            key = (number + nth, own if nth else name)
            out.setdefault(key, []).append((at + (offset + (0 if first else lead) if nth == 0 else 0), bases))
    for key, found in out.items():
        place = 0
        for at, bases in sorted(found):
            assert at == place, (key, found)
            place += len(bases)
    return [(n, name, "".join(b for _, b in sorted(found))) for (n, name), found in sorted(out.items())]


@pytest.mark.parametrize("window", [1, 2, 7, 1 << 20])
@pytest.mark.parametrize("piece", [1, 3, 1 << 16])
def test_every_split(monkeypatch, window, piece):
    monkeypatch.setattr(fasta, "WINDOW", window)
    monkeypatch.setattr(fasta, "PIECE", piece)
    for split in (*range(1, 30), 64, 1000):
        assert _by_ranges([TEXT], split) == WANT, split
        assert _by_ranges([TEXT + b"\n", b"AC\nGT\n>again\nTTT"], split) == [*WANT[:4], (4, "last", "ACGT"), (5, "again", "TTT")], split


def test_random_files():
    rng = random.Random(5)
    for _ in range(40):
        want, text = [], b""
        for n in range(rng.randint(0, 6)):
            seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 5, 60, 61, 500])))
            width = rng.choice([1, 7, 60, 1000])
            text += f">c{n}\n".encode() + b"".join(seq[i : i + width].encode() + b"\n" for i in range(0, len(seq), width))
            want.append((n, f"c{n}", seq))
        for split in (1, 2, 3, 11, 61, 200):
            assert _by_ranges([text], split) == want


def test_read_pieces(spark, tmp_path):
    (tmp_path / "g.fa").write_bytes(TEXT)
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(TEXT))
    (tmp_path / "none.fa").write_bytes(b"")
    for path, split in (("g.fa", 9), ("g.fa", 1 << 20), ("g.fa.gz", 9)):
        got = fasta.read_pieces(spark, str(tmp_path / path), split)
        got = got.groupBy("ordinal", "name").agg(pieces.joined("start", "bases").alias("seq")).orderBy("ordinal").collect()
        assert [tuple(r) for r in got] == WANT
    assert fasta.read_pieces(spark, str(tmp_path / "none.fa")).count() == 0


def test_one_contig_by_several_tasks(spark, tmp_path):
    """A contig of one line is read by many tasks in pieces of bounded size."""
    (tmp_path / "g.fa").write_bytes(b">c\n" + b"ACGTTGCA" * 500_000 + b"\n>d\nAC\n")
    got = fasta.read_pieces(spark, str(tmp_path / "g.fa"), 250_000)
    assert got.rdd.getNumPartitions() == 17
    rows = got.selectExpr("ordinal", "start", "length(bases) AS n", "left(bases, 8) AS b").orderBy("ordinal", "start").collect()
    assert max(r.n for r in rows) <= fasta.PIECE and sum(r.n for r in rows) == 4_000_002
    assert all(r.b == ("ACGTTGCA" * 2)[r.start % 8 :][:8] for r in rows if r.ordinal == 0 and r.n >= 8)


@pytest.mark.parametrize("chunk", [4, 16, 1 << 16])
def test_unmask_by_pieces(spark, monkeypatch, chunk):
    """Pieces of other lengths on either side give what whole sequences give."""
    monkeypatch.setattr(unmask, "CHUNK", chunk)
    rng = random.Random(7)
    first = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 40, 64, 100)]
    second = ["".join(rng.choices([c, "N"], [3, 2])[0] for c in s)[: len(s) - i] for i, s in enumerate(first)]
    second[3] = "N" * 60
    want = set()
    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        run = ""
        for p in range(min(len(a), len(b)) + 1):
            if p < min(len(a), len(b)) and a[p] != b[p]:
                run += a[p]
            elif run:
                want.add((i, p - len(run), run))
                run = ""

    def cut(seqs: list[str], size: int):
        rows = [(i, p, s[p : p + size]) for i, s in enumerate(seqs) for p in range(0, max(len(s), 1), size)]
        return spark.createDataFrame(rows, "ordinal long, start long, bases string")

    whole = [spark.createDataFrame(list(enumerate(s)), "ordinal long, seq string") for s in (first, second)]
    for one, two in ((cut(first, 7), cut(second, 30)), (whole[0], cut(second, 9)), whole):
        got = [tuple(r) for r in unmask.unmasked_runs(one, two).collect()]
        assert len(got) == len(want) and set(got) == want


def test_alleles_are_worked_out_once(spark):
    """Contigs around variants read what their alleles are made of once; stretches may cross a border of the grid."""
    seq = "".join("ACGT"[i * i % 7 % 4] for i in range(lift.CHUNK + 50))
    contigs = spark.createDataFrame([(0, "c", seq)], "ordinal long, name string, seq string")
    places = [0, 1, lift.CHUNK - 3, lift.CHUNK, lift.CHUNK + 9, len(seq) - 1]
    rows = spark.createDataFrame([("c", 0, p, p, seq[p], "N", 0, f"v{p}") for p in places], "chrom string, hap int, pos int, start int, ref string, alt string, gone int, id string")
    out = lift.variant_contigs(rows.repartition(3), contigs, 8)
    assert "RoundRobin" not in out._jdf.queryExecution().executedPlan().toString()
    want = {f"v{p}": seq[max(p - 7, 0) : p] + "N" + seq[p + 1 : p + 8] for p in places}
    assert {r.id: r.seq for r in out.collect()} == want
