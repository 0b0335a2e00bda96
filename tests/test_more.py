"""Nested layers, mappings, streams, unmask, lift, sources and sinks."""

import bisect
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from strandlake.model import READS, expand
from strandlake.operators import assign, lift, ordering, summary, unmask
from strandlake.operators.layer import run_layer
from strandlake.operators.neighbourhood import combined, partials, substituted
from strandlake.operators.ordering import numbered
from strandlake.operators.render import process
from strandlake.operators.scan import candidates, clear_hits
from strandlake.functions.sequence import barcode, barcode_id, reverse_complement
from strandlake.plans import parse
from strandlake.plans.options import build
from strandlake.sources import fastx, sinks, staging, tables
from strandlake.sources.fastx import read_fastx, read_reads
from strandlake.streaming import reads as streaming
from tests.fixtures import BOUND, BOUND_FA, LEFT, RIGHT, TWO, fastq, md5, run

R1 = fastq(("a", "ATCGTTTCGCGCG", "A" * 13))
R1B = ">a\nATCGTTTCGCGCC\n"
R2 = fastq(("a", "C" * 13, "A" * 13))
S1 = fastq(("b", "CGCGAAAAAAAAAAAAA", "K" * 17), ("c", "ATCGTTTCGCGCG", "A" * 13))
S2 = fastq(("b", "ATCGGGAAAAAAAAAAA", "K" * 17), ("c", "ATCGTTTCGCGCG", "A" * 13))
T1 = fastq(*[(n, s, "K" * 24) for n, s in zip("abcd", ["GTGTGTGTCCCCCCCCTTTTTTTT", "GTGTGTGTAAAAAAAATTTTTTTT"] * 2, strict=True)])
T2 = fastq(*[(n, s, "K" * 17) for n, s in zip("abcd", ["AAAAAAAAGGGGGGGGG", "AAAAAAAAGGGGGGGGG", "ACCCCAAAGGGGGGGGG", "ACCCCAAAGGGGGGGGG"], strict=True)])
NEST = "ids\ttags\tsubs\nX\tATCG\tGGGGG\nY\tCGCG\nZ\tTTT\n\n@nest\n\nids\ttags\tsubs\nB\tGTTT\tAAA\nY\tCCCC\nZ\tCGCGCG\n"
NEST2 = "@extract {X}<xxx[5]>\n\n" + NEST
KEEP = "@assign\n\n@keep:\nR,R2\n\nids\ttags\tlocations\nR\tAAAAAA\t1:0:10\nR2\tGGGGGG\t1:10\n\n\n@nest\n\n@x-only\n@no-tags\n"
ENCODE = "tags groups\nATATATA A\nGTGTGTG B\nCCCCCC C\nAAAAAAAA D\nTTTTTTTT E\nGGGGGGG F\n"


def test_nested_two_files(spark, tmp_path):
    streams, _ = run(spark, tmp_path, [[R1], [R1B]], pipe=True, mod_names=True, config=NEST)
    assert md5(streams["pipe"]) == "20484a6b5ba1f3c10931417310925ca9", streams["pipe"]


def test_nested_pairs(spark, tmp_path):
    streams, _ = run(spark, tmp_path, [[R1, R2], [S1, S2]], pipe=True, fasta=True, mod_names=True, config=NEST2)
    assert md5(streams["pipe"]) == "9f1f430f7db125657c52653b298ee138", streams["pipe"]


def test_nested_files(spark, tmp_path):
    streams, _ = run(spark, tmp_path, [[R1, R2], [S1, S2]], mod_names=True, config=NEST2)
    assert [md5(streams[f"out:{j}"]) for j in range(3)] == ["1ce13e2466f476892ef00c0fb5886ed9", "547e739c16eaa5495d1e566146ca2b65", "5da0ce90bdd9f45c71948fae908e12b1"]


def test_nested_three(spark, tmp_path):
    text = NEST2 + "\n@nest\n\n@x-only\n@extract {GGA}<xx>1:-1\n\ntags\tlocations\nGGA\t1\n"
    streams, _ = run(spark, tmp_path, [[R1, R2], [S1, S2]], pipe=True, fasta=True, mod_names=True, empty="NNN", config=text)
    assert md5(streams["pipe"]) == "6dabc80d0b3d813d07ab68fd313d2772", streams["pipe"]


@pytest.mark.parametrize(("no_x_out", "want"), [(True, "b5138c11c6250d138252f81925ad3778"), (False, "00667a64eb00f8b6993e2f2819e138d7")])
def test_nested_three_all(spark, tmp_path, no_x_out, want):
    text = NEST2 + "\n@nest\n\n@extract {GGA}<xx>1:-1\n\ntags\tlocations\nGGA\t1\n"
    streams, _ = run(spark, tmp_path, [[R1, R2], [S1, S2]], pipe=True, fasta=True, mod_names=True, empty="NNN", no_x_out=no_x_out, config=text)
    assert md5(streams["pipe"]) == want, streams["pipe"]


def test_nested_assign(spark, tmp_path):
    streams, layers = run(spark, tmp_path, [[R1, R2], [S1, S2]], assign=True, outb=True, unassigned=True, fasta=True, mod_names=True, com_names=True, config=NEST2)
    want = {
        "unassigned:0": "c1c334bec88086eae1cafe58857e286b", "unassigned:1": "19f5e79683fdb9e96e3cc0981e13c0cb", "unassigned:2": "66d3a7966397c33fa9bc0c3e7f69ebda", "out:0": "0d81ab04a3ffef6cb904311f08f61e32",
        "out:1": "edf67aa6dab16e0953fbd9895285fb8b", "out:2": "732e911683d3e5cd8ff2aad7fd1fafee", "barcodes": "e39b5fc29e0dc621ac15c24262fcf507",
    }
    assert {k: md5(streams[k]) for k in want} == want, streams
    layer, df = layers[-1]
    rows = assign.mapping(assign.first_appearance(df, "key"), "key", layer.bclen).collect()
    assert md5("".join(f"{r.barcode}\t{r.names}\t{r.n}\n" for r in rows)) == "562376738ccdb0645824021a1d91954b"


def test_nested_assign_pipe(spark, tmp_path):
    streams, _ = run(spark, tmp_path, [[R1, R2], [S1, S2]], assign=True, pipe=True, no_outb=True, unassigned=True, fasta=True, mod_names=True, config=NEST2)
    assert md5(streams["pipe"]) == "0634a9a8aeff98e586e0dbb91a0e8f04" and md5(streams["unassigned:1"]) == "19f5e79683fdb9e96e3cc0981e13c0cb"


def test_nested_keep(spark, tmp_path):
    streams, _ = run(spark, tmp_path, [T1, T2], assign=True, mod_names=True, empty="N", outb=True, unassigned=True, config=KEEP)
    assert [md5(streams[k]) for k in ("barcodes", "unassigned:0", "unassigned:1")] == ["b4ef4481277e4aff5adaf3513c988e2b", "f501b402785d361b968b7ef66aa6100e", "0f0a86618bd4b2fcf3996114ab437d42"], streams


def test_encode(spark, tmp_path):
    streams, layers = run(spark, tmp_path, [T1], assign=True, barcode_encode="B,D,E", pipe=True, mod_names=True, unassigned=True, config=ENCODE)
    assert md5(streams["pipe"]) == "4e9181c048e722c8fb69fb8ac58f726e" and md5(streams["unassigned:0"]) == "0eb7dccdeac130ea6c33e5174a7d189a"
    rows = sinks.radix_mapping(spark, layers[0][0]).collect()
    assert md5("".join("\t".join(map(str, r)) + "\n" for r in rows)) == "129a22a29e2ee9ae3b29389a20ed0bff"


def test_encode_long(spark, tmp_path):
    streams, layers = run(spark, tmp_path, [T1], assign=True, barcode_encode="B,D,E", bclen=20, pipe=True, mod_names=True, unassigned=True, config=ENCODE.replace("CCCCCC C", "CCCCCC D"))
    assert md5(streams["pipe"]) == "d3c5c22523d87e22ffdf11bf58adccba" and "unassigned:0" not in streams
    rows = sinks.radix_mapping(spark, layers[0][0]).collect()
    assert md5("".join("\t".join(map(str, r)) + "\n" for r in rows)) == "b95e8b332c8a0a7ffc0f91118e754302"


def test_mapping_file(spark, tmp_path):
    options = dict(groups="t,t,b,b,b", tags="GATACT,TAGAGAA,CCGG,AACC,AAAAACC", distances="1,1,1,1,1", previous=",,{{t}}14-14,{{t}}14-14,{{t}}14-14", left="1:1,1,1,1,1", qtrim=30, qtrim_5=True, filter_len="1,1", limit=3)
    _, layers = run(spark, tmp_path, [LEFT, RIGHT], assign=True, pipe=True, subs="TTTTTTTTTTTTTTT,GGGGGGGGGGGGGGG,GG,GG,GG", **options)
    rows = assign.mapping(assign.first_appearance(layers[0][1], "key"), "key", 16).collect()
    assert md5("".join(f"{r.barcode}\t{r.names}\t{r.n}\n" for r in rows)) == "adee4c7edfa0b9bb26d6ebb4d351582d"
    sinks.write_mapping(assign.mapping(assign.first_appearance(layers[0][1], "key"), "key", 16), str(tmp_path / "map"))
    known = assign.known_mapping(spark, str(tmp_path / "map"), 16)
    more = {tuple(r.key): (r.id, r.n) for r in assign.first_appearance(layers[0][1], "key", known.withColumnRenamed("names", "key")).collect()}
    assert sorted(i for i, _ in more.values()) == list(range(len(more)))


def test_remultiplex(spark, tmp_path):
    numbers = [n for _, n, _ in assign.remultiplexed(spark, ["# c", "AA x y", "CC x y", "AA z z"])]
    assert numbers == [0, 1, 0]
    streams, _ = run(spark, tmp_path, [[TWO], [BOUND]], remultiplex=True, pipe=True, com_names=True)
    assert streams["pipe"].count("BI:i:1\n" + "A" * 15 + "C\n") == 2


def test_unmask(spark):
    rows = [("ATGAGT", "ANNNNT"), ("ACACTT", "NCACTN"), ("", ""), ("AAAA", "AAA")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "ordinal long, a string, b string")
    runs = unmask.unmasked_runs(df.select("ordinal", F.col("a").alias("seq")), df.select("ordinal", F.col("b").alias("seq")))
    assert md5("".join(r.text for r in unmask.unmasked_fasta(runs, "").orderBy("nth").collect())) == "b98fba82fc4a92c49d916ab97a8463bc"


def test_unmask_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(unmask, "CHUNK", 4)
    df = spark.createDataFrame([(0, "AAAACCCCGG", "AANNNNNNGN")], "ordinal long, a string, b string")
    got = unmask.unmasked_runs(df.select("ordinal", F.col("a").alias("seq")), df.select("ordinal", F.col("b").alias("seq"))).collect()
    assert sorted((r.start, r.bases) for r in got) == [(2, "AACCCC"), (9, "G")]


def test_neighbourhoods():
    near = substituted("ACGT", 2)
    assert len(near) == 4 * 4 + 6 * 16 and near["NCGT"] == 1 and near["NNGT"] == 2
    both = combined("AC", 1, 1, 2)
    assert "AC" not in both and not any("AC" in s for s in both) and both["A"] == 1 and both["AA"] == 1 and both["GAG"] == 2
    assert partials("CCAAA", 3, 0.35, True)["AAA"] == 0 and partials("CCAAA", 3, 0.35, True)["GAA"] == 3
    assert partials("CCAAA", 3, 0.0, False) == {"CCAAA": 0, "CCAA": 0, "CCA": 0}


@pytest.mark.parametrize("seed", range(4))
def test_relational_scan_agrees(spark, seed):
    """Places that the candidate join finds clear are those that the scan sees, as long as hits don't overlap."""
    rng = random.Random(seed)
    layer, _ = build(tags="ACGT,AGGA,TTC", distances="1,0,0", ids="a,b,b", locations="0:0:12,0,0:2:0")
    seqs = ["".join(rng.choice("ACGTN") for _ in range(14)) for _ in range(40)]
    df = spark.createDataFrame([(i, [s]) for i, s in enumerate(seqs)], "read_id long, seqs array<string>")
    clear = {(r.read_id, r.pos): (r.pos + r.k, r.name, r.err) for r in clear_hits(candidates(df, layer)).collect()}
    from tests.scanner import Scanner

    scanner = Scanner(layer)
    for i, s in enumerate(seqs):
        at, want = 0, []
        while at < len(s):
            if hit := clear.get((i, at)):
                want.append((at, *hit))
                at = hit[0]
            else:
                at += 1
        assert [(a, z, p.tag.name, e) for p, a, z, e in scanner.scan([s])[0]] == want


def test_splits_of_fastq(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        n = rng.randint(1, 40)
        rows.append((f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+K>") for _ in range(n))))
    (tmp_path / "a.fq").write_text(fastq(*rows))
    (tmp_path / "b.fa").write_text("".join(f">{n} x y\n{s[:7]}\n{s[7:]}\n" for n, s, _ in rows))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(fastq(*rows))
    for split in (97, 1000, 1 << 20):
        got = read_fastx(spark, str(tmp_path / "a.fq"), split).orderBy("ordinal").collect()
        assert [(r.ordinal, r.seg.name, r.seg.seq, r.seg.qual) for r in got] == [(i, *r) for i, r in enumerate(rows)]
        got = read_fastx(spark, str(tmp_path / "b.fa"), split).orderBy("ordinal").collect()
        assert [(r.seg.name, r.seg.comment, r.seg.seq, set(r.seg.qual)) for r in got] == [(n, "x y", s, {"K"}) for n, s, _ in rows]
    got = read_fastx(spark, str(tmp_path / "c.fq.gz")).orderBy("ordinal").collect()
    assert [(r.seg.name, r.seg.seq) for r in got] == [r[:2] for r in rows]


@pytest.mark.parametrize("window", [1, 7, 64])
def test_borders_find_records_beyond_the_window(monkeypatch, window):
    """Records much longer than the window; qualities that begin with @; ends of lines of either kind; no last line end."""
    monkeypatch.setattr(fastx, "WINDOW", window)
    rng = random.Random(window)
    sizes = [rng.choice((3, 20, 300, 900)) for _ in range(9)] + [4] * 20
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in sizes]
    quals = ["@" + "".join(rng.choice("@+>K") for _ in s[1:]) for s in bases]
    texts = {
        "fasta of one line": "".join(f">r{i}\n{s}\n" for i, s in enumerate(bases)),
        "fasta of lines": "".join(f">r{i}\n" + "".join(f"{s[j : j + 60]}\n" for j in range(0, len(s), 60)) for i, s in enumerate(bases)),
        "fastq": "".join(f"@r{i}\n{s}\n+\n{q}\n" for i, (s, q) in enumerate(zip(bases, quals, strict=True))),
    }
    for what, text in texts.items():
        for data in (text, text[:-1], text.replace("\n", "\r\n")):
            raw = data.encode()
            for split in (13, 250, 1000):
                parts = [fastx.Part(k, "", a, min(a + split, len(raw)), what == "fastq") for k, a in enumerate(range(0, len(raw), split))]
                got = [r for p in parts for r in fastx._Reader._range(io.BytesIO(raw), p, len(raw))]
                assert [(r[0], r[2]) for r in got] == [(f"r{i}", s) for i, s in enumerate(bases)], (what, split)


def test_contigs_longer_than_a_split(spark, tmp_path):
    rows = [(f"c{i}", "ACGT" * n) for i, n in enumerate([700_000, 5, 400_000, *range(1, 40)])]
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s}\n" for n, s in rows))
    got = read_fastx(spark, str(tmp_path / "g.fa"), 300_000).select("ordinal", "seg.name", F.length("seg.seq").alias("n")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(i, n, len(s)) for i, (n, s) in enumerate(rows)]


def test_reads(spark, tmp_path):
    (tmp_path / "a.fq").write_text(TWO)
    (tmp_path / "b.fq").write_text(TWO + BOUND)
    a, b = str(tmp_path / "a.fq"), str(tmp_path / "b.fq")
    got = read_reads(spark, [[a, b], [b, b]]).orderBy("read_id").collect()
    assert [(r.read_id, r.run_id, len(r.segs)) for r in got] == [(i, 0 if i < 2 else 1, 2) for i in range(6)]
    got = read_reads(spark, [[b]], interleaved=2).orderBy("read_id").collect()
    assert [[s.name for s in r.segs] for r in got] == [["read0", "read1"], ["read1", "read2"]]


def test_stream(spark, tmp_path):
    layer, _ = build(tags="AT,TT", distances="1", groups="g,g", barcode_encode="g,g", assign=True)
    (tmp_path / "a.fq").write_text(BOUND)
    reads = read_reads(spark, [[str(tmp_path / "a.fq")]])
    reads.select("read_id", "run_id", "segs").write.parquet(str(tmp_path / "in"))
    processed = streaming.stream_layer(streaming.stream_reads(spark, str(tmp_path / "in")), layer)
    query = streaming.tag_counts(processed).writeStream.outputMode("complete").format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = run_layer(reads, layer).select(F.explode("hits").alias("h")).groupBy("h.name").count()
    assert {(r.tag, r.n) for r in spark.table("tags").groupBy("tag").agg(F.sum("n").alias("n")).collect()} == {(r.name, r["count"]) for r in want.collect()}
    assert READS.names == ["read_id", "run_id", "segs"]


def test_summary(spark, tmp_path):
    import json

    options = dict(qtrim=10, qtrim_3=True, extract="0:2<umi1>0:-1", trim_5="1", trim_3="2", tags="GCTT", distances="1", left="1")
    _, layers = run(spark, tmp_path, [TWO], pipe=True, **options)
    layer, df = layers[0]
    got = json.loads(summary.as_json(df, layer).first().summary)
    assert got["n_processed"] == 2 and got["n_assigned"] == 2 and got["lengths"][0]["mean_before"] == 10
    assert got["tag_qc"] == [{"tag": "GCTT", "distance": d, "n": 2 if d == 0 else 0} for d in range(4)]
    assert got["tag_trims"][0]["reads"] == 2 and got["extractions"][0]["name"] == "umi1"
    t = got["trims"][0]
    assert t["bases_5"] == 2 * 6 and t["bases_5"] + t["bases_3"] == 20 - sum(len(r.out[0].seq) for r in df.collect())


def test_sinks(spark, tmp_path):
    streams, layers = run(spark, tmp_path, [LEFT, RIGHT], pipe=True, tags="GATACT")
    from strandlake.operators.render import Output, records

    layer, df = layers[0]
    recs = records(df, layer, Output())
    sinks.write_streams(recs, str(tmp_path / "s"))
    assert {r.stream for r in spark.read.text(str(tmp_path / "s")).select("stream").distinct().collect()} == {"out:0", "out:1"}
    sinks.write_ordered(recs, "out:0", str(tmp_path / "o"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) + "\n" == LEFT
    lines = sinks.sam_lines(df, 2).orderBy("read_id", "nth").collect()
    assert lines[0].line.split("\t")[:4] == ["read1", "77", "*", "0"] and lines[1].line.split("\t")[1] == "141"


def test_barcodes(spark):
    got = spark.range(0, 70, 7).select("id", barcode(F.col("id"), 6, "TT").alias("b")).withColumn("back", barcode_id(F.substring("b", 3, 6))).collect()
    assert all(r.b.startswith("TT") and len(r.b) == 8 and r.back == r.id for r in got)
    assert spark.range(1).select(reverse_complement(F.lit("ACGTN")).alias("x")).first().x == "NACGT"


def test_limit_takes_the_first_reads_whatever_their_ids(spark):
    seg = F.struct(F.lit("r").alias("name"), F.lit("").alias("comment"), F.lit("ACGT").alias("seq"), F.lit("KKKK").alias("qual"))
    df = spark.range(40).select((F.col("id") * 7 + 1000).alias("read_id"), F.lit(0).alias("run_id"), F.array(seg).alias("segs")).orderBy(F.desc("read_id"))
    layer, out = build(tags="GGGG", pipe=True, limit=5)
    _, layers = process(df, layer, out)
    assert sorted(r.read_id for r in layers[0][1].collect()) == [1000 + 7 * i for i in range(5)]


def test_numbered(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v long").repartition(7)
    assert [(r.v, r.n) for r in numbered(df, ["v"], "n").orderBy("v").collect()] == [(i, i) for i in range(101)]


def test_numbered_when_partitions_differ_by_columns(spark):
    """Partitions are coalesced by bytes, so those of the rows are not those of a count, which has fewer columns."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.range(30_000).select(F.pmod(F.col("id") * 7919, F.lit(30_000)).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("more"))
        got = [(r.v, r.n) for r in numbered(df, ["v"], "n", 5).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted(got) == [(i, i + 5) for i in range(30_000)]


def test_ids_go_on_from_a_single_known_one(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c"), (3, "a")], "read_id long, k string")
    known = spark.createDataFrame([("a", 0)], "k string, id long")
    assert {tuple(r) for r in assign.first_appearance(df, "k", known).collect()} == {("a", 0, 2), ("b", 1, 1), ("c", 2, 1)}
    assert {tuple(r) for r in assign.first_appearance(df, "k", known.limit(0)).collect()} == {("b", 0, 1), ("a", 1, 2), ("c", 2, 1)}


def test_notations():
    assert parse.distance("2:1:2") == (2, 1, 2) and parse.distance("1") == (1, 0, 1) and parse.location("0:3") == (0, 3, 0) and parse.location("-") == (-1, 0, 0)
    n = parse.neighbour("{{g}}4-10")
    assert (n.name, n.is_group, n.lo, n.hi) == ("g", True, 4, 10) and parse.neighbour("{a}").hi is None
    e = parse.extract("{a}3<~^AC^u[2-5]>4{{g}}")[0]
    assert (e.name, e.lo, e.hi, e.turn, e.prepend, e.pad_left, e.pad_right, e.right.is_group) == ("u", 2, 5, "revcomp", "AC", 3, 4, True)
    with pytest.raises(ValueError):
        parse.distance("1:1:5")
    layer, _ = build(tags="*ACG,T:2-3,AC/GT*")
    assert [p.seq for p in expand(layer).patterns] == ["ACG", "TT", "TTT", "AC", "GT"]


# lift: a small genome with substitutions, an insertion and a deletion

FASTA = ">c1 first\nACGTACGTAC\nGTACGTACGT\n>c2\nTTTTGGGG\n"
VCF = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\n" + "".join(
    f"c1\t{p}\t{i}\t{r}\t{a}\t.\t{f}\t.\tGT\t0/0\t{g}\n"
    for p, i, r, a, f, g in [(2, "v1", "C", "T", "PASS", "1/1"), (4, "v2", "T", "TGG", "PASS", "1|1"), (6, "v3", "CGT", "C", "PASS", "1/1"), (7, "v4", "G", "A", "PASS", "1/1"), (12, "v5", "T", "A", "q", "1/1"), (14, "v6", "C", "G,T", "PASS", "0|2"), (16, "v7", "T", "C", "PASS", "./.")]
)


def _lifted(spark, tmp_path, **options):
    (tmp_path / "g.fa").write_text(FASTA)
    (tmp_path / "v.vcf").write_text(VCF)
    contigs = tables.read_contigs(spark, str(tmp_path / "g.fa"))
    variants = tables.read_vcf(spark, str(tmp_path / "v.vcf"), "s1")
    diploid = options.get("diploid", False)
    return contigs, lift.applied(lift.alleles(variants, diploid, options.get("passed", False)), options.get("snv_only", False))


def test_lift_genome(spark, tmp_path):
    contigs, rows = _lifted(spark, tmp_path)
    assert [(r.start, r.ref, r.alt, r.gone) for r in rows.orderBy("start").collect()] == [(1, "C", "T", 0), (4, "", "GG", 0), (6, "GT", "", 2), (11, "T", "A", 0)]
    got = {r.chrom: r for r in lift.genome(contigs, rows).collect()}
    assert got["c1"].seq == "AT" + "GT" + "GG" + "AC" + "ACG" + "A" + "ACGTACGT" and got["c1"].varied and not got["c2"].varied
    assert got["c1"].header == ">c1 c1:1-20 from|c1:1-20" and got["c2"].seq == "TTTTGGGG"
    assert spark.range(1).select(lift.wrapped(F.lit("A" * 130)).alias("w")).first().w == "\n".join(["A" * 60, "A" * 60, "A" * 10])
    moved = {(r.orig_pos, r.shift) for r in lift.shifts(rows).collect()}
    assert moved == {(2, 0), (4, 2), (8, 0), (12, 0)}


def test_lift_diploid(spark, tmp_path):
    contigs, rows = _lifted(spark, tmp_path, diploid=True, passed=True)
    got = {(r.chrom, r.hap): r.seq for r in lift.genome(contigs, rows, diploid=True).collect()}
    assert got["c1", 0] == "ATGTGGACACGTACGTACGT" and got["c1", 1] == "ATGTGGACACGTATGTACGT" and got["c2", 1] == "TTTTGGGG"
    _, snv = _lifted(spark, tmp_path, snv_only=True)
    assert [(r.start, r.alt) for r in snv.orderBy("start").collect()] == [(1, "T"), (11, "A")]


def test_lift_features(spark, tmp_path):
    _, rows = _lifted(spark, tmp_path)
    (tmp_path / "a.gtf").write_text("# c\nc1\tx\tgene\t1\t5\t.\t+\t.\tid 1\nc1 x exon 9 20 rest of it\nc2\tx\tgene\t2\t3\t.\nshort line\n")
    gtf = tables.read_gtf(spark, str(tmp_path / "a.gtf"))
    got = [(r.seqname, r.start, r.end, r.rest) for r in lift.lifted(gtf, lift.shifts(rows), sample="s1").orderBy("seqname", "start").collect()]
    assert got == [("s1_c1", 1, 7, ".\t+\t.\tid 1"), ("s1_c1", 9, 20, "rest of it"), ("s1_c2", 2, 3, ".")]
    assert {r.seqname for r in lift.lifted(gtf, lift.shifts(rows), diploid=True).collect()} == {"c1_L", "c1_R", "c2_L", "c2_R"}


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_contigs(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(unmask, "CHUNK", chunk)
    monkeypatch.setattr(lift, "CHUNK", chunk)
    contigs, rows = _lifted(spark, tmp_path)
    got = {r.id: (r.start, r.end, r.seq) for r in lift.variant_contigs(rows, contigs, 4).collect()}
    assert got["v1"] == (1, 5, "ATGTA") and got["v2"] == (2, 7, "CGTGGACG") and got["v3"] == (4, 11, "TACACG") and got["v5"] == (9, 15, "ACGAACG")
    (tmp_path / "sj").write_text("c1 3 6 +\nc2\t1\t8\nc2 5 9\nc9 1 2\nc1 12 11\n")
    got = sorted((r.chrom, r.start, r.end, r.seq) for r in lift.junction_contigs(tables.read_junctions(spark, str(tmp_path / "sj")), contigs, 4).collect())
    assert got == [("c1", 3, 6, "AC" + "GTA"), ("c2", 1, 8, "")]
    assert lift.unsorted(spark.createDataFrame([(0, "c", 5), (1, "c", 3)], "ordinal long, chrom string, pos int")).count() == 1


def test_order_of_a_folder_of_variants(spark, tmp_path):
    """Part files of unequal sizes, which Spark packs by size, are in the order of their names."""
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\n"
    lines = [f"c{1 + i // 2000}\t{i + 1}\tv\tA\tC\t.\tPASS\t.\tGT\t1/1\n" for i in range(3470)]
    at = 0
    (tmp_path / "v").mkdir()
    for k, n in enumerate((50, 400, 20, 3000)):
        (tmp_path / "v" / f"part-0000{k}.txt").write_text((head if not k else "") + "".join(lines[at : at + n]))
        at += n
    rows = tables.read_vcf(spark, str(tmp_path / "v"), "s0")
    assert rows.count() == 3470 and lift.unsorted(rows).count() == 0
    (tmp_path / "v" / "part-00009.txt").write_text(lines[5])
    assert [tuple(r) for r in lift.unsorted(tables.read_vcf(spark, str(tmp_path / "v"), "s0")).collect()] == [("c1", 5, "chromosome")]


def test_long_contigs_by_pieces(spark, monkeypatch):
    """A contig in pieces of odd lengths gives the same as in one row, lines over the borders of pieces, chunks and blocks included."""
    monkeypatch.setattr(unmask, "CHUNK", 64)
    monkeypatch.setattr(lift, "CHUNK", 37)
    monkeypatch.setattr(lift, "BLOCK", 120)
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(1000))
    whole = spark.createDataFrame([(0, "c", seq), (1, "d", "ACG"), (2, "e", "")], "ordinal long, name string, seq string")
    cuts, parts = [0, 1, 200, 263, 640, 999, 1000], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        parts.append((0, "c", a, seq[a:b]))
    pieces_ = spark.createDataFrame([*parts, (1, "d", 0, "ACG"), (2, "e", 0, "")], "ordinal long, name string, start long, bases string")
    variants = [("c", 5 + 13 * i, "v", seq[5 + 13 * i : 8 + 13 * i] if i % 3 == 2 else seq[5 + 13 * i], [seq[5 + 13 * i] + ("GGT" if i % 3 == 1 else "")] if i % 3 else ["N"], "PASS", "1/1") for i in range(70)]
    rows = lift.applied(lift.alleles(spark.createDataFrame(variants, "chrom string, pos int, id string, ref string, alts array<string>, filter string, gt string")))
    want, at = "", 0
    for r in rows.orderBy("start").collect():
        want += seq[at : r.start] + r.alt
        at = r.start + len(r.ref)
    want += seq[at:]
    for contigs in (whole, pieces_):
        assert {r.chrom: r.seq for r in lift.genome(contigs, rows).collect()} == {"c": want, "d": "ACG", "e": ""}
        text = "".join(r.text for r in lift.genome_fasta(contigs, rows).orderBy("nth").collect())
        lines = "\n".join(want[i : i + 60] for i in range(0, len(want), 60))
        assert text == f">c c:1-{len(want)} from|c:1-1000\n{lines}\n>d d:1-3 from|d:1-3\nACG\n>e e:1-0 from|e:1-0\n\n"
        assert max(len(r.text) for r in lift.genome_fasta(contigs, rows).collect()) < 200
    one, two = ({(r.id, r.start, r.seq) for r in lift.variant_contigs(rows, c, 9).collect()} for c in (whole, pieces_))
    assert one == two and len(one) > 40


_VARIANT = "chrom string, pos int, id string, ref string, alts array<string>, filter string, gt string"


def test_alleles_reach_over_bins(spark, monkeypatch):
    """Bins of which alleles reach into others, and those that stand alone, give what one loop over all alleles gives."""
    rng = random.Random(5)
    variants = []
    for c, most in (("c", 3), ("d", 40), ("e", 9)):
        for i in range(150):
            ref = "".join(rng.choice("ACGT") for _ in range(rng.choice((1, 1, 1, rng.randint(2, most)))))
            variants.append((c, rng.randrange(0, 1200), f"v{i}", ref, [rng.choice(("A", "C", ref[0], ref[0] + "GG"))], "PASS", "1/1"))
    alleles = lift.alleles(spark.createDataFrame(variants, _VARIANT)).localCheckpoint()
    for size, snv_only in ((16, False), (256, False), (16, True)):
        monkeypatch.setattr(lift, "BIN", size)
        want = []
        for c in "cde":
            lo = hi = -1
            last = 0
            for r in sorted((r for r in alleles.collect() if r.chrom == c), key=lambda r: (r.pos, r.start, r.ref, r.alt, r.deletes, r.indel, r.id)):
                if lo <= r.pos <= hi:
                    continue
                if r.start >= last and not (r.indel and snv_only):
                    want.append((c, r.pos, r.start, r.ref, r.alt, r.id))
                    last = r.start + len(r.ref)
                if r.deletes:
                    lo, hi = r.start, r.start + len(r.ref) - 1
        got = [(r.chrom, r.pos, r.start, r.ref, r.alt, r.id) for r in lift.applied(alleles, snv_only).collect()]
        assert sorted(got) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("diploid", [False, True])
def test_genome_goes_over_alleles_once(spark, monkeypatch, diploid):
    """New sequences take one run over the alleles, a deletion over several chunks and two insertions at a place included."""
    monkeypatch.setattr(lift, "CHUNK", 16)
    seq = "".join(random.Random(3).choice("ACGT") for _ in range(200))
    contigs = spark.createDataFrame([(0, "c", seq), (1, "d", "")], "ordinal long, name string, seq string")
    variants = [("c", 3, "a", seq[3], ["N"]), ("c", 20, "b", seq[20:90], [seq[20]]), ("c", 95, "i", seq[95], [seq[95] + "TT"]), ("c", 95, "j", seq[95], [seq[95] + "GG"]), ("x", 3, "k", "A", ["C"])]
    rows = lift.applied(lift.alleles(spark.createDataFrame([(*v, "PASS", "1/1") for v in variants], _VARIANT), diploid), False)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = lift.genome(contigs, rows.mapInArrow(counted, rows.schema), diploid).collect()
    assert seen.value == 5 * (2 if diploid else 1)
    want = seq[:3] + "N" + seq[4:21] + seq[90:96] + "GG" + "TT" + seq[96:]
    assert {(r.chrom, r.hap, r.varied, r.seq) for r in got} == {x for hap in ((0, 1) if diploid else (0,)) for x in (("c", hap, True, want), ("d", hap, False, ""))}


def test_fasta_of_contigs(spark, tmp_path):
    contigs, rows = _lifted(spark, tmp_path)
    got = [r.text for r in lift.contig_fasta(lift.variant_contigs(rows, contigs, 4)).orderBy("nth").collect()]
    assert got[0] == ">v1 c1:1-5\nATGTA\n" and len(got) == 4
    got = [r.text for r in lift.contig_fasta(lift.variant_contigs(rows, contigs, 4), diploid=True, header="k", number=True).orderBy("nth").collect()]
    assert got[0] == ">k0_L c1:1-5\nATGTA\n"
    whole = [r.text for r in lift.genome_fasta(contigs, rows).orderBy("nth").collect()]
    assert whole[0].startswith(">c1 c1:1-20 from|c1:1-20\n") and whole[1] == ">c2 c2:1-8 from|c2:1-8\nTTTTGGGG\n"


def test_file_names(spark):
    streams = ["out:1", "unassigned:0", "barcodes", "umi:u", "p:barcodes", "p:1", "a,b:1"]
    df = spark.createDataFrame([(s,) for s in streams], "stream string")
    names = {r.stream: r.f for r in df.select("stream", sinks.file_of(F.col("stream"), 2).alias("f")).collect()}
    assert [names[s] for s in streams] == ["out_1.fastq", "unassigned_0.fastq", "barcodes.fastq", "u.fastq", "p_barcodes.fastq", "p_1.fastq", "b.fastq"]
    assert df.where("stream = 'p:1'").select(sinks.file_of(F.col("stream"), 2, fasta=True, r1_r2=True)).first()[0] == "p_R2.fasta"


def test_sub_encode(spark, tmp_path):
    text = "@assign\n@barcode-encode x,y\n@sub-barcode-encode y\n\ntags groups locations\nA x 0:0:1\nC x 0:0:1\nG y 0:1:2\nT y 0:1:2\n"
    reads = fastq(("a", "AGAA", "KKKK"), ("b", "CTAA", "KKKK"), ("c", "GGAA", "KKKK"))
    streams, layers = run(spark, tmp_path, [reads], pipe=True, config=text)
    rows = {r.segs[0].name: (r.id, r.sub_id, r.assigned) for r in layers[0][1].collect()}
    assert rows["a"][2] and rows["b"][2] and not rows["c"][2]
    assert rows["b"][1] != rows["a"][1] and "c" not in {x.split("\n")[0] for x in streams["pipe"].split("@")}
    assert f"@b\n{'A' * 15}C{'A' * 14}CA\n" in streams["pipe"] and f"@a\n{'A' * 32}\n" in streams["pipe"]


def test_running_values_by_range(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice("ab"), rng.randrange(400)) for _ in range(300)})
    rows = [(k, at, rng.choice([None, rng.randrange(50)])) for k, at in rows]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(3)
    kinds = {n: (n, F.col("v")) for n in ("sum", "max", "before", "last", "prior")}
    got = {(r.k, r.at): r for r in ordering.running(df, ["k"], F.floor(F.col("at") / 37), ["at"], kinds).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        seen = []
        for k, at, v in rows:
            if k == key:
                r, known = got[k, at], [x for x in seen if x is not None]
                with_it = known + ([v] if v is not None else [])
                assert (r.sum, r.max, r.before) == (sum(with_it), max(with_it, default=None), max(known, default=None))
                assert (r["last"], r.prior) == (with_it[-1] if with_it else None, seen[-1] if seen else None)
                seen.append(v)


def test_lift_of_shuffled_features(spark):
    rng = random.Random(5)
    alleles = spark.createDataFrame([("c", 0, p, p, "A", rng.choice(["", "AGG"]), False, False, None) for p in range(10, 300_000, 500)], "chrom string, hap int, pos int, start int, ref string, alt string, deletes boolean, indel boolean, id string")
    moved = lift.shifts(alleles)
    table = sorted((r.orig_pos, r.shift) for r in moved.collect())
    places = [p for p, _ in table]
    features = [("c", "s", "f", p, p + 700, str(p)) for p in range(1, 300_000, 97)]
    df = spark.createDataFrame(features, "seqname string, source string, feature string, start int, end int, rest string")
    by = lambda p: table[bisect.bisect_right(places, p) - 1][1] if bisect.bisect_right(places, p) else 0
    want = sorted((p + by(p), e + by(e), r) for _, _, _, p, e, r in features)
    for rows in (df, df.repartition(5)):
        assert sorted((r.start, r.end, r.rest) for r in lift.lifted(rows, moved, sample="s").collect()) == want


def test_variants_out_of_order(spark, tmp_path):
    kind = "block long, ordinal long, chrom string, pos int"
    rows = [(0, 0, "a", 5), (0, 1, "a", 9), (0, 2, "b", 3), (64, 3, "b", 2), (64, 4, "a", 10), (128, 5, "a", 11)]
    df = spark.createDataFrame(rows, kind).repartition(3)
    assert sorted(map(tuple, lift.unsorted(df).collect())) == [("a", 10, "chromosome"), ("b", 2, "position")]
    with pytest.raises(ValueError, match="not sorted"):
        lift.in_order(df)
    good = spark.createDataFrame(rows[:3], kind)
    assert lift.in_order(good) is good
    (tmp_path / "v.vcf").write_text(VCF)
    assert lift.unsorted(tables.read_vcf(spark, str(tmp_path / "v.vcf"), "s1")).count() == 0


def test_numbers_of_many_keys(spark):
    """400,000 keys over several partitions, in memory and after a write, with adaptive execution."""
    df = spark.range(0, 400_000, 1, 6).select((F.col("id") * 7919 % 400_009).alias("read_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    ids = assign.first_appearance(df, "key")
    for rows in (ids, staging.staged(ids, "ids")):
        assert rows.agg(F.count(F.lit(1)), F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (400_000, 400_000, 0, 399_999)


def test_shared_folder_and_cleanup(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Cluster)
