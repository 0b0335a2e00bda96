"""Queries that write reads, outputs and tables as files of the shared folder and read them back, and the same in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import assign, lift, ordering, pieces, unmask
from strandlake.operators.layer import run_layer
from strandlake.operators.render import process, records
from strandlake.plans.options import build
from strandlake.plans.queries import _C, _K, _PAIR, _R, HEX, QUALITIES, _base4, _contigs, _greedy, _occurrences, query, reads
from strandlake.sources import bam, bgzf, sinks, tables
from strandlake.sources.fasta import read_pieces
from strandlake.sources.fastx import read_batch, read_fastx, read_reads
from strandlake.sources.staging import new_folder

#: fixed values: hexadecimal digits to letters of reads, lower case and N among them
ODD = "ACGTacgtNCGTACGT"
_O = f"""o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS nth, 'r' || doc_id AS name, substr(translate(md5(coalesce(text, '')), '{HEX}', '{ODD}'), 1, (20 + doc_id % 13)::INT) AS seq,
  substr(translate(md5(coalesce(text, '') || 'q'), '{HEX}', '{QUALITIES}'), 1, (20 + doc_id % 13)::INT) AS qual, 'x:' || (doc_id % 7) || ' y' AS comment FROM documents)"""


def odd_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of unequal lengths, with lower case and N."""
    text, n = F.coalesce(F.col("text"), F.lit("")), (20 + F.col("doc_id") % 13).cast("int")

    def made(suffix: str, letters: str) -> Column:
        return F.substring(F.translate(F.md5(F.concat(text, F.lit(suffix))), HEX, letters), F.lit(1), n)

    comment = F.concat(F.lit("x:"), (F.col("doc_id") % 7).cast("string"), F.lit(" y"))
    seg = F.struct(F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), comment.alias("comment"), made("", ODD).alias("seq"), made("q", QUALITIES).alias("qual"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.lit(0).alias("run_id"), F.array(seg).alias("segs"))


def _file(df: DataFrame, fasta: bool = False, compression: str | None = None) -> str:
    """The reads written in order of read_id, as one output of a layer without tags."""
    layer, o = build(fasta=fasta, keep_comments=True)
    folder = new_folder(df.sparkSession, "reads")
    sinks.write_files(records(run_layer(df, layer), layer, o), f"{folder}/out", 1, compression, fasta)
    return f"{folder}/out/file=out_0.{'fasta' if fasta else 'fastq'}"


def _read(spark: SparkSession, runs: list[list[str]], **options) -> DataFrame:
    return read_reads(spark, runs, **options).select("read_id", "run_id", F.element_at("segs", 1).alias("s")).select("read_id", "run_id", "s.*")


@query(f"WITH {_O} SELECT nth AS read_id, name, comment, seq, qual FROM o")
def scan_reads(spark, sf_dir):
    return _read(spark, [[_file(odd_reads(spark, sf_dir))]]).drop("run_id")


@query(f"WITH {_O} SELECT nth AS read_id, name, comment, seq, qual FROM o")
def gzip_reads(spark, sf_dir):
    return _read(spark, [[_file(odd_reads(spark, sf_dir), compression="gzip")]]).drop("run_id")


@query(f"WITH {_O} SELECT nth AS read_id, name, comment, seq, qual FROM o")
def blocked_reads(spark, sf_dir):
    """The same from blocked gzip, whose files are split."""
    layer, o = build(keep_comments=True)
    path = f"{new_folder(spark, 'blocked')}/reads"
    sinks.write_blocked(records(run_layer(odd_reads(spark, sf_dir), layer), layer, o), "out:0", path)
    rows = read_fastx(spark, path, split_bytes=1 << 20)
    return rows.select(F.col("ordinal").alias("read_id"), "seg.*")


@query(f"WITH {_O} SELECT nth AS read_id, name, comment, seq, repeat('K', len(seq)) AS qual FROM o")
def fasta_reads(spark, sf_dir):
    return _read(spark, [[_file(odd_reads(spark, sf_dir), fasta=True)]]).drop("run_id")


@query(f"WITH {_O}, b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS nth, seq FROM o WHERE doc_id % 3 <> 0) SELECT nth AS read_id, o.seq AS seq1, b.seq AS seq2 FROM o JOIN b USING (nth)")
def pair_zip(spark, sf_dir):
    """Files in lock step, up to the end of the shorter one."""
    df = odd_reads(spark, sf_dir)
    pairs = read_reads(spark, [[_file(df), _file(df.where("read_id % 3 <> 0"))]])
    return pairs.select("read_id", F.element_at("segs", 1).seq.alias("seq1"), F.element_at("segs", 2).seq.alias("seq2"))


@query(f"WITH {_O} SELECT nth AS read_id, 0 AS run_id, name FROM o UNION ALL SELECT (SELECT count(*) FROM o) + row_number() OVER (ORDER BY doc_id) - 1, 1, name FROM o WHERE doc_id % 2 = 0")
def run_append(spark, sf_dir):
    df = odd_reads(spark, sf_dir)
    return _read(spark, [[_file(df)], [_file(df.where("read_id % 2 = 0"))]]).select("read_id", "run_id", "name")


@query(f"WITH {_O} SELECT nth // 2 AS read_id, string_agg(seq, '|' ORDER BY nth) AS seqs FROM o GROUP BY 1 HAVING count(*) = 2")
def interleave(spark, sf_dir):
    rows = read_reads(spark, [[_file(odd_reads(spark, sf_dir))]], interleaved=2)
    return rows.select("read_id", F.array_join(F.transform("segs", lambda s: s.seq), "|").alias("seqs"))


@query(f"WITH {_R} SELECT read_id, '@r' || read_id || chr(10) || seq || chr(10) || '+' || chr(10) || qual || chr(10) AS text FROM r ORDER BY read_id LIMIT 100")
def read_limit(spark, sf_dir):
    """The first hundred reads: the limit is the operator."""
    layer, o = build(pipe=True, limit=100)
    return process(reads(spark, sf_dir), layer, o)[0].select("read_id", "text")


@query(f"""WITH {_O}, a AS (SELECT 0 AS run, 0 AS id, * FROM o WHERE doc_id % 3 = 0 UNION ALL SELECT 1, 1, * FROM o WHERE doc_id % 3 = 1 UNION ALL SELECT 2, 0, * FROM o WHERE doc_id % 3 = 2),
n AS (SELECT *, row_number() OVER (ORDER BY run, doc_id) - 1 AS nth2 FROM a) SELECT nth2 AS read_id, '@' || name || chr(10) || {_base4('id')} || chr(10) || '+' || chr(10) || repeat('K', 16) || chr(10) AS text FROM n""")
def remultiplex(spark, sf_dir):
    """Files of a batch table: a barcode for each name, whichever lines it is on."""
    df = odd_reads(spark, sf_dir)
    files = [_file(df.where(F.col("read_id") % 3 == k)) for k in range(3)]
    rows = read_batch(spark, [f"one {files[0]}", "# none", f"two {files[1]}", f"one {files[2]}"])
    layer, o = build(remultiplex=True, outb=True)
    return process(rows, layer, o)[0].where("stream = 'barcodes'").select("read_id", "text")


@query(_greedy(["ACG", "GTT"]) + " SELECT read_id, string_agg(CASE name WHEN 'ACG' THEN 't-0' ELSE 't-1' END, ',' ORDER BY nth) AS names FROM h GROUP BY read_id")
def tags_of_a_file(spark, sf_dir):
    """A list of tags in a file of the driver, each with a name of its own."""
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
        f.write("# tags\nacg\nGTT\n")
        f.flush()
        layer, _ = build(tags=f"{f.name}$", ids="t")
    return run_layer(reads(spark, sf_dir), layer).where(F.size("names") > 0).select("read_id", F.array_join("names", ",").alias("names"))


@query(_greedy(["ACG", "GTT"]) + " SELECT read_id, count(*) AS hits FROM h GROUP BY read_id")
def tags_of_one_name(spark, sf_dir):
    """A list of tags in a file of the driver as alternatives of one tag."""
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as f:
        f.write("ACG\nGTT\n")
        f.flush()
        layer, _ = build(tags=f.name, ids="t")
    return run_layer(reads(spark, sf_dir), layer).where(F.size("hits") > 0).select("read_id", F.size("hits").cast("long").alias("hits"))


@query(f"""WITH {_R}, f AS (SELECT read_id, {_K} AS names FROM r), k AS (SELECT names, min(read_id) FILTER (read_id % 2 = 0) AS a, min(read_id) AS b FROM f GROUP BY names),
i AS (SELECT names, row_number() OVER (ORDER BY a IS NULL, coalesce(a, b)) - 1 AS id FROM k) SELECT read_id, id FROM f JOIN i USING (names)""")
def known_mapping(spark, sf_dir):
    """Numbers that go on from a written mapping: that of every second read."""
    layer, _ = build(assign=True, **_PAIR)
    df = reads(spark, sf_dir)
    ids = assign.first_appearance(run_layer(df.where("read_id % 2 = 0"), layer, ids=False), "key")
    path = f"{new_folder(spark, 'mapping')}/rows"
    sinks.write_mapping(assign.mapping(ids, "key", layer.bclen), path)
    known = assign.known_mapping(spark, path, layer.bclen).withColumnRenamed("names", "key")
    return run_layer(df, layer, known=known).select("read_id", "id")


# outputs


def _records(spark: SparkSession, sf_dir: str, n_files: int = 1, **options) -> DataFrame:
    layer, o = build(n_files=n_files, **options)
    return process(reads(spark, sf_dir, n_files), layer, o)[0]


def _text(name: str, seq: str, qual: str) -> str:
    return f"'@' || {name} || chr(10) || {seq} || chr(10) || '+' || chr(10) || {qual} || chr(10)"


@query(f"WITH {_R} SELECT read_id, 'out:0' AS stream, {_text("'r' || read_id", 'seq2', 'qual')} AS text FROM r")
def select_segment(spark, sf_dir):
    return _records(spark, sf_dir, 2, select="1").select("read_id", "stream", "text")


@query(f"WITH {_R} SELECT read_id, {_text("'r' || read_id", 'seq', 'qual')} AS text FROM r WHERE NOT contains(seq[1:30], 'ACG')")
def unassigned_reads(spark, sf_dir):
    """Reads without a tag, as they came in, though their layer trims."""
    return _records(spark, sf_dir, tags="ACG", left="1", trim_3="2", assign=True, unassigned=True).where("stream = 'unassigned:0'").select("read_id", "text")


@query(f"""WITH {_R}, f AS (SELECT *, {_K} AS names FROM r), g AS (SELECT *, min(read_id) OVER (PARTITION BY names) AS first FROM f), i AS (SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS id FROM g),
b AS (SELECT *, {_base4('id')} AS bc FROM i) SELECT read_id, {_text("'r' || read_id", 'bc || seq', "repeat('K', 16) || qual")} AS text FROM b""")
def barcode_embedded(spark, sf_dir):
    """Without a stream of barcodes the barcode stands before the first segment."""
    return _records(spark, sf_dir, assign=True, **_PAIR).where("stream = 'out:0'").select("read_id", "text")


@query(f"""WITH {_R}, f AS (SELECT *, {_K} AS names FROM r), g AS (SELECT *, min(read_id) OVER (PARTITION BY names) AS first FROM f), i AS (SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS id FROM g)
SELECT read_id, 'barcodes' AS stream, {_text("'r' || read_id", _base4('id'), "repeat('K', 16)")} AS text FROM i UNION ALL SELECT read_id, 'out:0', {_text("'r' || read_id", 'seq', 'qual')} FROM i""")
def barcode_file(spark, sf_dir):
    return _records(spark, sf_dir, assign=True, outb=True, **_PAIR).select("read_id", "stream", "text")


@query(_occurrences("ACG", "seq[pos + 4:pos + 7]", "pos <= 25").replace("SELECT read_id, coalesce(value, '') AS value FROM r LEFT JOIN v", "SELECT read_id, value AS seq FROM r JOIN v"))
def umi_file(spark, sf_dir):
    """The extractions of one name as a file of that name, read back; empty ones are left out."""
    folder = f"{new_folder(spark, 'umis')}/out"
    rows = _records(spark, sf_dir, tags="ACG", extract="{ACG}<u[4]>", empty_remove=True)
    sinks.write_files(rows, folder, 1)
    got = _read(spark, [[f"{folder}/file=u.fastq"]])
    return got.select(F.substring("name", 2, 20).cast("long").alias("read_id"), "seq")


@query(f"WITH {_R} SELECT CASE WHEN seq[1:2] = 'AC' THEN 'first' ELSE 'second' END AS file, 'r' || read_id AS name, seq FROM r WHERE seq[1:4] IN ('ACAC', 'ACGT', 'CCGG')")
def demux_files(spark, sf_dir):
    """Reads demultiplexed by prefix into files of their names, read back."""
    folder = f"{new_folder(spark, 'demux')}/out"
    sinks.write_files(_records(spark, sf_dir, assign=True, no_outb=True, keep="xAC,yAC first\nxAC,yGT first\nxCC,yGG second", **_PAIR), folder, 1)
    parts = [_read(spark, [[f"{folder}/file={n}_0.fastq"]]).select(F.lit(n).alias("file"), "name", "seq") for n in ("first", "second") if _there(spark, f"{folder}/file={n}_0.fastq")]
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@query(f"""WITH {_R}, t AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), p AS (SELECT a.c || b.c AS c FROM t a, t b),
m AS (SELECT 'x' AS "group", 'x' || c AS name, 17 AS domain, 1 AS weight, c, 1 AS at FROM p UNION ALL SELECT 'y', 'y' || c, 17, 17, c, 3 FROM p),
n AS (SELECT 'x' || seq[1:2] AS name, count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'y' || seq[3:4], count(*) FROM r GROUP BY 1)
SELECT "group", name, domain, weight, coalesce(n, 0) AS n FROM m LEFT JOIN n USING (name)""")
def radix_mapping(spark, sf_dir):
    """The table that codes of mixed radix are read with, and how many reads have each place of a code."""
    layer, _ = build(assign=True, barcode_encode="x,y", **_PAIR)
    found = run_layer(reads(spark, sf_dir), layer, only=("names",)).select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return sinks.radix_mapping(spark, layer).join(found, "name", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(f"WITH {_R} SELECT count(*) AS n_reads, 0::BIGINT AS n_records FROM r")
def no_output(spark, sf_dir):
    """All reads are processed, and none is written."""
    layer, o = build(tags="ACG", no_output=True)
    written, layers = process(reads(spark, sf_dir), layer, o)
    return layers[0][1].agg(F.count(F.lit(1)).alias("n_reads"), F.lit(written.count()).cast("long").alias("n_records"))


@query(f"""WITH {_R}, l AS (SELECT *, CASE WHEN instr(seq, 'ACG') > 0 THEN instr(seq, 'ACG') - 1 ELSE 32 END AS stay FROM r)
SELECT read_id, {_text("'r' || read_id", "CASE WHEN stay = 0 THEN 'GG' ELSE seq[1:stay] END", "CASE WHEN stay = 0 THEN 'KK' ELSE qual[1:stay] END")} AS text FROM l""")
def empty_fill(spark, sf_dir):
    return _records(spark, sf_dir, tags="ACG", right="1", empty="gg", pipe=True).select("read_id", "text")


@query(f"WITH {_R}, l AS (SELECT *, CASE WHEN instr(seq, 'ACG') > 0 THEN instr(seq, 'ACG') - 1 ELSE 32 END AS stay FROM r) SELECT read_id FROM l WHERE stay > 0")
def empty_removed(spark, sf_dir):
    return _records(spark, sf_dir, tags="ACG", right="1", empty_remove=True, pipe=True).select("read_id")


@query(f"WITH {_R} SELECT read_id, {_text("'r' || read_id", 'seq[3:8]', 'qual[3:8]')} AS text FROM r")
def extractions_only(spark, sf_dir):
    return _records(spark, sf_dir, extract="0:2<u[6]>", x_only=True, pipe=True).select("read_id", "text")


@query(f"WITH {_O} SELECT concat_ws(chr(9), name, '12', '*', '0', '0', '*', '*', '0', '0', translate(seq, 'acgt', 'ACGT'), qual, 'XD:Z:' || (doc_id % 7), 'XI:i:' || (doc_id - 50)) AS line FROM o")
def bam_records(spark, sf_dir):
    """Records written as binary alignment records and read back, shown as lines of text."""
    layer, _ = build(keep_comments=True)
    comment = F.concat(F.lit("XD:Z:"), (F.col("read_id") % 7).cast("string"), F.lit(" nothing XI:i:"), (F.col("read_id") - 50).cast("string"))
    df = odd_reads(spark, sf_dir).withColumn("segs", F.transform("segs", lambda s: s.withField("comment", comment)))
    path = f"{new_folder(spark, 'bam')}/reads"
    bam.write_bam(sinks.sam_fields(run_layer(df, layer), 1), path)
    return bam.read_bam(spark, path).select(sinks.sam_line().alias("line"))


# tables


def _lines(df: DataFrame, label: str) -> str:
    """One column of text, in order of ``nth``, as files."""
    path = f"{new_folder(df.sparkSession, label)}/rows"
    df.repartitionByRange("nth").sortWithinPartitions("nth").select("value").write.text(path)
    return path


def _contig_file(spark: SparkSession, sf_dir: str, width: int = lift.LINE, masked: str = "") -> str:
    """Contigs as FASTA, sixty bases a line, in a folder of files that may cut a contig; the longest has hundreds of KB.
    Masked bases are N."""
    c = pieces.recut(_contigs(spark, sf_dir), ["ordinal", "name"], lift.BLOCK)
    head = F.when(F.col("chunk") == 0, F.concat(F.lit(">"), "name", F.lit("\n"))).otherwise("")
    return _lines(c.select(F.struct("ordinal", "chunk").alias("nth"), F.concat(head, lift.wrapped(F.translate("bases", masked, "N" * len(masked)), width)).alias("value")), "contigs")


@query(f"WITH {_C} SELECT row_number() OVER (ORDER BY k) - 1 AS ordinal, chrom AS name, seq FROM c")
def contig_scan(spark, sf_dir):
    """Contigs read back by ranges of 64 KB and put together, a row each."""
    c = read_pieces(spark, _contig_file(spark, sf_dir), split_bytes=1 << 16)
    return c.groupBy("ordinal", "name").agg(pieces.joined("start", "bases").alias("seq"))


@query(f"""WITH {_C}, n AS (SELECT row_number() OVER (ORDER BY k) - 1 AS ordinal, chrom AS name, seq FROM c), b AS (SELECT *, unnest(range(0, (len(seq) + 999) // 1000)) AS chunk FROM n)
SELECT ordinal, name, chunk, substr(seq, (chunk * 1000 + 1)::INT, 1000) AS bases FROM b""")
def contig_pieces(spark, sf_dir):
    """Contigs read back by ranges that end within lines and headers, cut to blocks of 1,000 bases: no row holds a contig."""
    c = read_pieces(spark, _contig_file(spark, sf_dir), split_bytes=50_021)
    return pieces.recut(c, ["ordinal", "name"], 1000)


_VCF = """v AS (SELECT p_partkey AS k, 'c' || (p_partkey % 5) AS chrom, p_partkey * 3 AS pos, CASE p_partkey % 3 WHEN 0 THEN 'PASS' ELSE 'q10' END AS filter,
  CASE p_partkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' WHEN 2 THEN '1|2' ELSE './.' END AS gt FROM part)"""


def _vcf(spark: SparkSession, sf_dir: str) -> str:
    """Variants of two samples as VCF text, in order of chromosome and place."""
    k = F.col("p_partkey")
    gt = F.when(k % 4 == 0, "0/1").when(k % 4 == 1, "1/1").when(k % 4 == 2, "1|2").otherwise("./.")
    fields = [F.concat(F.lit("c"), (k % 5).cast("string")), (k * 3 + 1).cast("string"), F.concat(F.lit("v"), k.cast("string")), F.lit("A"), F.lit("C,T"), F.lit("9"), F.when(k % 3 == 0, "PASS").otherwise("q10"), F.lit("."), F.lit("DP:GT"), F.lit("5:0/0"), F.concat(F.lit("7:"), gt)]
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(((k % 5) * (1 << 40) + k).cast("long").alias("nth"), F.concat_ws("\t", *fields).alias("value"))
    head = spark.createDataFrame([(-2, "##fileformat=VCFv4.2"), (-1, "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "one", "two"]))], "nth long, value string")
    return _lines(head.unionByName(rows), "vcf")


@query(f"WITH {_VCF} SELECT chrom, pos::INT AS pos, 'v' || k AS id, 'A' AS ref, 'C,T' AS alts, filter, gt FROM v")
def vcf_scan(spark, sf_dir):
    return tables.read_vcf(spark, _vcf(spark, sf_dir), "two").select("chrom", "pos", "id", "ref", F.array_join("alts", ",").alias("alts"), "filter", "gt")


@query(f"WITH {_VCF} SELECT chrom, pos::INT AS pos, 'v' || k AS id, filter, gt, (row_number() OVER (ORDER BY k % 5, k) - 1)::BIGINT AS nth FROM v")
def vcf_of_blocks(spark, sf_dir):
    """Variants of blocked gzip, and their places in the order of files, ranges and lines."""
    path = f"{new_folder(spark, 'vcf-blocks')}/rows"
    text = spark.read.text(_vcf(spark, sf_dir)).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("nth")).alias("place"))
    bgzf.write_lines(text.repartitionByRange("place").sortWithinPartitions("place"), F.col("value"), path)
    rows = tables.read_vcf(spark, path, "two", split_bytes=1 << 20)
    return ordering.numbered(rows, ["block", "ordinal"], "nth").select("chrom", "pos", "id", "filter", "gt", "nth")


@query(f"""WITH {_VCF}, h AS (SELECT *, unnest([0, 1]) AS hap FROM v WHERE filter = 'PASS') SELECT chrom, hap, pos::INT AS pos, CASE WHEN gt = '1|2' AND hap = 1 THEN 'T' ELSE 'C' END AS alt
FROM h WHERE gt IN ('1/1', '1|2') OR (gt = '0/1' AND hap = 1)""")
def diploid_alleles(spark, sf_dir):
    """The alleles of both haplotypes of variants that pass."""
    return lift.alleles(tables.read_vcf(spark, _vcf(spark, sf_dir), "two"), diploid=True, passed=True).select("chrom", "hap", "pos", "alt")


@query(f"WITH {_VCF} SELECT chrom, pos::INT AS pos, 'C' AS alt FROM v WHERE gt = '1/1'")
def haploid_alleles(spark, sf_dir):
    return lift.alleles(tables.read_vcf(spark, _vcf(spark, sf_dir), "two")).select("chrom", "pos", "alt")


@query("""WITH v AS (SELECT o_orderkey AS n, 'c' || (o_orderkey // 1000) AS chrom, ((o_orderkey * 7919) % 100003)::INT AS pos FROM orders), w AS (SELECT *, lag(chrom) OVER (ORDER BY n) AS c, lag(pos) OVER (ORDER BY n) AS p FROM v)
SELECT chrom, pos, 'position' AS problem FROM w WHERE chrom = c AND p > pos""")
def unsorted_variants(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.floor(k / 4096).alias("block"), k.cast("long").alias("ordinal"), F.concat(F.lit("c"), F.floor(k / 1000).cast("string")).alias("chrom"), (k * 7919 % 100003).cast("int").alias("pos"))
    return lift.unsorted(rows)


@query("SELECT 'c' || (s_suppkey % 3) AS seqname, 'x' AS source, 'gene' AS feature, (s_suppkey * 10)::INT AS start, (s_suppkey * 10 + 5)::INT AS \"end\", 'id ' || s_suppkey AS rest FROM supplier")
def gtf_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat_ws("\t", F.concat(F.lit("c"), (k % 3).cast("string")), F.lit("x"), F.lit("gene"), (k * 10).cast("string"), (k * 10 + 5).cast("string"), F.concat(F.lit("id "), k.cast("string")))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("long").alias("nth"), line.alias("value"))
    return tables.read_gtf(spark, _lines(rows.unionByName(spark.createDataFrame([(-1, "# a comment"), (0, "too short")], "nth long, value string")), "gtf"))


@query("SELECT 'c' || (s_suppkey % 3) AS chrom, s_suppkey::INT AS start, (s_suppkey + 9)::INT AS \"end\" FROM supplier")
def junction_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat_ws(" ", F.concat(F.lit("c"), (k % 3).cast("string")), k.cast("string"), (k + 9).cast("string"), F.lit("+"))
    return tables.read_junctions(spark, _lines(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.cast("long").alias("nth"), line.alias("value")), "junctions"))


# numbers


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS nth FROM lineitem")
def number_rows(spark, sf_dir):
    """The place of every row, without a task that sees all of them."""
    return ordering.numbered(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "nth")


@query("SELECT o_custkey AS key, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS id, count(*) AS n FROM orders GROUP BY o_custkey")
def first_appearance(spark, sf_dir):
    """Customers by their first order."""
    return assign.first_appearance(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("read_id")), "key")


# sequences as FASTA


@query(f"""WITH {_R}, p AS (SELECT read_id, seq, seq2, unnest(range(0, 32)) AS pos FROM r), d AS (SELECT read_id, pos, seq[pos + 1] AS base, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS g FROM p WHERE seq[pos + 1] <> seq2[pos + 1]),
u AS (SELECT read_id, min(pos) AS start, string_agg(base, '' ORDER BY pos) AS bases FROM d GROUP BY read_id, g), n AS (SELECT *, row_number() OVER (ORDER BY read_id, start) AS nth FROM u) SELECT nth, '>' || nth || chr(10) || bases || chr(10) AS text FROM n""")
def unmask_fasta(spark, sf_dir):
    df = reads(spark, sf_dir, 2)
    one, two = (df.select(F.col("read_id").alias("ordinal"), F.element_at("segs", i).seq.alias("seq")) for i in (1, 2))
    return unmask.unmasked_fasta(unmask.unmasked_runs(one, two))


@query(f"""WITH {_C}, n AS (SELECT row_number() OVER (ORDER BY k) - 1 AS ordinal, seq FROM c), p AS (SELECT ordinal, unnest(regexp_extract_all(seq, 'A+')) AS bases FROM n) SELECT ordinal, len(bases)::BIGINT AS size, count(*) AS n FROM p GROUP BY ALL""")
def unmask_pieces(spark, sf_dir):
    """Two FASTA files of other line widths, read by ranges and compared by chunk: runs of A, which the second one masks, by
    contig and length."""
    runs = unmask.unmasked_runs(read_pieces(spark, _contig_file(spark, sf_dir), 50_021), read_pieces(spark, _contig_file(spark, sf_dir, 50, "A"), 1 << 16))
    return runs.groupBy("ordinal", F.length("bases").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_R} SELECT read_id, barcode FROM (SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS barcode FROM r)")
def revcomp(spark, sf_dir):
    """A transform of an extraction of the whole read."""
    layer, _ = build(extract="0:0<~u[32]>")
    return run_layer(reads(spark, sf_dir), layer).select("read_id", F.element_at("umis", 1).value.alias("barcode"))


@query(f"WITH {_R} SELECT count(*) AS n_reads, 0::BIGINT AS n_assigned, 0::BIGINT AS n_records FROM r")
def nothing_found(spark, sf_dir):
    """A tag that no read has: reads are counted, none is assigned or written."""
    layer, o = build(tags="ACGTACGTACGTACGTACGTACGTACGTACGTACGT", assign=True, pipe=True)
    written, layers = process(reads(spark, sf_dir), layer, o)
    return layers[0][1].agg(F.count(F.lit(1)).alias("n_reads"), F.count_if("assigned").alias("n_assigned"), F.lit(written.count()).cast("long").alias("n_records"))
