"""Text tables: variants, annotations, splice junctions, and FASTA contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.bgzf import all_blocked, read_lines
from strandlake.sources.fastx import SPLIT_BYTES, read_fastx


def read_vcf(spark: SparkSession, path: str, sample: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """block, ordinal, chrom, pos (0-based), id, ref, alts, filter, gt of one sample, from VCF text (plain, .gz, or .gz in
    blocks, which is split), a file or a folder of part files. block (file, offset) rises in the order of the files and their parts; a part is read by one task,
    so ordinal rises within it."""
    if all_blocked(path):
        lines = read_lines(spark, path, split_bytes).select("value", F.struct("file", "offset").alias("block"), F.col("nth").alias("ordinal"))
    else:
        block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"))
        lines = spark.read.text(path).withColumns({"block": block, "ordinal": F.monotonically_increasing_id()})
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    columns = head[0].split("\t") if head else []
    if sample not in columns[9:]:
        raise ValueError(f"{sample} is no sample of {path}")
    f = F.split(F.col("value"), "\t")

    def field(i: int) -> Column:
        return F.get(f, F.lit(i))

    place = F.array_position(F.split(field(8), ":"), "GT").cast("int")
    values = F.split(field(columns.index(sample)), ":")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(
        "block", "ordinal", field(0).alias("chrom"), (field(1).try_cast("int") - 1).alias("pos"), field(2).alias("id"), field(3).alias("ref"), F.split(field(4), ",").alias("alts"), field(6).alias("filter"),
        F.when(place > 0, F.get(values, place - 1)).alias("gt"),
    ).where("gt is not null")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """seqname, source, feature, start, end, rest; comments and short lines are left out."""
    p = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)\s*(.*)$"
    v = F.col("value")
    rows = spark.read.text(path).where(~v.startswith("#") & v.rlike(p))
    g = [F.regexp_extract(v, p, i) for i in range(1, 7)]
    return rows.select(g[0].alias("seqname"), g[1].alias("source"), g[2].alias("feature"), g[3].cast("int").alias("start"), g[4].cast("int").alias("end"), g[5].alias("rest"))


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of lines with at least these, between blanks or tabs."""
    p = r"^\s*(\S+)\s+(\d+)\s+(\d+)"
    v = F.col("value")
    return spark.read.text(path).where(v.rlike(p)).select(F.regexp_extract(v, p, 1).alias("chrom"), F.regexp_extract(v, p, 2).cast("int").alias("start"), F.regexp_extract(v, p, 3).cast("int").alias("end"))


def read_contigs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ordinal, name, seq."""
    return read_fastx(spark, path, split_bytes).select("ordinal", F.col("seg")["name"].alias("name"), F.col("seg.seq").alias("seq"))
