"""Writers: streams of records, single ordered files, blocked gzip, barcode tables, SAM text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.assign import radix_rows
from strandlake.model import Layer
from strandlake.sources import bgzf


def write_streams(records: DataFrame, folder: str, compression: str | None = None) -> None:
    """A folder a stream (stream=...), records in order within each file: sorted by range, so files follow each other."""
    _write(records, F.col("stream"), "stream", folder, compression)


def write_files(records: DataFrame, folder: str, n_files: int, compression: str | None = None, fasta: bool = False, r1_r2: bool = False) -> None:
    """A folder a file of the outputs (file=..., as ``file_of`` names it), so reads demultiplexed by prefix end in files of
    their names; ``read_reads`` takes such a folder for a file."""
    _write(records, file_of(F.col("stream"), n_files, fasta, r1_r2), "file", folder, compression)


def write_blocked(records: DataFrame, stream: str, path: str) -> None:
    """One stream as a folder of blocked gzip in order; ``read_fastx`` splits such files."""
    rows = records.where(F.col("stream") == stream).repartitionByRange("read_id").sortWithinPartitions("read_id", "nth")
    bgzf.write_lines(rows, F.regexp_replace("text", "\n$", ""), path)


def _write(records: DataFrame, by: Column, name: str, folder: str, compression: str | None) -> None:
    out = records.repartitionByRange("read_id").withColumn(name, by).sortWithinPartitions(name, "read_id", "nth")
    out = out.select(name, F.regexp_replace("text", "\n$", "").alias("value"))
    out.write.partitionBy(name).option("compression", compression or "none").text(folder)


def file_of(stream: Column, n_files: int, fasta: bool = False, r1_r2: bool = False) -> Column:
    """The file name of a stream. Streams of a list with a prefix are prefix_barcodes and prefix_0, prefix_1, ... (or _R1,
    _R2, ...); a prefix with as many comma-separated names as files gives these; extractions have the name of theirs."""
    end = F.lit(".fasta" if fasta else ".fastq")
    prefix, part = F.regexp_extract(stream, "^(.*):([^:]*)$", 1), F.regexp_extract(stream, "^(.*):([^:]*)$", 2)
    names = F.split(prefix, ",")
    number = part.try_cast("int")
    shown = F.concat(F.lit("R"), (number + 1).cast("string")) if r1_r2 else part
    own = (F.size(names) == n_files) & number.isNotNull() & F.lit(n_files > 1)
    kind = F.when(prefix.isin("out", "unassigned"), F.concat(prefix, F.lit("_"), part, end))
    kind = kind.when(prefix == "umi", F.concat(part, end)).when(own, F.concat(F.get(names, number), end))
    return kind.when(prefix != "", F.concat(F.element_at(names, 1), F.lit("_"), shown, end)).otherwise(F.concat(stream, end))


def write_ordered(records: DataFrame, stream: str, path: str, compression: str | None = None) -> None:
    """One stream as one ordered file (in a folder): for outputs that have to be one file, whatever their size."""
    rows = records.where(F.col("stream") == stream).orderBy("read_id", "nth").select(F.regexp_replace("text", "\n$", "").alias("value"))
    rows.coalesce(1).write.option("compression", compression or "none").text(path)


def write_mapping(mapping: DataFrame, path: str, compression: str | None = None) -> None:
    """The barcode table, tab separated, in order of id."""
    mapping.orderBy("id").drop("id").write.option("sep", "\t").option("compression", compression or "none").csv(path)


def radix_mapping(spark, layer: Layer) -> DataFrame:
    """group, name, domain, weight: the table that codes of mixed radix are read with."""
    return spark.createDataFrame(radix_rows(layer, layer.sub_encode or layer.encode), "group string, name string, domain int, weight long")


def sam_fields(df: DataFrame, n_files: int, select: list[int] | None = None) -> DataFrame:
    """read_id, nth, name, flag, seq, qual, tags: unmapped records of processed reads that are assigned. A list of names
    ::[a][b] at the end of a name becomes YM:Z:a:b, before the comment tokens XX:T:value (Z and i only). Flags are those of a
    read without a place whose mate has none; with two segments, paired and first or second."""
    chosen = [j for j in range(n_files) if select is None or j in select]
    paired = len(chosen) == 2
    rows = []
    for nth, j in enumerate(chosen):
        s = F.element_at("out", j + 1)
        flag = 4 + 8 + ((1 + (64 if nth == 0 else 128)) if paired else 0)
        tokens = F.filter(F.split(F.coalesce(s["comment"], F.lit("")), r"\s+"), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[Zi]:"))
        listed = F.regexp_extract(s["name"], r"::\[((?:[^\]]*\]\[)*[^\]]*)\]$", 1)
        names = F.when(listed != "", F.array(F.concat(F.lit("YM:Z:"), F.replace(listed, F.lit("]["), F.lit(":"))))).otherwise(F.array().cast("array<string>"))
        rows.append(F.struct(F.lit(nth).alias("nth"), F.regexp_replace(s["name"], "::.*$", "").alias("name"), F.lit(flag).alias("flag"), _or_star(s.seq).alias("seq"), _or_star(s.qual).alias("qual"), F.concat(names, tokens).alias("tags")))
    ours = df.where(F.col("passes") & F.col("assigned") & ~F.col("discard"))
    return ours.select("read_id", F.explode(F.array(*rows)).alias("r")).select("read_id", "r.*")


def sam_line() -> Column:
    """The fields as a line of text."""
    place = [F.lit(x) for x in ("*", "0", "0", "*", "*", "0", "0")]
    return F.concat_ws("\t", "name", F.col("flag").cast("string"), *place, "seq", "qual", "tags")


def sam_lines(df: DataFrame, n_files: int, select: list[int] | None = None) -> DataFrame:
    """read_id, nth, line: the same records as text."""
    return sam_fields(df, n_files, select).select("read_id", "nth", sam_line().alias("line"))


def _or_star(text: Column) -> Column:
    return F.when(text == "", "*").otherwise(text)
