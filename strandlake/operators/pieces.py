"""Sequences as rows of pieces (name, start, bases): no row, group or task holds a whole contig.

Contigs are given as rows (ordinal, name, seq) or, where they may be long, as pieces (ordinal, name, start, bases) in any
lengths; both are cut to chunks of one grid before they are joined to anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import part
from strandlake.operators import unmask


def pieces(contigs: DataFrame) -> DataFrame:
    """name, start, bases: pieces of a chunk at most, whatever contigs are made of."""
    if "seq" in contigs.columns:
        contigs = contigs.select("name", F.lit(0).cast("long").alias("start"), F.col("seq").alias("bases"))
    cut = contigs.select("name", F.col("start").cast("long").alias("_start"), F.posexplode(unmask.chunked("bases")).alias("_nth", "bases"))
    return cut.select("name", (F.col("_start") + F.col("_nth") * unmask.CHUNK).alias("start"), "bases")


def sized(contigs: DataFrame) -> DataFrame:
    """ordinal, name, size."""
    if "seq" in contigs.columns:
        return contigs.select("ordinal", "name", F.length("seq").cast("long").alias("size"))
    return contigs.groupBy("ordinal", "name").agg(F.max(F.col("start") + F.length("bases")).cast("long").alias("size"))


def recut(rows: DataFrame, keys: list[str], size: int, overlap: int = 0) -> DataFrame:
    """keys, chunk, bases: rows (keys, start, bases) cut to a grid of ``size`` places; a chunk also has the ``overlap`` bases behind it."""
    end = F.col("start") + F.length("bases")
    first, last = F.greatest(F.floor((F.col("start") - overlap) / size), F.lit(0)), F.floor((end - 1) / size)
    # a condition of the list, not a filter: that would go down to the scan, and make bases there for nothing else
    each = rows.select(*keys, "start", "bases", F.explode(F.when(F.length("bases") > 0, F.sequence(first, last))).alias("chunk"))
    a = F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0)).cast("int")
    b = F.least((F.col("chunk") + 1) * size + overlap - F.col("start"), F.length("bases")).cast("int")
    cut = each.select(*keys, "chunk", (F.col("start") + a).alias("at"), part(F.col("bases"), a, b - a).alias("t"))
    return cut.groupBy(*keys, "chunk").agg(joined("at", "t").alias("bases"))


def joined(at: str, text: str) -> Column:
    """The texts of a group put together in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")


def chunks(contigs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """chrom, chunk, bases: contigs cut to a common grid. A place in a chunk is found by counting characters, so a table that
    has many places a chunk is joined to small ones."""
    if "seq" in contigs.columns and not overlap:
        return contigs.select(F.col("name").alias("chrom"), F.posexplode(unmask.chunked("seq", size)).alias("chunk", "bases"))
    return recut(pieces(contigs), ["name"], size, overlap).withColumnRenamed("name", "chrom")
