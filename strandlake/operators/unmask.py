"""What differs between two versions of the same sequences: maximal runs of unequal characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.ordering import numbered, running, spans
from strandlake.sources.staging import staged

CHUNK = 1 << 16


def chunked(seq: Column, size: int | None = None) -> Column:
    """A sequence as an array of chunks, cut in one pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size or CHUNK}}}"), F.lit(0))


def _grid(sequences: DataFrame) -> DataFrame:
    """ordinal, chunk, bases: sequences, whole or in pieces, cut to one grid."""
    from strandlake.operators.pieces import recut  # pieces are cut by the chunks of this module

    if "seq" in sequences.columns:
        return sequences.select("ordinal", F.posexplode(chunked("seq")).alias("chunk", "bases"))
    return recut(sequences, ["ordinal"], CHUNK)


def unmasked_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(ordinal, start, bases): runs of the first sequences where the second ones differ, up to the shorter length.

    first, second: rows (ordinal, seq) or, where sequences may be long, pieces (ordinal, start, bases), whose lengths needn't
    agree. Both are cut to one grid and compared by chunk; of the runs, those that touch a border of the grid are put
    together, all others are whole.
    """
    both = _grid(first).withColumnRenamed("bases", "a").join(_grid(second).withColumnRenamed("bases", "b"), ["ordinal", "chunk"])
    parts = both.where("a <> b").select("ordinal", "chunk", F.struct("a", "b").alias("s"))
    chars = parts.select("ordinal", "chunk", F.posexplode(F.arrays_zip(F.split("s.a", "").alias("a"), F.split("s.b", "").alias("b"))).alias("at", "c"))
    unlike = chars.where("c.a <> c.b").select("ordinal", "chunk", (F.col("chunk").cast("long") * CHUNK + F.col("at")).alias("pos"), F.col("c.a").alias("base"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("ordinal", "chunk").orderBy("pos"))
    runs = unlike.withColumn("run", run).groupBy("ordinal", "chunk", "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("bases")
    )
    runs = staged(runs.select("ordinal", "start", "last", "bases"), "runs")
    touches = ((F.col("start") % CHUNK == 0) & (F.col("start") > 0)) | (F.col("last") % CHUNK == CHUNK - 1)
    cut = running(runs.where(touches), ["ordinal"], spans("start"), ["start"], {"before": ("before", F.col("last"))})
    begins = F.when(F.coalesce(F.col("start") - F.col("before"), F.lit(2)) > 1, F.col("start"))
    cut = running(cut, ["ordinal"], spans("start"), ["start"], {"run": ("max", begins)})
    whole = cut.groupBy("ordinal", "run").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "bases"))).alias("s"))
    whole = whole.select("ordinal", "start", F.array_join(F.transform("s", lambda x: x["bases"]), "").alias("bases"))
    return runs.where(~touches).select("ordinal", "start", "bases").unionByName(whole)


def unmasked_fasta(runs: DataFrame, header: str | None = None) -> DataFrame:
    """(nth, text) FASTA records of runs, with the given header (it may be empty) or numbers from 1 on."""
    rows = numbered(runs, ["ordinal", "start"], "nth", 1)
    name = F.lit(header) if header is not None else F.col("nth").cast("string")
    return rows.select("nth", F.concat(F.lit(">"), name, F.lit("\n"), F.col("bases"), F.lit("\n")).alias("text"))
