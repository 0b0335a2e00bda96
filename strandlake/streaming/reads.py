"""Layers over streams of reads. A layer without dense ids is one narrow step, so it is the same on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.model import READS, Layer
from strandlake.operators.layer import run_layer


def stream_reads(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Reads (read_id, run_id, segs) of Parquet files as they come into a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_layer(reads: DataFrame, layer: Layer) -> DataFrame:
    """run_layer on a stream. Barcodes come from codes (``layer.encode``); numbers by first appearance need the whole input."""
    if layer.assign and not layer.encode:
        raise ValueError("numbers by first appearance need the whole input; a stream takes codes")
    return run_layer(reads, layer, ids=False)


def tag_counts(processed: DataFrame) -> DataFrame:
    """Running counts by tag and errors, for complete or update mode; state is a row a tag and number of errors."""
    return processed.select(F.explode("hits").alias("h")).groupBy(F.col("h.name").alias("tag"), F.least(F.col("h.err"), F.lit(3)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


def barcode_counts(processed: DataFrame) -> DataFrame:
    """Running counts by barcode code; reads that come again with their read_id within a batch count again."""
    return processed.where("id is not null and not discard").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
