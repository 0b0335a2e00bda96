"""From documents to token ids: quality, exact copies, near copies, mixture, encoding.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns the columns of documents; the
last returns doc_id, n_tokens, ids and decoded_sha256, the digest of the bytes that the ids decode to.

Edge cases, stage by stage: a null text is scored, compared, sized and encoded as the empty text. Without learnable labels
the classifier keeps all rows. Of rows with equal text the largest doc_id stays, of near copies the smallest; null ids lose;
of rows that agree in id and text one stays. Null sources are one source; a source without words is not taken, so an input
without any words gives no rows. Rows that the mixture repeats follow each other and are encoded once, then written as often
as they come. Texts may have any length. Columns beside those of documents pass through all stages but the last, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, exact_dedup, jaccard, mixing, quality
from strandlake.llm.common import staged


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokens.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_good_documents),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_texts),
]

#: A classifier and an encoder can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
