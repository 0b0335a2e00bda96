"""Exact dedup: a tree merge of sorted digest runs.

Each input partition is a slot and makes one run: its digests in order, one entry for equal texts. In each round the runs
of ``FAN_IN`` neighbouring slots are exchanged by digest, merged in order and collapsed, so equal texts meet once in each
round and every level passes on the number of rows and the identifier to keep only; after log(slots) rounds one slot is
left, dealt over all tasks by digest. Spark plans each round as partial sort aggregation, exchange, sort, sort
aggregation: sorted runs, merged with spilling. The winners then go back to the slots that hold their digest, so a text
with a third of all rows returns as one row a slot, and is joined within its slot.

An entry is verified by SHA-256, the number of bytes and a second, independent 64-bit hash of the text: entries merge
only if all three agree.

Edge cases: a null text equals the empty text. Of equal texts the row with the largest doc_id stays (or the smallest, by
``keep``); texts may have any length, only digests travel; null ids lose to all others; of rows with the same id and text exactly one stays. An empty table gives an
empty table. Other columns are ignored by ``exact_groups`` and pass through ``drop_exact_copies``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import keep_one, staged

FAN_IN = 16
_KEY = ["_sha", "_bytes", "_check"]


def _digest() -> list:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.unhex(F.sha2(text, 256)).alias("_sha"), F.octet_length(text).alias("_bytes"), F.xxhash64(text).alias("_check")]


def exact_groups(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    rows = staged(docs.select("doc_id", *_digest(), F.spark_partition_id().alias("_slot"), F.monotonically_increasing_id().alias("_uid")), "digests")
    null_last = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    runs = rows.groupBy("_slot", *_KEY).agg(best(F.struct(null_last.alias("known"), "doc_id", "_uid")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    slots = (rows.agg(F.max("_slot")).first()[0] or 0) + 1
    level = runs
    for _ in range(max(1, math.ceil(math.log(slots, fan_in))) if slots > 1 else 1):
        level = level.withColumn("_slot", F.floor(F.col("_slot") / fan_in).cast("int")).groupBy("_slot", *_KEY).agg(best("_best").alias("_best"), F.sum("_n").alias("_n"))
    back = runs.select("_slot", *_KEY).join(level.drop("_slot"), _KEY)
    return rows.join(back, ["_slot", *_KEY]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_uid") == F.col("_best._uid")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without the rows that ``exact_groups`` does not keep."""
    several = exact_groups(docs, keep).where("group_size > 1").select(F.col("doc_id").alias("_id"), "keep_id", F.unhex("text_sha256").alias("_sha"))
    pairs = staged(several.groupBy("_id", "_sha", "keep_id").agg(F.count(F.lit(1)).alias("_n")), "exact-several")
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    return keep_one(docs, pairs.where(~stays).select("_id", "_sha"), pairs.where(stays & (F.col("_n") > 1)).select("_id", "_sha"), _digest()[0])


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
