"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight by its rank in code point order (null last). The budget is a share of all words, dealt in
proportion to the weights; a source that would exceed its cap (``max_epochs`` times its words) is clamped there and the
excess goes to the others in proportion, until none is above. Sources are clamped in order of cap / weight, so running
sums over that order give the fixed point at once: one window over one row a source.

Within a source all documents get the whole repetitions; the fraction goes to the documents that come first by a seeded
digest of the id, up to the document whose middle lies beyond the fraction. A source of any size is cut by 4,096 ranges
of the digest: sums by range find the range with the cut, and only the documents of that range are put in order.

Edge cases: null texts have no words; texts may have any length, only their sizes are kept; null sources are one source, the last; rows with the same id are taken together;
a source without words has target 0 and is not taken; an empty table gives an empty table. Other columns pass through
``mix`` unchanged whatever their names are; ``mix_report`` doesn't look at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import broadcast_up_to, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def _sized(docs: DataFrame, seed: str) -> list[Column]:
    return [
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("z")).alias("_source"),  # null: "z", after all others
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("_place"),
    ]


def _sources(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """A row a source: _source, source_size, target, _whole, _cut (documents up to this digest get one more repetition)."""
    span = F.substring("_place", 1, 3).alias("_span")
    spans = sized.groupBy("_source", span).agg(F.sum("_size").alias("_words"))
    ranked = spans.groupBy("_source").agg(F.sum("_words").alias("source_size")).withColumn("_rank", F.row_number().over(Window.orderBy("_source")))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("_weight", pick.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    ordered, everything = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank"), Window.partitionBy()
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        weighed.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_rest_weight", F.sum("_weight").over(everything) - F.sum("_weight").over(upto) + F.col("_weight"))
        .withColumn("_rest_budget", F.col("_budget") - F.sum("_cap").over(upto) + F.col("_cap"))
        .withColumn("_clamped", F.col("_cap") * F.col("_rest_weight") <= F.col("_weight") * F.col("_rest_budget"))
        .withColumn("_free_budget", F.col("_budget") - F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(everything))
        .withColumn("_free_weight", F.sum(F.when(F.col("_clamped"), 0.0).otherwise(F.col("_weight"))).over(everything))
        .withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_free_budget") / F.col("_free_weight")))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_quota", F.col("target") - F.col("_whole") * F.col("source_size"))
        .select("_source", "source_size", "target", "_whole", "_quota")
    )
    filled = broadcast_up_to(staged(filled, "mix-sources"), 10_000)
    running = Window.partitionBy("_source").orderBy("_span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy("_source").orderBy("_span")
    edge = (
        spans.withColumn("_upto", F.sum("_words").over(running))
        .join(filled.where("_quota > 0"), "_source")
        .where("_upto >= _quota")
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("_source", "_span", (F.col("_upto") - F.col("_words")).alias("_before"), "_quota")
    )
    edge = broadcast_up_to(staged(edge, "mix-edges"), 10_000)
    within = Window.partitionBy("_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        sized.withColumn("_span", span)
        .join(edge, ["_source", "_span"])
        .groupBy("_source", "_span", "_before", "_quota", "_place")
        .agg(F.sum("_size").alias("_words"))
        .withColumn("_middle", F.col("_before") + F.sum("_words").over(within) - F.col("_words") * F.lit(0.5))
        .groupBy("_source", "_span")
        .agg(F.max(F.when(F.col("_middle") <= F.col("_quota"), F.col("_place"))).alias("_last"))
        .select("_source", F.coalesce("_last", "_span").alias("_cut"))
    )
    return filled.join(cut, "_source", "left").select("_source", "source_size", "target", "_whole", F.coalesce("_cut", F.lit("")).alias("_cut"))


def _repeats() -> Column:
    return F.col("_whole") + (F.col("_place") <= F.col("_cut")).cast("long")


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, taken, source, repeats."""
    sized = staged(docs.select("doc_id", "source", *_sized(docs, seed)), "mix-sizes")
    plan = broadcast_up_to(staged(_sources(sized, weights, share, max_epochs), "mix-plan"), 10_000)
    return sized.join(plan, "_source").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _repeats()).alias("taken"), "source", _repeats().alias("repeats")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: docs with each row as often as the plan takes it."""
    sized = staged(docs.select("doc_id", *_sized(docs, seed)), "mix-sizes")
    plan = broadcast_up_to(staged(_sources(sized, weights, share, max_epochs), "mix-plan"), 10_000)
    source, _, place = _sized(docs, seed)
    rows = docs.select(F.struct("*").alias("_row"), source, place).join(plan, "_source")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _repeats().cast("int")))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'z') AS k, md5(concat_ws(':', 'mix-1', doc_id::VARCHAR)) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS weight,
             row_number() OVER (ORDER BY k) AS rk, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, rk) + weight AS rest_weight,
             sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - sum(cap) OVER (ORDER BY cap / weight, rk) + cap AS rest_budget FROM w),
c AS (SELECT *, cap * rest_weight <= weight * rest_budget AS clamped FROM f),
t AS (SELECT *, CASE WHEN clamped THEN cap ELSE weight * (budget - sum(CASE WHEN clamped THEN cap ELSE 0.0::DOUBLE END) OVER ())
             / sum(CASE WHEN clamped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM c),
q AS (SELECT k, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
p AS (SELECT k, place, sum(size)::DOUBLE AS words FROM d GROUP BY k, place),
m AS (SELECT k, place, sum(words) OVER (PARTITION BY k ORDER BY place ROWS UNBOUNDED PRECEDING) - words * 0.5::DOUBLE AS middle FROM p),
r AS (SELECT m.k, m.place, (middle <= target - whole * source_size AND target - whole * source_size > 0)::BIGINT AS more FROM m JOIN q USING (k))
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (q.whole + r.more) AS taken
FROM d JOIN q USING (k) JOIN r ON r.k = d.k AND r.place = d.place
"""
