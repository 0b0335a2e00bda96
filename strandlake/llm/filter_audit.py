"""Filter interaction audit: what each of five filters removes alone, after others and in every order of all five.

Conditions A to D of a row are expressions; E, a text that a smaller doc_id has too, comes from sorting: rows are dealt by
range of the text's fingerprint and doc_id, so a text that a third of all rows have is dealt over many tasks, and put in
order of fingerprint, full text and doc_id within each. A pass over the sorted rows compares each with its predecessor and
carries the smallest doc_id of the run. What the pass can't see is whether the run began in an earlier task: the runs of
the first and of the last fingerprint of a task are written with their texts, a row a text, and joined by fingerprint and
full text; the smallest doc_id of such a run goes back to its rows by task and number of the run.

Failures of a row are a mask of five bits. Masks are counted by part, with the labels, to at most 32 rows a part; counters
are additive, so the figures of all 120 orders come from these: a filter removes the masks that have its bit and none of
the bits before it, and in 120 / (bits of the mask) of all orders it is the first of them.

Edge cases: null texts and langs are ''; an empty text fails A only, and E if a smaller id has an empty text; a null doc_id
is neither smaller than another nor larger; rows that agree in id and text don't fail E by each other; a document is
labelled if any row of labels with its doc_id says so; texts may have any length; an empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
FILTERS, MIN_WORDS, MARKS = "ABCDE", 100, "[#$%&*|]"


def conditions(text: Column) -> Column:
    """The bits of A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    fails = [n < MIN_WORDS, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * 80, F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(10).cast("long"), text.rlike(MARKS)]
    out = F.lit(0)
    for i, f in enumerate(fails):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (print, text, doc_id, lang, mask) -> rows with E as far as it is seen here, and the runs at the borders.

    run is the number of a run if it may go on in another task, else null. A border run is a row with text and the smallest
    doc_id of it here.
    """
    task = TaskContext.get().partitionId()
    held: list[tuple] = []  # runs of the fingerprint at hand: (print, run, text, smallest)
    run, mark, begun, text, least, first = -1, None, False, None, None, True
    border: list[tuple] = []
    names = ["task", "run", "print", "text", "doc_id", "lang", "mask"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), None, pa.string(), pa.int32()]

    def made(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k or kind) for c, k in zip(columns, kinds, strict=True)], names)

    kind = None
    for b in batches:
        kind = b.schema.field("doc_id").type
        rows = []
        for fingerprint, whole, doc_id, lang, mask in zip(b.column("print").to_pylist(), b.column("text"), b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), b.column("mask").to_pylist(), strict=True):
            now = whole.as_buffer()
            if not begun or fingerprint != mark:
                if begun and first:
                    border, first = held, False
                held = []
            if not begun or fingerprint != mark or now != text:
                run, least = run + 1, None
                held.append([fingerprint, run, now, None])
            begun, mark, text = True, fingerprint, now
            later = doc_id is not None and least is not None and doc_id > least
            if least is None and doc_id is not None:
                least = held[-1][3] = doc_id
            rows.append((task, run, None, None, doc_id, lang, mask + (16 if later else 0)))
        yield made(rows, kind)
    if begun:
        for fingerprint, number, whole, smallest in border + held:
            yield made([(task, number, fingerprint, whole.to_pybytes().decode(), smallest, None, None)], kind)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, lang, mask of each row: bit i is set where the row fails the i-th of ``FILTERS``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"), F.xxhash64(text).alias("print"))
    dealt = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = dealt.select("print", "text", "doc_id", "lang", conditions(F.col("text")).alias("mask")).mapInArrow(_compared, f"task int, run long, print long, text string, doc_id {kind}, lang string, mask int")
    seen = staged(seen, "filter-masks")
    runs = seen.where("mask is null").select("task", "run", "print", "text", "doc_id")
    whole = runs.groupBy("print", "text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_tasks")).where("_tasks > 1")
    edges = staged(runs.join(whole, ["print", "text"]).select("task", "run", "_least"), "filter-edges")
    out = seen.where("mask is not null").join(F.broadcast(edges), ["task", "run"], "left")  # two texts a task, but for equal fingerprints
    late = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))
    return out.select("doc_id", "lang", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)).alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask, and how many of them are labelled good and toxic."""
    rows = masks(docs).groupBy("doc_id", "lang", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = rows.join(said, "doc_id", "left")
    return rows.groupBy(F.col("lang").alias("part"), "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(f"_{c}") == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits before it) of every order."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, bit[f], sum(bit[x] for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counters kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = mask_counts(docs, labels)
    of = F.struct("mask", "n", "good", "toxic", F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long").alias("orders"))
    parts = counts.groupBy("part").agg(F.collect_list(of).alias("m"))  # 32 rows a part at most
    steps = ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'bit', {b}, 'before', {s})" for o, k, b, s in _steps())
    rows = parts.select("part", "m", F.explode(F.expr(f"array({steps})")).alias("s")).select("part", "m", "s.*")

    def total(cond: str, value: str = "x.n") -> Column:
        return F.expr(f"aggregate(m, 0L, (a, x) -> a + CASE WHEN {cond} THEN {value} ELSE 0L END)")

    fails, early = "x.mask & bit <> 0", "x.mask & before"
    return rows.select(
        "part", "filter_order", "step", total("x.mask & (before | bit) = 0").alias("kept"), total(f"{fails} AND {early} = 0").alias("removed"), total(f"{fails} AND {early} <> 0").alias("redundant"),
        total("x.mask = bit").alias("unique_fails"), total(f"{fails} AND {early} = 0", "x.good").alias("good_lost"), total(f"{fails} AND {early} = 0", "x.toxic").alias("toxic_lost"), total(fails, "x.n * x.orders").alias("shapley"),
    )


ORACLE = (
    r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, doc_id, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * len(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
s(filter_order, step, b, p) AS (VALUES """
    + ", ".join(map(str, _steps()))
    + """)
SELECT part, filter_order, step::INT AS step, sum(CASE WHEN mask & (p | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & b <> 0 AND mask & p = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & b <> 0 AND mask & p <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & b <> 0 AND mask & p = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & b <> 0 AND mask & p = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & b <> 0 THEN n * (120 // bit_count(mask::INT)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""
)
