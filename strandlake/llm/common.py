"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.staging import new_folder, shared_dir, staged  # noqa: F401

FILTER_BITS, BATCH_BYTES = 1 << 27, 4 << 20
_kept: dict[Hashable, Any] = {}


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python about BATCH_BYTES at a time, whatever their length: by its default 10,000
    texts are one batch, which both sides of the pipe hold more than once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def kept(key: Hashable, make: Callable[[], Any] = lambda: None) -> Any:
    """What a Python worker keeps from task to task: one thing at a time, so what another operator left is let go."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salt(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def _same(left: str, right: str, on: list[str]) -> Column:
    out = F.lit(True)
    for c in on:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def salted_join(df: DataFrame, table: DataFrame, key: list[str], salted_by: Column, salts: int = 64, merge: bool = False) -> DataFrame:
    """df with the columns of table, which has one row a key, however many rows of df have one key. Null keys are equal.

    Rows of df are dealt over ``salts`` parts; table goes to the parts that hold a key, one row for each of them. merge:
    neither side is broadcast, even where Spark takes it for small.
    """
    how = (lambda d: d.hint("merge")) if merge else (lambda d: d)
    part, more = "_part", [c for c in table.columns if c not in key]
    df = df.withColumn(part, salt(salted_by, salts))
    back = df.select(*key, part).distinct().alias("p").join(how(table.alias("t")), _same("p", "t", key)).select("p.*", *[f"t.{c}" for c in more])
    return df.alias("d").join(how(back.alias("b")), _same("d", "b", [*key, part])).select(*[f"d.{c}" for c in df.columns if c != part], *[f"b.{c}" for c in more])


def group_lookup(df: DataFrame, key: list[str], salted_by: Column, aggregates: dict[str, tuple[Column, str]], salts: int = 64) -> DataFrame:
    """df with a column for each aggregate over the rows of its key. aggregates: name -> (column, one of min, max, sum)."""
    table = df.groupBy(*key).agg(*[getattr(F, how)(c).alias(k) for k, (c, how) in aggregates.items()])
    return salted_join(df, table, key, salted_by, salts)


def maybe_among(df: DataFrame, digest: Column, table: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """df with ``_maybe``: whether a row's digest may be one of those in table (column ``_sha``); false is certain.

    A bitmap of ``bits`` bits, in rows of 4 KB, is broadcast whatever the size of table (16 MB at most): where table is
    small it spares most rows the exchange of a join; where it is large more rows, or all, take it. Results don't depend on it.
    """
    place = F.pmod(F.xxhash64("_sha"), F.lit(bits)) + 1
    rows = table.select(place.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_words")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    rows = staged(rows, "bitmap")
    at = F.pmod(F.xxhash64(digest), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.pmod("_at", F.lit(1 << 15)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_at", at).join(F.broadcast(rows), F.floor(F.col("_at") / (1 << 15)) + 1 == F.col("_words"), "left")
    maybe = F.coalesce(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1, F.lit(False))
    return found.withColumn("_maybe", maybe).drop("_at", "_words", "_bits")


def keep_one(docs: DataFrame, gone: DataFrame, twins: DataFrame, digest: Column) -> DataFrame:
    """docs without the rows that others stand for. gone: their doc_id and text (``_id``, ``_sha``), some pairs each other's
    copies; twins: the pairs that stay and that several rows have, of which one stays. Both are staged tables.

    Only rows whose text may be in one of these are exchanged, by id and text, so no group of copies is one key.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), digest.alias("_digest"))
    rows = maybe_among(rows, F.col("_digest"), gone.select("_sha").unionByName(twins.select("_sha")))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    asked = rows.where("_maybe").join(gone.hint("merge"), same, "left_anti")
    if twins.limit(1).count():
        asked = asked.join(twins.hint("merge"), same, "left")
        asked = asked.where("_sha is null").unionByName(asked.where("_sha is not null").dropDuplicates(["_key", "_digest"]))
    return rows.where("not _maybe").select("_row.*").unionByName(asked.select("_row.*"))


def repeated_rows(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """The digests (``_sha``) that several rows with one key have, as a staged table; counts are added up in the tasks first."""
    several = rows.groupBy(key, digest).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return staged(several.select(F.col(digest).alias("_sha")).distinct(), "repeated")


def fold_repeats(rows: DataFrame, key: str, digest: str, twins: DataFrame) -> DataFrame:
    """rows with those that agree in key and digest as one, and ``times``, how many these were. twins: from ``repeated_rows``.

    Only rows whose digest may be among twins are exchanged, and a task folds its own before that: a row repeated a million
    times travels once a task. The other columns have to agree in such rows.
    """
    if not twins.limit(1).count():
        return rows.withColumn("times", F.lit(1).cast("long"))
    rows = maybe_among(rows, F.col(digest), twins)
    others = [c for c in rows.columns if c not in (key, digest, "_maybe")]
    once = rows.where("_maybe").groupBy(key, digest).agg(*[F.first(c).alias(c) for c in others], F.count(F.lit(1)).alias("times"))
    return rows.where("not _maybe").drop("_maybe").withColumn("times", F.lit(1).cast("long")).unionByName(once)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of edges (a long, b long): one row (node, root) a node, root its smallest node.

    Each round every node moves to its smallest neighbour, and on along that one's way; then edges are drawn between the
    places moved to. Edges within one place vanish, so a round works on what is not joined yet. The smallest node of a
    component never moves, and all others do until they are there. Rounds are written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    left = staged(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), f"{label}-edges")
    places = None
    while places is None or left.limit(1).count():
        both = left.toDF("node", "other").unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = staged(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("up")), f"{label}-up")
        for _ in range(2):
            on = up.select(F.col("node").alias("up"), F.col("up").alias("on"))
            up = up.join(on, "up").select("node", F.col("on").alias("up"))
        up = staged(up, f"{label}-up")
        if places is None:
            places = up.withColumnRenamed("up", "root")
        else:
            moved = places.join(up.select(F.col("node").alias("root"), "up"), "root", "left")
            places = staged(moved.select("node", F.coalesce("up", "root").alias("root")), f"{label}-places")
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = staged(ends.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"{label}-edges")
    return places
