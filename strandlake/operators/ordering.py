"""Numbers by order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.staging import staged


def numbered(df: DataFrame, order: list[str], into: str, start: int = 0) -> DataFrame:
    """df with the place of each row in the given order, from start on: rows are dealt by range and counted by part.

    The dealt rows are written once: another run of the exchange need not have the same partitions (bounds are sampled, and
    partitions coalesced by bytes).
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(dealt.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_nth").alias("low")).orderBy("_part").collect()  # a row a partition
    offsets, at = [], start
    for part, rows, low in sizes:
        offsets.append((part, at - low))
        at += rows
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return placed.join(F.broadcast(table), "_part").withColumn(into, F.col("_nth") + F.col("_offset")).drop("_part", "_nth", "_offset")


SPAN = 1 << 20


def running(df: DataFrame, keys: list[str], span: Column, order: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running values along an order within keys, by ranges: no task goes over more than one range of a key.

    span numbers the ranges and rises with the order. columns: name -> (kind, value). Kinds: ``sum`` and ``max`` of the rows up
    to this one, ``before`` the max of the rows before it, ``last`` the last value up to it that is not null, ``prior`` the
    value of the row before. Ranges are summed up first, and what comes before a range is carried into it: a row a range.
    df is written once, as it is read twice.
    """
    df = staged(df.withColumn("_span", span), "ranges")
    place = F.struct(*order)
    whole = {"sum": F.sum, "max": F.max, "before": F.max, "prior": lambda v: F.max_by(F.struct(v.alias("v")), place)["v"], "last": lambda v: F.max_by(v, F.when(v.isNotNull(), place))}
    totals = df.groupBy(*keys, "_span").agg(*[whole[kind](v).alias(f"_{n}") for n, (kind, v) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    over = {"sum": F.sum, "max": F.max, "before": F.max, "last": lambda v: F.last(v, ignorenulls=True), "prior": F.last}
    carried = totals.select(*keys, "_span", *[over[kind](F.col(f"_{n}")).over(earlier).alias(f"_{n}") for n, (kind, _) in columns.items()])
    within = Window.partitionBy(*keys, "_span").orderBy(*order)
    upto, ahead = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(within) == 1
    out = df.join(carried, [*keys, "_span"])
    values = {}
    for n, (kind, v) in columns.items():
        old = F.col(f"_{n}")
        values[n] = {
            "sum": lambda v=v, old=old: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.coalesce(old, F.lit(0)), "max": lambda v=v, old=old: F.greatest(F.max(v).over(upto), old),
            "before": lambda v=v, old=old: F.greatest(F.max(v).over(ahead), old), "last": lambda v=v, old=old: F.coalesce(F.last(v, ignorenulls=True).over(upto), old),
            "prior": lambda v=v, old=old: F.when(first, old).otherwise(F.lag(v).over(within)),
        }[kind]()
    return out.withColumns(values).drop("_span", *[f"_{n}" for n in columns])


def spans(at: str) -> Column:
    """Ranges of ``SPAN`` places."""
    return F.floor(F.col(at) / SPAN)
