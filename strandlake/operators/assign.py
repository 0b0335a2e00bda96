"""Reads to barcodes: dense ids of tag lists by first appearance, lists to keep and remove, and ids that need no shuffle."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import barcode
from strandlake.model import Layer, patterns_of
from strandlake.operators.ordering import numbered


#: lists up to this number are an expression; more are a table that is joined, and broadcast up to BROADCAST lists
LITERALS, BROADCAST = 200, 1_000_000


def looked_up(df: DataFrame, names: str, lists, into: str) -> DataFrame:
    """df with the prefix of the list in names: null where it is none of lists, empty where it has no prefix."""
    table = {_key(n): (lists[n] or "" if isinstance(lists, dict) else "") for n in lists}
    if len(table) <= LITERALS:
        if not table:
            return df.withColumn(into, F.lit(None).cast("string"))
        pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return df.withColumn(into, F.element_at(pairs, joined_key(F.col(names))))
    rows = df.sparkSession.createDataFrame(pa.table({"_list": pa.array(list(table)), into: pa.array(list(table.values()))}))
    rows = F.broadcast(rows) if len(table) <= BROADCAST else rows
    return df.withColumn("_at", joined_key(F.col(names))).join(rows, F.col("_at") == F.col("_list"), "left").drop("_at", "_list")


def _key(names: tuple[str, ...]) -> str:
    return "\x1f".join(names)


def joined_key(names: Column) -> Column:
    return F.array_join(names, "\x1f")


def first_appearance(df: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, id, n): ids 0, 1, ... of the distinct keys by the smallest read_id of each; known (key, id) come first.

    Keys are counted before the exchange, so a key with most of all rows is one row a task. The distinct keys are ordered
    by range and counted by part, so no task numbers all of them.
    """
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("read_id").alias("first"), F.count(F.lit(1)).alias("n"))
    start = 0
    if known is not None:
        top = known.agg(F.max("id")).first()[0]
        start = 0 if top is None else top + 1
        old = known.join(found, key, "left").select(key, "id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        found = found.join(known, key, "left_anti")
    new = numbered(found, ["first"], "id", start).select(key, "id", "n")
    return new if known is None else old.unionByName(new)


def with_ids(df: DataFrame, key: str, ids: DataFrame, into: str) -> DataFrame:
    """df with the id of each key. Rows without a key are kept out of the join, where they would be one key; the join is
    left to Spark, which broadcasts by size and splits skewed partitions."""
    found = df.where(F.col(key).isNotNull()).join(ids.select(F.col(key).alias("_key"), F.col("id").alias(into)), F.col(key) == F.col("_key"), "left").drop("_key")
    return found.unionByName(df.where(F.col(key).isNull()).withColumn(into, F.lit(None).cast("long")))


def radix_table(layer: Layer, groups: list[str]) -> dict[str, tuple[int, dict[str, int]]]:
    """group -> (number of values, tag name -> value from 1 on), for codes of mixed radix."""
    out: dict[str, tuple[int, dict[str, int]]] = {}
    for p in patterns_of(layer):
        g = p.tag.group
        if g in groups and not (p.at_start or p.at_end):
            _, values = out.setdefault(g, (1, {}))
            values.setdefault(p.tag.name, len(values))
            out[g] = (out[g][0] + 1, values)
    return out


def radix_rows(layer: Layer, groups: list[str]) -> list[tuple[str, str, int, int]]:
    """(group, tag, number of values, weight) of each place of a code."""
    table, weight, out = radix_table(layer, groups), 1, []
    for g in groups:
        domain, values = table[g]
        out += [(g, name, domain, weight) for name in values]
        weight *= domain
    return out


def radix_id(layer: Layer, groups: list[str], names: Column, found: Column) -> Column:
    """The code of a read whose group list is exactly ``groups``, else null. One pass, no shuffle."""
    table, weight, terms = radix_table(layer, groups), 1, []
    for i, g in enumerate(groups):
        domain, values = table[g]
        place = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
        terms.append(F.element_at(place, F.element_at(names, i + 1)).cast("long") * weight)
        weight *= domain
    return F.when(joined_key(found) == _key(tuple(groups)), reduce(lambda a, b: a + b, terms))


def picked(names: Column, places: list[int]) -> Column:
    """The names at some places, up to the first place that is not there; null if there are none."""
    size = F.size(names)
    here = F.filter(F.array(*[F.lit(p) for p in places]), lambda p: p < size)
    return F.when(F.size(here) > 0, F.transform(here, lambda p: F.element_at(names, p + 1)))


def mapping(ids: DataFrame, key: str, length: int, prefix: str = "") -> DataFrame:
    """The barcode table: barcode, names, n, in order of id."""
    return ids.select("id", barcode(F.col("id"), length, prefix).alias("barcode"), F.array_join(key, ",").alias("names"), "n").orderBy("id")


def known_mapping(spark: SparkSession, path: str, length: int, prefix: str = "") -> DataFrame:
    """(names, id) of a written mapping, to go on from; its ids have to be 0, 1, ... in order and of this length and prefix."""
    rows = spark.read.option("sep", "\t").schema("barcode string, names string, n long").csv(path)
    bases = F.col("barcode").substr(F.lit(len(prefix) + 1), F.length("barcode"))
    ids = rows.select(F.split("names", ",").alias("names"), F.conv(F.translate(bases, "ACGT", "0123"), 4, 10).cast("long").alias("id"), "barcode")
    bad = ids.where((F.length("barcode") != length + len(prefix)) | ~F.col("barcode").startswith(prefix) | F.col("id").isNull())
    seen = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.max("id").alias("top")).first()
    if bad.limit(1).count() or (seen.n and (seen.d != seen.n or seen.top != seen.n - 1)):
        raise ValueError(f"{path} is no mapping of barcodes of {length} bases with ids from 0 on")
    return ids.select("names", "id")


def remultiplexed(spark: SparkSession, lines: list[str]) -> list[tuple[str, int, list[str]]]:
    """(name, dense number, files) of the lines ``name file file ...``; one name has one number, by first appearance."""
    rows = [s.split() for s in lines if s.strip() and not s.startswith("#")]
    numbers: dict[str, int] = {}
    return [(r[0], numbers.setdefault(r[0], len(numbers)), r[1:]) for r in rows]


def remultiplex_mapping(spark: SparkSession, rows: list[tuple[str, int, list[str]]], length: int, prefix: str = "") -> DataFrame:
    """(id, barcode, name) of what ``remultiplexed`` gives, a row a name."""
    names = {number: name for name, number, _ in rows}
    table = spark.createDataFrame(sorted(names.items()), "id long, name string")
    return table.select("id", barcode(F.col("id"), length, prefix).alias("barcode"), "name")
