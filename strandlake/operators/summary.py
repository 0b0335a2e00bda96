"""Reports on processed reads: counts, lengths, trims, tags, extractions. All are grouped sums with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.model import Layer, expand
from strandlake.sources.staging import staged


def counts(df: DataFrame) -> DataFrame:
    """n_processed, n_assigned, n_filtered, n_filtered_assigned."""
    strict = F.col("assigned") & ~F.col("discard")
    return df.agg(
        F.count(F.lit(1)).alias("n_processed"), F.count_if(strict).alias("n_assigned"), F.count_if(~F.col("passes")).alias("n_filtered"), F.count_if(strict & ~F.col("passes")).alias("n_filtered_assigned")
    )


def lengths(df: DataFrame) -> DataFrame:
    """By file: mean, least and greatest length of all reads before, and of assigned reads after."""
    strict = F.col("assigned") & ~F.col("discard")
    rows = df.select(strict.alias("ours"), F.posexplode("cuts").alias("file", "c"))
    after = F.when(F.col("ours"), F.col("c.written"))
    return rows.groupBy("file").agg(
        F.avg("c.before").alias("mean_before"), F.min("c.before").alias("min_before"), F.max("c.before").alias("max_before"), F.avg(after).alias("mean_after"), F.min(after).alias("min_after"), F.max(after).alias("max_after")
    )


def trims(df: DataFrame) -> DataFrame:
    """By file: reads and bases cut at either end, hard and by quality, of all reads and of assigned ones.

    Cuts of all kinds count together, each read once; quality trims are shown by themselves too.
    """
    strict = F.col("assigned") & ~F.col("discard")
    rows = df.select(strict.alias("ours"), F.posexplode("cuts").alias("file", "c"))
    five = F.col("c.five")
    three = F.col("c.before") - F.col("c.after") - five
    out = []
    for name, bases in (("5", five), ("3", three), ("quality_5", F.col("c.qual5")), ("quality_3", F.col("c.qual3"))):
        for suffix, cond in (("", F.lit(True)), ("_assigned", F.col("ours"))):
            out += [F.sum(F.when(cond, bases).otherwise(0)).alias(f"bases_{name}{suffix}"), F.count_if(cond & (bases > 0)).alias(f"reads_{name}{suffix}")]
    return rows.groupBy("file").agg(*out)


def trimming_tags(df: DataFrame) -> DataFrame:
    """By tag and length of the match: reads, errors, bases cut to the left and right. The hits that decide on a cut count."""

    def chosen(side: str) -> DataFrame:
        mine = F.filter("hits", lambda h: h[side].isNotNull())
        files = F.array_distinct(F.transform(mine, lambda h: h.file))
        hits = F.transform(files, lambda f: F.element_at(F.filter(mine, lambda h: h.file == f), -1 if side == "left" else 1))
        cut = F.element_at("cuts", F.col("h.file") + 1)["tag5" if side == "left" else "tag3"]
        cuts = [(cut if s == side else F.lit(0)).alias(f"cut_{s}") for s in ("left", "right")]
        return df.select("cuts", F.explode(hits).alias("h")).select("h.name", (F.col("h.end") - F.col("h.start")).alias("match_length"), "h.err", *cuts)

    rows = [chosen("left"), chosen("right")]
    return rows[0].unionByName(rows[1]).groupBy("name", "match_length").agg(F.count(F.lit(1)).alias("reads"), F.sum("err").alias("errors"), F.sum("cut_left").alias("cut_left"), F.sum("cut_right").alias("cut_right"))


def extraction_lengths(df: DataFrame, layer: Layer) -> DataFrame:
    """By extraction name: number, mean, least and greatest length of what assigned reads gave."""
    names = F.array(*map(F.lit, layer.names))
    rows = df.where(F.col("assigned") & ~F.col("discard")).select(F.explode(F.arrays_zip(names.alias("name"), F.col("umis.value").alias("value"))).alias("u")).where("u.value <> ''")
    n = F.length("u.value")
    return rows.groupBy("u.name").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.min(n).alias("least"), F.max(n).alias("greatest"))


def tag_errors(df: DataFrame, layer: Layer) -> DataFrame:
    """tag, distance (3 for 3 or more), n, zeros included: hits in reads with tags that are not sorted out."""
    found = df.where((F.size("names") > 0) & ~F.col("discard")).select(F.explode("hits").alias("h")).groupBy(F.col("h.name").alias("tag"), F.least(F.col("h.err"), F.lit(3)).alias("distance")).agg(F.count(F.lit(1)).alias("n"))
    names = list(dict.fromkeys(t.name for t in layer.tags))
    grid = df.sparkSession.createDataFrame([(n, d) for n in names for d in range(4)], "tag string, distance int")
    return grid.join(found, ["tag", "distance"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def tag_table(layer: Layer) -> dict[str, int]:
    e = expand(layer)
    return {"n_tags": len(e.patterns), "n_names": len({t.name for t in layer.tags}), "n_groups": len({t.group for t in layer.tags if t.group}), "n_kmers": len(e.kmers), "n_extractions": len(layer.names)}


def as_json(df: DataFrame, layer: Layer) -> DataFrame:
    """One row, one column: the whole report as JSON. Each part is bounded by files, tags or names, not by reads. What the
    parts need is written once, so the layer runs once."""
    df = staged(df.select("hits", "names", "umis", "assigned", "discard", "passes", "cuts"), "report")
    parts = {"lengths": lengths(df).orderBy("file"), "trims": trims(df).orderBy("file"), "extractions": extraction_lengths(df, layer).orderBy("name"), "tag_qc": tag_errors(df, layer).orderBy("tag", "distance"), "tag_trims": trimming_tags(df).orderBy("name", "match_length")}
    out = counts(df)
    columns = [F.col(c) for c in out.columns]
    for name, part in parts.items():
        rows = part.select(F.to_json(F.struct(*part.columns)).alias("j")).collect()
        columns.append(F.from_json(F.lit("[" + ",".join(r.j for r in rows) + "]"), part.schema.simpleString().join(("array<", ">"))).alias(name))
    table = F.struct(*[F.lit(v).alias(k) for k, v in tag_table(layer).items()]).alias("tag_table")
    return out.select(F.to_json(F.struct(*columns, table)).alias("summary"))
