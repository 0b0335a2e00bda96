"""A layer as one transformation of reads: cut, scan, extract, edit, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import filler, found_in_name, normalised, part, quality_cuts
from strandlake.model import Layer
from strandlake.operators import assign
from strandlake.operators.edit import inserted, substituted, tag_cuts
from strandlake.operators.extract import extractions
from strandlake.operators.scan import with_found
from strandlake.sources.staging import staged

#: what a layer adds to read_id, run_id, segs and head (the names of the segments so far)
ADDED = ("hits", "names", "groups", "umis", "assigned", "discard", "passes", "out", "ofile", "key", "id", "sub_id", "cuts")


def settled(df: DataFrame) -> DataFrame:
    """df, with its columns worked out here once: a later filter isn't moved below, where it would repeat what they are made of.

    A generator of one row a row does that: the optimizer carries no expression on its output across it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def run_layer(reads: DataFrame, layer: Layer, known: DataFrame | None = None, ids: bool = True, only: tuple[str, ...] = ADDED) -> DataFrame:
    """reads with the columns of ADDED, or those of them in ``only``: what other columns need is not made.

    names: the ordered list of tags; out: the segments as they are to be written; assigned: whether the read has a barcode
    (or, if the layer doesn't assign, passes); discard: it was sorted out; passes: it is not too short or long. With
    ``ids`` and ``layer.assign`` the barcode ids are worked out: by codes if the layer encodes, else by first appearance,
    which counts all lists and joins the numbers back.
    """
    n = layer.n_files
    df = reads
    segs = [F.element_at("segs", j + 1) for j in range(n)]
    pick = lambda xs, j: xs[j] if j < len(xs) else 0
    cols: dict[str, Column] = {}
    for j, s in enumerate(segs):
        cols[f"_s{j}"] = s.seq
        cols[f"_q{j}"] = F.coalesce(s.qual, filler(F.length(s.seq)))
    df = df.withColumns(cols)
    # hard trim, then the quality trim if it goes before the scan
    cols = {}
    for j in range(n):
        a = F.least(F.lit(pick(layer.trim5, j)), F.length(f"_s{j}"))
        keep = F.greatest(F.length(f"_s{j}") - a - pick(layer.trim3, j), F.lit(0))
        cols |= {f"_a{j}": a, f"_s{j}_": part(F.col(f"_s{j}"), a, keep), f"_q{j}_": part(F.col(f"_q{j}"), a, keep)}
    df = df.withColumns(cols)
    trims = layer.qtrim5 or layer.qtrim3

    def quality_trimmed(df: DataFrame, seq: str, qual: str) -> DataFrame:
        cols = {}
        for j in range(n):
            l5, l3 = quality_cuts(F.col(seq.format(j)), F.col(qual.format(j)), layer.qtrim, layer.qtrim5, layer.qtrim3, layer.qtrim_naive, layer.phred64)
            cols |= {f"_l5{j}": l5, f"_l3{j}": l3}
        df = df.withColumns(cols)
        cols = {}
        for j in range(n):
            a = F.least(F.col(f"_l5{j}"), F.length(seq.format(j)))
            keep = F.greatest(F.length(seq.format(j)) - a - F.col(f"_l3{j}"), F.lit(0))
            cols |= {seq.format(j): part(F.col(seq.format(j)), a, keep), qual.format(j): part(F.col(qual.format(j)), a, keep), f"_l5{j}": a}
        return df.withColumns(cols)

    if trims and layer.qtrim_pre:
        df = quality_trimmed(df, "_s{}_", "_q{}_")
        df = df.withColumns({f"_a{j}": F.col(f"_a{j}") + F.col(f"_l5{j}") for j in range(n)})
    df = settled(df.select(*reads.columns, *[f"{c}{j}{e}" for j in range(n) for c, e in (("_s", ""), ("_q", ""), ("_a", ""), ("_s", "_"), ("_q", "_"))], *[f"{c}{j}" for j in range(n) for c in ("_l5", "_l3") if trims and layer.qtrim_pre]))
    df = df.withColumns({"_seqs": F.array(*[normalised(F.col(f"_s{j}_")) for j in range(n)]), "_quals": F.array(*[F.col(f"_q{j}_") for j in range(n)])})
    if layer.tags or layer.listed is not None:
        df = with_found(settled(df), layer)
    else:
        df = df.withColumns({"hits": F.array().cast(_hits_type()), "_unmet": F.lit(False)})
    df = settled(df)
    # extraction
    given = [_placed(p, segs) for p in layer.placements[::-1] if p.pos == -1]  # the last listed comes first
    df = df.withColumn("umis", extractions(layer, F.col("hits"), F.col("_seqs"), F.col("_quals"), given) if layer.extracts and "umis" in only else F.array().cast("array<struct<value:string,qual:string>>"))
    # tag trim, then the quality trim if it goes after the scan
    cols = {}
    for j in range(n):
        left, right = tag_cuts(F.col("hits"), j, F.length(f"_s{j}_"))
        cols |= {f"_b{j}": left, f"_c{j}": right}
    df = df.withColumns(cols)
    cols = {}
    for j in range(n):
        keep = F.greatest(F.length(f"_s{j}_") - F.col(f"_b{j}") - F.col(f"_c{j}"), F.lit(0))
        cols |= {f"_t{j}": part(F.col(f"_s{j}_"), F.col(f"_b{j}"), keep), f"_u{j}": part(F.col(f"_q{j}_"), F.col(f"_b{j}"), keep)}
    df = df.withColumns(cols)
    if trims and not layer.qtrim_pre:
        df = quality_trimmed(df, "_t{}", "_u{}")
    df = settled(df)
    passes = F.lit(True)
    for j, (lo, hi) in enumerate(layer.filter_len[:n]):
        passes = passes & (F.length(f"_t{j}") >= lo if lo else F.lit(True)) & (F.length(f"_t{j}") <= hi if hi else F.lit(True))
    df = df.withColumn("passes", passes)
    # decisions
    listed = F.filter("hits", lambda h: h.listed)
    df = df.withColumns({
        "groups": F.transform(listed, lambda h: h.group),
        "names": F.when(F.col("_unmet"), F.array().cast("array<string>")).otherwise(F.transform(listed, lambda h: h["name"])),
    })
    some = F.size("names") > 0
    discard = F.lit(False) if layer.assign else F.col("_unmet")
    discard = discard | (~some & F.lit(bool(layer.keep or layer.keep_group)))
    out, prefix = F.lit(False), []
    for lists, of, keeps in ((layer.keep, "names", True), (layer.remove, "names", False), (layer.keep_group, "groups", True), (layer.remove_group, "groups", False)):
        if lists:
            found = f"_{'kept' if keeps else 'removed'}_{of}"
            df = assign.looked_up(df, of, lists, found)
            out = out | (F.col(found).isNull() if keeps else F.col(found).isNotNull())
            prefix += [F.nullif(F.col(found), F.lit(""))] if keeps else []
    df = df.withColumns({"discard": discard | (some & out), "ofile": F.when(some, F.coalesce(*prefix)) if prefix else F.lit(None).cast("string")})
    df = df.withColumns({"id": F.lit(None).cast("long"), "sub_id": F.lit(None).cast("long")})
    if layer.encode:
        df = df.withColumn("id", F.when(some & ~F.col("discard"), assign.radix_id(layer, layer.encode, F.col("names"), F.col("groups"))))
        if layer.sub_encode:
            at = [layer.encode.index(g) for g in layer.sub_encode]
            sub_names = F.array(*[F.get("names", F.lit(i)) for i in at])
            sub_groups = F.array(*[F.get("groups", F.lit(i)) for i in at])
            df = df.withColumn("sub_id", F.when(F.col("id").isNotNull(), assign.radix_id(layer, layer.sub_encode, sub_names, sub_groups)))
        df = df.withColumn("discard", F.col("discard") | (some & F.col("id").isNull()))
    strict = ~F.col("discard") & some
    df = df.withColumn("assigned", strict if layer.assign else F.lit(True))
    df = settled(df.withColumn("key", F.when(strict, F.col("names"))))
    if "out" not in only and "cuts" not in only:
        return _numbered(df.select(*reads.columns, *only, *(["key"] if "key" not in only else []), *(["names"] if "names" not in only else [])), reads, layer, known, ids, only)
    # what is written: cut and substituted reads where they are assigned, else as they came
    cols = {}
    for j in range(n):
        shift = F.col(f"_b{j}") + (F.col(f"_l5{j}") if trims and not layer.qtrim_pre else F.lit(0))
        seq, qual = substituted(F.col("hits"), j, F.col(f"_t{j}"), F.col(f"_u{j}"), shift)
        cols |= {f"_x{j}": F.when(F.col("assigned"), seq).otherwise(F.col(f"_s{j}")), f"_y{j}": F.when(F.col("assigned"), qual).otherwise(F.col(f"_q{j}"))}
    df = df.withColumns(cols)
    outs = []
    for j, s in enumerate(segs):
        values = [(p.pos, _placed(p, segs)) for p in layer.placements if p.pos != -1 and p.output_file == j]
        seq, qual = inserted(F.col(f"_x{j}"), F.col(f"_y{j}"), values)
        outs.append(F.struct(s["name"].alias("name"), s.comment.alias("comment"), seq.alias("seq"), qual.alias("qual")))
    cuts = [
        F.struct(
            F.length(f"_s{j}").alias("before"), F.length(f"_t{j}").alias("after"), F.col(f"_a{j}").alias("hard5"), F.length(f"_s{j}_").alias("scanned"), F.col(f"_b{j}").alias("tag5"),
            F.col(f"_c{j}").alias("tag3"), (F.col(f"_l5{j}") if trims else F.lit(0)).alias("qual5"), (F.col(f"_l3{j}") if trims else F.lit(0)).alias("qual3"), F.length(f"_x{j}").alias("written"),
            (F.col(f"_a{j}") + F.col(f"_b{j}") + (F.col(f"_l5{j}") if trims and not layer.qtrim_pre else F.lit(0))).alias("five"),
        )
        for j in range(n)
    ]
    df = df.withColumns({"out": F.array(*outs), "cuts": F.array(*cuts)})
    return _numbered(settled(df.select(*reads.columns, *ADDED)), reads, layer, known, ids, only)


def _numbered(df: DataFrame, reads: DataFrame, layer: Layer, known: DataFrame | None, ids: bool, only: tuple[str, ...]) -> DataFrame:
    """df with the ids by first appearance, where they are asked for. The layer's output is written once: keys are counted
    in one pass over it and ids joined in another, the layer itself runs once."""
    ids = ids and layer.assign and not layer.encode
    sub = ids and bool(layer.sub_assign) and "sub_id" in only
    if ids and ("id" in only or sub):
        if sub:
            df = df.withColumn("_sub", F.when(F.col("key").isNotNull(), assign.picked(F.col("names"), layer.sub_assign)))
        df = staged(df, "layer")
        if "id" in only:
            df = assign.with_ids(df.drop("id"), "key", assign.first_appearance(df.select("read_id", "key"), "key", known), "id")
        if sub:
            df = assign.with_ids(df.drop("sub_id"), "_sub", assign.first_appearance(df.select("read_id", "_sub"), "_sub"), "sub_id")
    return df.select(*reads.columns, *only)


def _placed(p, segs: list[Column]) -> Column:
    return F.lit(p.fixed) if p.fixed is not None else F.coalesce(found_in_name(segs[p.file].comment, p.pattern), F.lit(""))


def _hits_type() -> str:
    from strandlake.operators.scan import FOUND

    return FOUND["hits"].dataType.simpleString()
