"""Candidates of large tag tables: an index of exact pieces, joined to the reads and verified.

A form of d errors is cut into d + 1 pieces; a match within d errors has one of them unchanged, moved by as many bases as
there are insertions or deletions before it. So pieces are joined to what reads have at places where they may be, and
what surrounds a piece is compared with the whole form: a band of as many diagonals as indels are allowed, an expression.
Neighbourhoods are never made; the index has d + 1 rows a form. Forms that are too short to be cut are expanded.

Tags that come as a table (``Layer.listed``) never pass the driver. Those without indels are cut into more pieces, and each
key is a form without some of them: the more tags, the longer the keys, so what agrees by chance stays below the number of
keys, and the work grows with the reads and the tags, not with their product.

The join is by file, length and piece. A piece that many reads or many tags share is a skewed key, which adaptive
execution splits; reads travel as windows of a form's length around a piece, never whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandlake.functions.sequence import let, part
from strandlake.model import Layer, Pattern, forms, neighbours
from strandlake.operators.ordering import numbered
from strandlake.operators.scan import FLAT, PATTERN, pattern_rows, placed
from strandlake.sources.staging import staged

MOST_KEYS = 64  #: keys of a listed tag
_FORM = f"text string, mismatches int, indels int, total int, more int, base int, p {PATTERN}"


def form_table(df: DataFrame, layer: Layer, patterns: list[Pattern]) -> DataFrame:
    """A row a form: text, the errors it may have, what they count besides, the errors of the text itself, and its pattern."""
    rows = []
    for p, row in zip(patterns, pattern_rows(layer, patterns), strict=True):
        whole = [f for f in forms(p) if len(f.text) > f.total]
        rows += [{"text": f.text, "mismatches": f.mismatches, "indels": f.indels, "total": f.total, "more": f.more, "base": 0, "p": row} for f in whole]
        if len(whole) < len(forms(p)):
            sizes = {len(f.text) for f in whole}
            rows += [{"text": s, "mismatches": 0, "indels": 0, "total": 0, "more": 0, "base": e, "p": row} for s, e in neighbours(p).items() if s and (len(s) not in sizes or not (p.at_start or p.at_end))]
    schema = StructType.fromDDL(_FORM)
    return staged(df.sparkSession.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)), schema), "tag-forms")


def _pieces(table: DataFrame) -> DataFrame:
    """The index: a row a piece, with its form, offset (off), length (size) and the first and last place (lo, hi) in reads."""
    n, m = F.col("total") + 1, F.length("text")
    rows = table.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("total"))))
    rows = rows.withColumns({"off": F.floor(F.col("_i") * m / n).cast("int"), "_to": F.floor((F.col("_i") + 1) * m / n).cast("int")})
    rows = rows.select("*", (F.col("_to") - F.col("off")).alias("size"), part(F.col("text"), F.col("off"), F.col("_to") - F.col("off")).alias("piece"), F.col("p.file").alias("file"))
    free = (F.col("p.start") < 0) | F.col("p.at_end")
    lo = F.when(free, 0).otherwise(F.greatest(F.col("p.start") + F.col("off") - F.col("indels"), F.lit(0)))
    hi = F.when(free | ((F.col("p.end") == 0) & ~F.col("p.at_start")), 1 << 30).when(F.col("p.at_start"), m).otherwise(F.col("p.end"))
    return rows.select("file", "size", "piece", "off", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "text", "mismatches", "indels", "total", "more", "base", "p")


def _compared(most: int) -> Column:
    """array<struct<k, err>> of a form against the bases from a place on (``_bases``): all lengths within its errors."""
    a, b, m = F.split("text", ""), F.split("_bases", ""), F.length("text")
    none = 1 << 20

    def unlike(a: Column, i: Column, b: Column, j: Column) -> Column:
        return (F.get(a, i) != F.coalesce(F.get(b, j), F.lit(""))).cast("int")

    def band(long: Column, short: Column, n: Column) -> Column:
        """d[s]: differences after n letters of short, with s letters of long left out."""

        def step(d: Column, i: Column) -> Column:
            cells: list[Column] = []
            for s in range(most + 1):
                stay = d[f"d{s}"] + unlike(short, i, long, i + s)
                cells.append(stay if not s else F.least(stay, cells[-1]))
            return F.struct(*[c.alias(f"d{s}") for s, c in enumerate(cells)])

        return F.aggregate(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), F.struct(*[F.lit(0).alias(f"d{s}") for s in range(most + 1)]), step)

    def counted(size: Column, subs: Column, used: int) -> Column:
        exact = (subs == 0) & F.lit(used == 0)
        fits = (F.length("_bases") >= size) & (subs <= F.least(F.col("mismatches"), F.col("total") - used)) & (F.col("indels") >= used) & (size > 0)
        return F.struct(F.when(fits, size).otherwise(none).alias("k"), F.when(exact, F.col("base")).otherwise(F.lit(used) + subs + F.col("more")).alias("err"))

    def longer(d: Column) -> Column:
        return F.array(*[counted(m + s, d[f"d{s}"], s) for s in range(most + 1)])

    def bands(long: str, short: str, n: Column, found: Callable[[Column], Column]) -> Column:
        return let(let(F.struct(a.alias("a"), b.alias("b")), lambda x: band(x[long], x[short], n)), found)

    def shorter(s: int) -> Column:
        return F.array(bands("a", "b", F.greatest(m - s, F.lit(0)), lambda d: counted(m - s, d[f"d{s}"], s)))

    out = [bands("b", "a", m, longer), *[shorter(s) for s in range(1, most + 1)]]
    held = F.filter(F.flatten(F.array(*out)), lambda c: c["k"] < none)
    return F.filter(held, lambda c: (c["k"] <= m) | ~F.contains(part(F.col("_bases"), 0, c["k"]), F.col("text")))


def listed_forms(layer: Layer, first: int) -> DataFrame:
    """The tags of ``layer.listed``, numbered from first on in order of sequence: text, name, id. Written once."""
    tag, one = layer.listed_as, F.upper("seq")
    if tag is None or tag.min_finds or tag.partial5[0] or tag.partial3[0] or tag.revcomp or tag.file < 0 or tag.indels:
        raise ValueError("listed tags need rules of one file, without indels, partial ends, complements and least numbers")
    rows = numbered(layer.listed.select(one.alias("text"), "name").distinct(), ["text", "name"], "id", first).withColumn("id", F.col("id").cast("int"))
    fits = (F.length("text") <= tag.end - tag.start) if tag.end else F.lit(True)
    bad = rows.where(~F.coalesce(F.col("text").rlike("^[ACGT]+$") & fits & (F.length("text") > min(tag.mismatches, tag.total)), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].text!r} is no sequence of A, C, G and T, too short for its errors or too long for its location")
    return rows


def _kept_parts(m: int, errors: int, tags: int) -> list[list[tuple[int, int]]]:
    """The parts (from, to) of a form of m bases that each of its keys is made of: all but ``errors`` of some pieces, the fewest
    pieces that give keys with four times as many values as there are tags, as long as there are at most ``MOST_KEYS``."""
    best: list[list[tuple[int, int]]] = []
    for n in range(errors + 1, m + 1):
        if best and comb(n, errors) > MOST_KEYS:
            break
        cuts = [(i * m // n, (i + 1) * m // n) for i in range(n)]
        best = [[c for i, c in enumerate(cuts) if i not in gone] for gone in combinations(range(n), errors)]
        if 4 ** min(sum(b - a for a, b in k) for k in best) >= 4 * tags:
            break
    return best


def listed_candidates(reads: DataFrame, layer: Layer, first: int) -> DataFrame:
    """_uid, file, pos, k, err, p: where reads (_uid, _seqs) have tags of ``layer.listed``."""
    tag, table = layer.listed_as, listed_forms(layer, first)
    errors = min(tag.mismatches, tag.total)
    keys = {r.m: _kept_parts(r.m, errors, r.n) for r in table.groupBy(F.length("text").alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length

    def keyed(text: str, m: Column) -> Column:
        """(key, nth) of a text as long as a form; nth also tells lengths apart."""
        out = F.array().cast("array<struct<key:string,nth:int>>")
        for size, parts in keys.items():
            each = F.array(*[F.struct(F.concat(*[part(F.col(text), a, b - a) for a, b in kept]).alias("key"), F.lit(size * (MOST_KEYS + 1) + i).alias("nth")) for i, kept in enumerate(parts)])
            out = F.when(m == size, each).otherwise(out)
        return F.inline(out)

    if not keys:
        return reads.select("_uid", F.explode(F.array().cast(FLAT)).alias("c")).select("_uid", "c.*")
    lo, hi = (0 if tag.start < 0 else tag.start), (1 << 30 if tag.start < 0 or not tag.end else tag.end)
    seq = F.coalesce(F.get("_seqs", F.lit(tag.file)), F.lit(""))
    each = reads.select("_uid", seq.alias("_seq"), F.length(seq).alias("length"), F.explode(F.array(*map(F.lit, keys))).alias("k"))
    last = F.least(F.col("length"), F.lit(hi)) - F.col("k")
    each = each.where(last >= lo).withColumn("pos", F.explode(F.sequence(F.lit(lo), last)))
    each = each.select("_uid", "length", "k", "pos", part(F.col("_seq"), F.col("pos"), F.col("k")).alias("_bases"))
    found = each.select("*", keyed("_bases", F.col("k"))).join(table.select("*", keyed("text", F.length("text"))), ["nth", "key"])
    unlike = F.zip_with(F.split("text", ""), F.split("_bases", ""), lambda a, b: (a != b).cast("int"))
    found = found.withColumn("err", F.aggregate(unlike, F.lit(0), lambda n, x: n + x)).where(F.col("err") <= errors)
    (rule,) = pattern_rows(layer, [Pattern(0, tag, "", "" if tag.sub == "." else tag.sub, tag.file, tag.end)])
    p = F.from_json(F.lit(json.dumps(rule | {"most": tag.max_finds or None})), PATTERN)
    p = p.withField("id", F.col("id")).withField("name", F.col("name")).withField("seq", F.col("text"))
    p = p.withField("sub", F.col("text")) if tag.sub == "." else p
    found = found.select("_uid", F.lit(tag.file).alias("file"), "pos", "k", "err", p.alias("p"), "length")
    return found.where(placed(F.col("p"), F.col("pos"), F.col("k"), F.col("length"))).drop("length")


def seed_candidates(reads: DataFrame, layer: Layer, patterns: list[Pattern]) -> DataFrame:
    """_uid, _flat: the sorted candidates of reads (_uid, _seqs) that have any."""
    one = F.struct("file", "pos", "k", "err", "p")
    found = [pieced_candidates(reads, layer, patterns)] if patterns else []
    found += [listed_candidates(reads, layer, len(patterns))] if layer.listed is not None else []
    rows = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    return rows.groupBy("_uid").agg(F.sort_array(F.collect_set(one)).cast(FLAT).alias("_flat"))


def pieced_candidates(reads: DataFrame, layer: Layer, patterns: list[Pattern]) -> DataFrame:
    """_uid, file, pos, k, err, p: where reads (_uid, _seqs) have one of the patterns."""
    index = staged(_pieces(form_table(reads, layer, patterns)), "tag-pieces")
    spans = index.groupBy("file", "size").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row a length of pieces
    bound = index.agg(F.max(F.length("text") + F.col("indels")).alias("span"), F.max("indels").alias("indels")).first()
    if not spans:
        return reads.select("_uid", F.explode(F.array().cast(FLAT)).alias("c")).select("_uid", "c.*")
    where = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("file", "size", "lo", "hi")]) for r in spans])
    each = reads.select("_uid", "_seqs", F.explode(where).alias("s")).select("_uid", F.coalesce(F.get("_seqs", F.col("s.file")), F.lit("")).alias("_seq"), "s.*")
    last = F.least(F.length("_seq"), F.col("hi")) - F.col("size")
    each = each.where(last >= F.col("lo")).select("_uid", "file", "size", F.length("_seq").alias("length"), "_seq", F.explode(F.sequence("lo", last)).alias("at"))
    begin = F.greatest(F.col("at") - bound.span, F.lit(0))
    windows = each.select("_uid", "file", "size", "length", "at", part(F.col("_seq"), F.col("at"), F.col("size")).alias("piece"), begin.alias("_from"), part(F.col("_seq"), begin, F.col("at") - begin + F.lit(2 * bound.span)).alias("_window"))
    found = windows.join(index, ["file", "size", "piece"]).where((F.col("at") >= F.col("lo")) & (F.col("at") + F.col("size") <= F.col("hi")))
    moved = F.explode(F.sequence(-F.col("indels"), F.col("indels"))) if bound.indels else F.lit(0)
    found = found.withColumn("_moved", moved).withColumn("pos", F.col("at") - F.col("off") + F.col("_moved")).where("pos >= 0 and pos >= _from")
    found = found.withColumn("_bases", part(F.col("_window"), F.col("pos") - F.col("_from"), F.length("text") + F.col("indels")))
    found = found.select("_uid", "file", "length", "pos", "p", F.explode(_compared(bound.indels)).alias("c"))
    found = found.where(placed(F.col("p"), F.col("pos"), F.col("c.k"), F.col("length")))
    return found.select("_uid", "file", "pos", F.col("c.k").alias("k"), F.col("c.err").alias("err"), "p")


def with_candidates(df: DataFrame, layer: Layer, patterns: list[Pattern]) -> DataFrame:
    """df with ``_flat``. df is written once, with a number for each row, as it is read twice."""
    if df.isStreaming:
        raise ValueError("a stream takes tag tables whose neighbourhoods are small")
    rows = staged(df.withColumn("_uid", F.monotonically_increasing_id()), "reads-scanned")
    found = seed_candidates(rows.select("_uid", "_seqs"), layer, patterns)
    return rows.join(found, "_uid", "left").withColumn("_flat", F.coalesce("_flat", F.array().cast(FLAT))).drop("_uid")
