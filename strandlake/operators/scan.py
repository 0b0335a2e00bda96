"""Error-tolerant scan for tags: which patterns are in a read, in order, under rules on place, neighbours and number.

``candidates`` is the join of a read's k-mers with the patterns' neighbourhood: relational, for layers and reports that
need no order. ``with_found`` is the ordered greedy scan, where state runs from hit to hit (what came before, what has to
come next, how many are left). It is a fold over the sorted candidates of a read, an expression of the engine. Where the
candidates come from depends on the tag table: a neighbourhood of up to ``LITERAL_KMERS`` k-mers is a constant table of
buckets by CRC-32, looked up at each place of a read within one row, without any exchange; a larger one is never made:
``seeds`` joins exact pieces of the tags to the reads and verifies what they find. Both give the same candidates.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.sequence import let, part
from strandlake.model import Expanded, Layer, Neighbour, Pattern, expand, forms, most_neighbours, patterns_of

HIT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("group", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("sub", T.StringType()),
    T.StructField("file", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("err", T.IntegerType()),
    T.StructField("listed", T.BooleanType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("pattern", T.IntegerType()),
])
LITERAL_KMERS, BROADCAST_KMERS = 4096, 1_000_000
BLOCK = 256  # places of a long read that are looked up together
_NEIGHBOUR = "struct<name:string,is_group:boolean,lo:int,hi:int>"
#: a pattern with its rules: least and most are the numbers for its name, least_group and most_group those for its group
PATTERN = (
    "struct<id:int,name:string,group:string,seq:string,sub:string,file:int,start:int,end:int,at_start:boolean,at_end:boolean,opens:boolean,closes:boolean,listed:boolean,left:int,right:int,"
    f"after:{_NEIGHBOUR},before:{_NEIGHBOUR},counts:boolean,limited:boolean,least:int,most:int,least_group:int,most_group:int>"
)
FLAT = f"array<struct<file:int,pos:int,k:int,err:int,p:{PATTERN}>>"
FOUND = T.StructType([T.StructField("hits", T.ArrayType(HIT)), T.StructField("unmet", T.BooleanType())])


def place_spans(layer: Layer, e: Expanded) -> list[list[tuple[int, int, int]]]:
    """Of each file, by length of k-mers: (k, first start, last end or a large number)."""
    out = []
    for file in range(layer.n_files):
        found: dict[int, tuple[int, int]] = {}
        for kmer, patterns in e.kmers.items():
            for i, _ in patterns:
                p = e.patterns[i]
                if p.file == file:
                    lo, hi = found.get(len(kmer), (1 << 30, -1))
                    found[len(kmer)] = (min(lo, max(p.tag.start, 0)), 1 << 30 if not p.end or p.tag.start < 0 else max(hi, p.end))
        out.append([(k, *s) for k, s in sorted(found.items())])
    return out


def pattern_rows(layer: Layer, patterns: list[Pattern]) -> list[dict]:
    """Patterns as rows of ``PATTERN``."""
    least = {t.name: t.min_finds for t in layer.tags if t.min_finds}
    most = {t.name: t.max_finds for t in layer.tags if t.max_finds}

    def near(n: Neighbour | None) -> dict | None:
        return n and {"name": n.name, "is_group": n.is_group, "lo": n.lo, "hi": n.hi}

    def row(p: Pattern) -> dict:
        t, g = p.tag, p.tag.group
        return {
            "id": p.id, "name": t.name, "group": g, "seq": p.seq, "sub": p.sub, "file": p.file, "start": t.start, "end": p.end, "at_start": p.at_start, "at_end": p.at_end, "opens": p.opens, "closes": p.closes,
            "listed": not t.exclude, "left": t.left, "right": t.right, "after": near(t.after), "before": near(t.before), "counts": bool(t.min_finds), "limited": bool(t.max_finds),
            "least": least.get(t.name), "most": most.get(t.name), "least_group": n if (n := layer.min_finds_group.get(g, 0)) > 0 else None, "most_group": layer.max_finds_group.get(g),
        }

    return [row(p) for p in patterns]


def placed(p: Column, pos: Column, k: Column, length: Column) -> Column:
    """Whether k bases at pos of a read of that length are where the pattern may be."""
    start = F.when(p["start"] < 0, p["start"] + length).otherwise(p["start"])
    ok = (start < 0) | ((pos >= start) & ((p["end"] == 0) | (pos + k <= p["end"])))  # too short to count from its end: anywhere
    return ok & (~p["at_start"] | (pos == 0)) & (~p["at_end"] | (pos + k == length))


def _constant(rows: list, kind: str) -> Column:
    """Rows as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), kind)


def literal_candidates(layer: Layer, e: Expanded, seqs: Column) -> Column:
    """``FLAT`` of an array of normalised sequences, one a file: buckets of k-mers are looked up at each place."""
    buckets: list[list] = [[] for _ in range(2 * len(e.kmers) + 1)]
    for kmer, found in e.kmers.items():
        buckets[zlib.crc32(kmer.encode()) % len(buckets)] += [{"kmer": kmer, "id": i, "err": err} for i, err in found]
    table, patterns = _constant(buckets, "array<array<struct<kmer:string,id:int,err:int>>>"), _constant(pattern_rows(layer, e.patterns), f"array<{PATTERN}>")

    def found_at(file: int, k: int, lo: int, hi: int) -> Column:
        seq = F.coalesce(F.get(seqs, F.lit(file)), F.lit(""))
        last = F.least(F.length(seq), F.lit(hi)) - k

        def at(kmer: Column, pos: Column) -> Column:
            own = F.filter(F.get(table, F.pmod(F.crc32(kmer), F.lit(len(buckets))).cast("int")), lambda c: c["kmer"] == kmer)
            found = F.transform(own, lambda c: F.struct(F.lit(file).alias("file"), pos.alias("pos"), F.lit(k).alias("k"), c["err"].alias("err"), F.get(patterns, c["id"]).alias("p")))
            return F.filter(found, lambda c: (c["p"]["file"] == file) & placed(c["p"], pos, F.lit(k), F.length(seq)))

        def block(b: Column) -> Column:  # a place is found by counting characters, from the block's begin
            within = F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), last - b))
            return let(part(seq, b, BLOCK + k - 1), lambda text: F.flatten(F.transform(within, lambda i: let(part(text, i, k), lambda kmer: at(kmer, (b + i).cast("int"))))))

        each = F.flatten(F.transform(F.sequence(F.lit(lo), F.greatest(last, F.lit(lo)), F.lit(BLOCK)), block))
        return F.when(last >= lo, each).otherwise(F.array()).cast(FLAT)

    parts = [found_at(file, *size) for file, sizes in enumerate(place_spans(layer, e)) for size in sizes]
    return F.array_sort(F.concat(*parts)) if parts else F.array().cast(FLAT)


def _places(flat: str) -> Column:
    """The candidates of a read by place, then by length."""

    def place(at: Column) -> Column:
        def sizes(own: Column) -> Column:
            lengths = F.array_distinct(F.transform(own, lambda c: c["k"]))
            return F.transform(lengths, lambda k: F.struct(k.alias("k"), F.transform(F.filter(own, lambda c: c["k"] == k), lambda c: F.struct(c["err"].alias("err"), c["p"].alias("p"))).alias("found")))

        own = F.filter(flat, lambda c: (c["file"] == at["file"]) & (c["pos"] == at["pos"]))
        return F.struct(at["file"].alias("file"), at["pos"].alias("pos"), let(own, sizes).alias("sizes"))

    return F.transform(F.array_distinct(F.transform(flat, lambda c: F.struct(c["file"].alias("file"), c["pos"].alias("pos")))), place)


def _folded(layer: Layer, patterns: list[Pattern]) -> Column:
    """struct(hits, unmet) of the candidates in ``_flat``."""
    tags = [*layer.tags, *([layer.listed_as] if layer.listed_as else [])]
    limits = bool(any(t.min_finds or t.max_finds for t in tags) or layer.min_finds_group or layer.max_finds_group)
    needed = len({t.name for t in layer.tags if t.min_finds}) + sum(n > 0 for n in layer.min_finds_group.values())
    bounded = bool(layer.max_finds_group) and all(t.group and t.group in layer.max_finds_group for t in tags)
    budget = sum(layer.max_finds_group.values()) if bounded else None
    return _fold(SparkContext._active_spark_context, limits, needed, budget, tuple(sorted({p.file for p in patterns if p.opens})), layer.min_delta)


@lru_cache(maxsize=64)
def _fold(context: SparkContext, limits: bool, needed: int, budget: int | None, starred: tuple[int, ...], min_delta: int | None) -> Column:
    """The fold over the places of a read, file by file; an expression on names, so layers of the same rules share it.

    At one length competing names cancel each other (with ``min_delta``, unless their errors differ by more); lengths that
    are clear have to agree on a name, and the longest counts. A hit ends the search up to its end.
    """
    last_type, found_type, counts_type = f"struct<name:string,group:string,after:{_NEIGHBOUR},end:int>", f"struct<p:{PATTERN},err:int,k:int>", "array<struct<key:string,n:int>>"
    hits_type = f"array<{HIT.simpleString()}>"

    def state(f, opened, last, free, over, counts, met, budget, hits) -> Column:
        return F.struct(
            f.alias("f"), opened.alias("opened"), last.cast(last_type).alias("last"), free.alias("free"), over.alias("over"), counts.cast(counts_type).alias("counts"), met.alias("met"), budget.cast("int").alias("budget"), hits.cast(hits_type).alias("hits")
        )

    def matches(n: Column, name: Column, group: Column) -> Column:
        return n["name"] == F.when(n["is_group"], group).otherwise(name)

    def best(s: Column, x: Column) -> Column:
        """The candidate at a place, or null: struct(p, err, k)."""
        last, gap = s["last"], x["pos"] - s["last"]["end"]

        def fits(p: Column) -> Column:
            after, before = last["after"], p["before"]
            ok = (s["opened"] | p["opens"]) & (after.isNull() | matches(after, p["name"], p["group"]))
            near = last.isNotNull() & matches(before, last["name"], last["group"]) & (gap >= before["lo"]) & (before["hi"].isNull() | (gap <= before["hi"]))
            return F.coalesce(ok & (before.isNull() | near), F.lit(False))

        def size(b: Column, z: Column) -> Column:
            def chosen(here: Column) -> Column:
                one = F.get(here, F.lit(0))
                clear = F.forall(here, lambda c: c["p"]["name"] == one["p"]["name"])
                if min_delta is not None:
                    clear = clear | F.exists(here, lambda c: F.exists(here, lambda d: (c["p"]["name"] != d["p"]["name"]) & (F.abs(c["err"] - d["err"]) > min_delta)))
                this = F.struct(one["p"].alias("p"), one["err"].alias("err"), z["k"].alias("k")).cast(found_type)
                other = F.coalesce(b["best"]["p"]["name"] != one["p"]["name"], F.lit(False))
                new = F.struct(F.when(~other, this).alias("best"), other.alias("dead"))
                return F.when(b["dead"] | (F.size(here) == 0) | ~clear, b).otherwise(new)

            return let(F.filter(z["found"], lambda c: fits(c["p"])), chosen)

        none = F.struct(F.lit(None).cast(found_type).alias("best"), F.lit(False).alias("dead"))
        return F.aggregate(x["sizes"], none, size, lambda b: b["best"])

    def bumped(counts: Column, key: Column, cond: Column) -> Column:
        old = F.get(F.filter(counts, lambda c: c["key"] == key), F.lit(0))["n"]
        more = F.struct(key.alias("key"), (F.coalesce(old, F.lit(0)) + 1).alias("n"))
        return F.when(cond, F.concat(F.filter(counts, lambda c: c["key"] != key), F.array(more))).otherwise(counts)

    def number(counts: Column, key: Column) -> Column:
        return F.coalesce(F.get(F.filter(counts, lambda c: c["key"] == key), F.lit(0))["n"], F.lit(0))

    def taken(s: Column, x: Column, h: Column) -> Column:
        p, end = h["p"], x["pos"] + h["k"]
        hit = F.struct(
            p["name"].alias("name"), p["group"].alias("group"), p["seq"].alias("seq"), p["sub"].alias("sub"), p["file"].alias("file"), x["pos"].alias("start"), end.alias("end"), h["err"].alias("err"),
            p["listed"].alias("listed"), p["left"].alias("left"), p["right"].alias("right"), p["id"].alias("pattern"),
        )
        last = F.struct(p["name"].alias("name"), p["group"].alias("group"), p["after"].alias("after"), end.alias("end"))
        if not limits:
            return state(s["f"], F.lit(True), last, end, p["closes"], s["counts"], s["met"], s["budget"], F.concat(s["hits"], F.array(hit)))
        keys = {k: F.concat(F.lit(k), p["group" if k in "gh" else "name"]) for k in "ngmh"}
        counted = p["counts"] & p["least"].isNotNull(), p["least_group"].isNotNull()
        once = bumped(bumped(s["counts"], keys["n"], counted[0]), keys["g"], counted[1])
        full = let(bumped(once, keys["m"], p["limited"]), lambda c: F.struct(c.alias("counts"), (p["limited"] & (number(c, keys["m"]) > p["most"])).alias("over")))

        def bounded_by_group(c: Column) -> Column:
            grouped = ~c["over"] & p["most_group"].isNotNull()
            return F.struct(bumped(c["counts"], keys["h"], grouped).alias("counts"), c["over"].alias("over"), grouped.alias("grouped"))

        def settled_at(c: Column) -> Column:
            met = s["met"] + (counted[0] & (number(c["counts"], keys["n"]) == p["least"])).cast("int") + (counted[1] & (number(c["counts"], keys["g"]) == p["least_group"])).cast("int")
            met = F.coalesce(met, s["met"])
            ok = ~c["over"] & ~(c["grouped"] & F.coalesce(number(c["counts"], keys["h"]) > p["most_group"], F.lit(False)))
            budget = s["budget"] - (c["grouped"] & (s["budget"] > 0)).cast("int")
            return state(
                s["f"], F.lit(True), F.when(ok, last).otherwise(s["last"]), F.when(ok, end).otherwise(s["free"]), F.when(ok, p["closes"]).otherwise(s["over"]), c["counts"], met, budget,
                F.when(ok, F.concat(s["hits"], F.array(hit))).otherwise(s["hits"]),
            )

        return let(let(full, bounded_by_group), settled_at)

    def place(s: Column, x: Column) -> Column:
        after, gap = s["last"]["after"], x["pos"] - s["last"]["end"]
        passed = s["over"] | F.coalesce(s["budget"] == 0, F.lit(False)) | (x["pos"] < s["free"])
        far, near = F.coalesce(gap > after["hi"], F.lit(False)), F.coalesce(gap < after["lo"], F.lit(False))
        kept = state(*[s[c] for c in ("f", "opened", "last", "free")], s["over"] | (~passed & far), *[s[c] for c in ("counts", "met", "budget", "hits")])
        return let(F.when(~(passed | far | near), best(s, x)), lambda h: F.when(h.isNull(), kept).otherwise(taken(s, x, h)))

    def step(s: Column, x: Column) -> Column:
        new, closed = x["file"] != s["f"], x["file"].isin(*starred) if starred else F.lit(False)
        none = F.lit(None).cast(last_type)
        fresh = state(x["file"], F.when(new, ~closed).otherwise(s["opened"]), F.when(new, none).otherwise(s["last"]), F.when(new, 0).otherwise(s["free"]), F.when(new, False).otherwise(s["over"]), s["counts"], s["met"], s["budget"], s["hits"])
        return let(fresh, lambda t: place(t, x))

    begin = state(F.lit(-1), F.lit(True), F.lit(None), F.lit(0), F.lit(False), F.array(), F.lit(0), F.lit(budget), F.array())
    return F.aggregate(_places("_flat"), begin, step, lambda s: F.struct(s["hits"].alias("hits"), (s["met"] < needed).alias("unmet")))


def with_found(df: DataFrame, layer: Layer) -> DataFrame:
    """df with hits and _unmet, from ``_seqs``: an array of normalised sequences, one a file."""
    patterns = patterns_of(layer)
    if layer.listed is None and sum(most_neighbours(f) for p in patterns for f in forms(p)) <= LITERAL_KMERS:
        df = df.withColumn("_flat", literal_candidates(layer, expand(layer), F.col("_seqs")))
    else:
        from strandlake.operators.seeds import with_candidates

        df = with_candidates(df, layer, patterns)
    df = df.withColumn("_found", _folded(layer, patterns))
    return df.withColumns({"hits": F.col("_found.hits"), "_unmet": F.col("_found.unmet")}).drop("_flat", "_found")


def pattern_table(spark: SparkSession, layer: Layer) -> DataFrame:
    """The neighbourhood as a table, to be broadcast if it is not too large: kmer, k, pattern, err, name, group, seq, file, start, end, at_start, at_end."""
    e = expand(layer)
    rows = [
        (kmer, len(kmer), i, err, (p := e.patterns[i]).tag.name, p.tag.group, p.seq, p.file, p.tag.start, p.end, p.at_start, p.at_end) for kmer, found in e.kmers.items() for i, err in found
    ]
    table = spark.createDataFrame(rows, "kmer string, k int, pattern int, err int, name string, group string, seq string, file int, start int, end int, at_start boolean, at_end boolean")
    return F.broadcast(table) if len(rows) <= BROADCAST_KMERS else table.hint("merge")


def kmers_of(reads: DataFrame, spans: list[list[tuple[int, int, int]]]) -> DataFrame:
    """read_id, file, k, length, pos, kmer: the k-mers of reads between the first start and the last end of each length."""
    rows = F.array(*[F.struct(F.lit(f).alias("file"), F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for f, s in enumerate(spans) for k, lo, hi in s])
    each = reads.select("read_id", "seqs", F.explode(rows).alias("s")).select("read_id", F.element_at("seqs", F.col("s.file") + 1).alias("seq"), "s.*")
    last = F.least(F.length("seq"), F.col("hi")) - F.col("k")
    kmers = each.where(last >= F.col("lo")).select("read_id", "file", "k", F.length("seq").alias("length"), "seq", F.explode(F.sequence("lo", last)).alias("pos"))
    return kmers.select("read_id", "file", "k", "length", "pos", F.expr("substring(seq, pos + 1, k)").alias("kmer"))


def candidates(reads: DataFrame, layer: Layer) -> DataFrame:
    """A row for each place in a read where a pattern may be: read_id, file, pos, k, pattern, name, group, err.

    reads: read_id, seqs (normalised, one a file). The k-mers of a read are made between the first and the last place
    where a pattern of that length may be only; the join is with the table of patterns, broadcast up to ``BROADCAST_KMERS``.
    """
    table = pattern_table(reads.sparkSession, layer)
    spans = place_spans(layer, expand(layer))
    kmers = kmers_of(reads, spans)
    hit = kmers.join(table, ["kmer", "k", "file"])
    end, start = F.col("pos") + F.col("k"), F.when(F.col("start") < 0, F.col("start") + F.col("length")).otherwise(F.col("start"))
    ok = (start < 0) | ((F.col("pos") >= start) & ((F.col("end") == 0) | (end <= F.col("end"))))
    ok = ok & (~F.col("at_start") | (F.col("pos") == 0)) & (~F.col("at_end") | (end == F.col("length")))
    return hit.where(ok).select("read_id", "file", "pos", "k", "pattern", "name", "group", "err")


def clear_hits(found: DataFrame, min_delta: int | None = None) -> DataFrame:
    """One candidate a place: read_id, file, pos, k, name, err.

    At one length, competing names cancel each other (or, with min_delta, all but the best if the errors of two names
    differ by more); then lengths of one place must agree on a name, and the longest counts.
    """
    size = ["read_id", "file", "pos", "k"]
    if min_delta is None:
        clear = F.count_distinct("name") == 1
    else:
        clear = (F.count_distinct("name") == 1) | (F.max("err") - F.min("err") > min_delta)
    one = found.groupBy(*size).agg(clear.alias("clear"), F.min_by("name", F.struct("err", "pattern")).alias("name"), F.min("err").alias("err")).where("clear")
    place = one.groupBy("read_id", "file", "pos").agg(F.count_distinct("name").alias("names"), F.max(F.struct("k", "name", "err")).alias("best"))
    return place.where("names = 1").select("read_id", "file", "pos", "best.k", "best.name", "best.err")
