"""UMI-like extraction: parts of reads next to tags or at locations.

Each pattern gives an array of (order, value, quality) by expressions on the hits; the values of one name are put together
in order: by file, then by place, at one place locations before tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequence import FILLER, complement, filler, part, reverse_complement
from strandlake.model import Anchor, Extract, Layer

_VALUE = "array<struct<file:int,at:int,kind:int,rank:int,nth:int,value:string,qual:string>>"
_LAST = (1 << 31) - 1


def _is(hit: Column, anchor: Anchor) -> Column:
    return (hit.group if anchor.is_group else hit["name"]) == anchor.tag


def _made(e: Extract, value: Column, qual: Column, file: Column, at: Column, kind: int, rank: int, nth: Column) -> Column:
    """The element of one extraction, its turns and additions done; a quality of another length counts as none."""
    fits = F.length(qual) == F.length(value)
    if e.turn == "revcomp":
        value, qual = reverse_complement(value), F.reverse(qual)
    elif e.turn == "reverse":
        value, qual = F.reverse(value), F.reverse(qual)
    elif e.turn == "complement":
        value = complement(value)
    value = F.concat(F.lit(e.prepend), value, F.lit(e.append))
    qual = F.when(fits, F.concat(F.lit(FILLER * len(e.prepend)), qual, F.lit(FILLER * len(e.append)))).otherwise(F.lit(""))
    fields = (file.cast("int"), at.cast("int"), F.lit(kind), F.lit(rank), nth.cast("int"), value, qual)
    return F.struct(*[f.alias(n) for f, n in zip(fields, ("file", "at", "kind", "rank", "nth", "value", "qual"), strict=True)])


def _after(e: Extract, start: Column, length: Column) -> Column:
    """How many bases to take from start on: hi, or down to lo if the read ends before; 0 for none."""
    n = F.when(start + e.hi <= length, F.lit(e.hi)).otherwise(F.greatest(F.lit(e.lo), length - start))
    return F.when((start + n <= length) & (n > 0), n).otherwise(0)


def _before(e: Extract, end: Column) -> Column:
    n = F.when(end >= e.hi, F.lit(e.hi)).otherwise(F.greatest(F.lit(e.lo), end))
    return F.when((end - n >= 0) & (n > 0), n).otherwise(0)


def _between(e: Extract, start: Column, end: Column) -> Column:
    """All bases from start to end, if that many are asked for; else 0."""
    n = end - start
    ok = (n > 0) & (n >= e.lo)
    return F.when(ok & (n <= e.hi) if e.hi else ok, n).otherwise(0)


def _one(e: Extract, ok: Column, element: Column) -> Column:
    return F.when(ok, F.array(element)).otherwise(F.array().cast(_VALUE))


def _of_hits(hits: Column, wanted, make) -> Column:
    """make(hit) for wanted hits, as far as it gives something."""
    return F.filter(F.transform(F.filter(hits, wanted), make), lambda x: x.isNotNull())


def _pairs(e: Extract, hits: Column, seq, qual, rank: int, only_next: bool) -> Column:
    """From each open left tag of a file to a right tag; a left tag is done with its first extraction, or, with ``only_next``,
    with the right tag that follows, whether that gives an extraction or not."""
    left, right = e.left, e.right

    def step(state: Column, h: Column) -> Column:
        opened = F.filter(state.open, lambda o: o.file == h.file)
        ends = h.start - e.pad_right

        def made(o: Column, i: Column) -> Column:
            start = o.end + e.pad_left
            n = _between(e, start, ends)
            return F.struct(o.alias("o"), F.when(n > 0, _made(e, part(seq(h.file), start, n), part(qual(h.file), start, n), h.file, h.start, 1, rank, i)).alias("x"))

        got = F.filter(F.transform(F.when(_is(h, right), opened).otherwise(F.array().cast("array<struct<file:int,end:int>>")), made), lambda p: p.x.isNotNull())
        # one entry is taken away for each extraction; ends of one file differ, so the entry tells them apart
        done = (lambda o: _is(h, right) & (o.file == h.file)) if only_next else (lambda o: F.exists(got, lambda p: (p.o.file == o.file) & (p.o.end == o.end)))
        rest = F.filter(state.open, lambda o: ~done(o))
        own = F.when(_is(h, left), F.array(F.struct(h.file.alias("file"), h.end.alias("end")))).otherwise(F.array().cast("array<struct<file:int,end:int>>"))
        return F.struct(F.concat(rest, own).alias("open"), F.concat(state.out, F.transform(got, lambda p: p.x)).alias("out"))

    start = F.struct(F.array().cast("array<struct<file:int,end:int>>").alias("open"), F.array().cast(_VALUE).alias("out"))
    return F.aggregate(hits, start, step, lambda s: s.out)


def _values(e: Extract, rank: int, hits: Column, seqs: Column, quals: Column, given: Column | None, only_next: bool) -> Column:
    def seq(file: Column) -> Column:
        return F.element_at(seqs, file.cast("int") + 1)

    def qual(file: Column) -> Column:
        return F.element_at(quals, file.cast("int") + 1)

    def length(file: Column) -> Column:
        return F.length(seq(file))

    zero = F.lit(0)
    if e.special == "placement":
        v = F.coalesce(given, F.lit(""))
        ok = (F.length(v) >= e.lo) & (F.length(v) <= e.hi) if e.hi else F.lit(True)
        return _one(e, ok, _made(e, v, F.lit(None).cast("string"), F.lit(_LAST), F.lit(_LAST), 3, rank, zero))
    if e.special == "all":
        listed = F.filter(hits, lambda h: h.listed)
        value = F.array_join(F.transform(listed, lambda h: _source(e, h, seq)), "")
        q = F.array_join(F.transform(listed, lambda h: part(qual(h.file), h.start, h.end - h.start)), "") if e.source == "read" else F.lit("")
        ok = (F.length(value) >= e.lo) & (F.length(value) <= e.hi) if e.hi else F.lit(True)
        return _one(e, ok, _made(e, value, q, F.lit(_LAST), F.lit(_LAST), 2, rank, zero))
    if e.special == "tag":

        def tag_value(h: Column) -> Column:
            v = _source(e, h, seq)
            q = part(qual(h.file), h.start, h.end - h.start) if e.source == "read" else filler(F.length(v))
            made = _made(e, v, q, h.file, h.start, 1, rank, zero)
            return F.when((F.length(v) >= e.lo) & (F.length(v) <= e.hi), made) if e.hi else made

        return _of_hits(hits, lambda h: _is(h, e.left), tag_value)

    left, right = e.left, e.right
    if left and left.tag and not right:

        def follows(h: Column) -> Column:
            start = h.end + e.pad_left
            n = _after(e, start, length(h.file))
            return F.when(n > 0, _made(e, part(seq(h.file), start, n), part(qual(h.file), start, n), h.file, h.start, 1, rank, zero))

        return _of_hits(hits, lambda h: _is(h, left), follows)
    if right and right.tag and not left:

        def precedes(h: Column) -> Column:
            end = h.start - e.pad_right
            n = _before(e, end)
            return F.when(n > 0, _made(e, part(seq(h.file), end - n, n), part(qual(h.file), end - n, n), h.file, h.start, 1, rank, zero))

        return _of_hits(hits, lambda h: _is(h, right), precedes)
    if left and right and left.tag and right.tag:
        return _pairs(e, hits, seq, qual, rank, only_next)
    if left and right and right.tag:  # from a location to a tag

        def to_tag(h: Column) -> Column:
            start, end = F.lit(left.pos + e.pad_left), h.start - e.pad_right
            n = _between(e, start, end)
            return F.when(n > 0, _made(e, part(seq(h.file), start, n), part(qual(h.file), start, n), h.file, h.start, 1, rank, zero))

        return _of_hits(hits, lambda h: _is(h, right) & (h.file == left.file), to_tag)

    file = F.lit((right or left).file)
    text, q, full = seq(file), qual(file), length(file)
    if left and not left.tag and not right:
        start = F.lit(left.pos + e.pad_left)
        n = _after(e, start, full)
        return _one(e, n > 0, _made(e, part(text, start, n), part(q, start, n), file, F.lit(left.pos), 0, rank, zero))
    at = F.lit(_LAST) if right.pos < 0 else F.lit(right.pos)
    end = (full if right.pos < 0 else F.lit(right.pos)) - e.pad_right
    if not left:
        n = _before(e, end)
        ok = (n > 0) & (end - n < full)
        return _one(e, ok, _made(e, part(text, end - n, n), part(q, end - n, n), file, at, 0, rank, zero))
    if not left.tag:
        start = F.lit(left.pos + e.pad_left)
        n = F.when(end <= full, _between(e, start, end)).otherwise(0)
        return _one(e, n > 0, _made(e, part(text, start, n), part(q, start, n), file, at, 0, rank, zero))

    def to_location(h: Column, i: Column) -> Column:
        start = h.end + e.pad_left
        n = F.when(end <= full, _between(e, start, end)).otherwise(0)
        return F.when(n > 0, _made(e, part(text, start, n), part(q, start, n), file, at, 0, rank, i))

    opened = F.filter(hits, lambda h: _is(h, left) & (h.file == right.file) & (h.start < at))
    return F.filter(F.transform(opened, to_location), lambda x: x.isNotNull())


def _source(e: Extract, h: Column, seq) -> Column:
    """The bases of a hit: as the tag has them, as its substitution has them, or as they were read."""
    if e.source == "read":
        return part(seq(h.file), h.start, h.end - h.start)
    if e.source == "sub":
        return F.when(h["sub"] == "", h.seq).when(h["sub"] == "-", F.lit("")).otherwise(h["sub"])
    return h.seq


def extractions(layer: Layer, hits: Column, seqs: Column, quals: Column, given: list[Column]) -> Column:
    """array of struct(value, qual), one for each name of ``layer.names``; given: what placements put into extractions."""
    out = []
    nth_given = iter(given)
    columns = []
    for rank, e in enumerate(layer.extracts):
        by_group = bool((e.left and e.left.is_group) or (e.right and e.right.is_group and not (e.left and e.left.tag)))
        value = next(nth_given, None) if e.special == "placement" else None
        columns.append(_values(e, rank + (1000 if by_group else 0), hits, seqs, quals, value, layer.x_next) if e.special != "placement" or value is not None else None)
    for name in layer.names:
        mine = [c for e, c in zip(layer.extracts, columns, strict=True) if e.name == name and c is not None]
        if not mine:
            out.append(F.struct(F.lit("").alias("value"), F.lit("").alias("qual")))
            continue
        every = F.sort_array(F.concat(*mine)) if len(mine) > 1 or layer.no_chain is not None else mine[0]
        if layer.no_chain is not None and (not layer.no_chain or name in layer.no_chain):
            every = F.slice(F.filter(every, lambda x: x.value != ""), 1, 1)
        out.append(F.struct(F.array_join(F.transform(every, lambda x: x.value), "").alias("value"), F.array_join(F.transform(every, lambda x: x.qual), "").alias("qual")))
    return F.array(*out)
