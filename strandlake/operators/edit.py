"""Cutting and substituting reads, as expressions on one segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.sequence import filler, part

_PIECES = "array<struct<seq:string,qual:string>>"


def tag_cuts(hits: Column, file: int, length: Column) -> tuple[Column, Column]:
    """(bases to cut at the start, at the end): of the last tag that trims to the left, the first that trims to the right."""
    mine = F.filter(hits, lambda h: h.file == file)
    lefts, rights = F.filter(mine, lambda h: h.left.isNotNull()), F.filter(mine, lambda h: h.right.isNotNull())
    left = F.element_at(F.transform(lefts, lambda h: h.end + h.left), -1)
    right = F.element_at(F.transform(rights, lambda h: length - h.start + h.right), 1)

    def held(cut: Column, some: Column) -> Column:
        return F.when(F.size(some) > 0, F.greatest(F.lit(0), F.least(cut, length))).otherwise(0)

    return held(left, lefts), held(right, rights)


def substituted(hits: Column, file: int, seq: Column, qual: Column, shift: Column) -> tuple[Column, Column]:
    """seq and qual with the spans of hits that have a substitution replaced.

    Hits are placed on what was scanned; seq begins ``shift`` bases later. Spans that were cut off partly are replaced as far
    as they are left, those cut off wholly not at all.
    """
    mine = F.filter(hits, lambda h: (h.file == file) & (h["sub"] != ""))
    full = F.length(seq)

    def step(s: Column, h: Column) -> Column:
        a, b = F.greatest(h.start - shift, F.lit(0)), F.least(h.end - shift, full)
        new = F.when(h["sub"] == "-", F.lit("")).otherwise(h["sub"])
        piece = F.struct(F.concat(part(seq, s.at, a - s.at), new).alias("seq"), F.concat(part(qual, s.at, a - s.at), filler(F.length(new))).alias("qual"))
        return F.when(b > a, F.struct(F.concat(s.pieces, F.array(piece)).alias("pieces"), b.alias("at"))).otherwise(s)

    start = F.struct(F.array().cast(_PIECES).alias("pieces"), F.lit(0).alias("at"))
    done = F.aggregate(mine, start, step)

    def whole(field: str, text: Column) -> Column:
        joined = F.array_join(F.transform(done.pieces, lambda p: p[field]), "")
        return F.when(F.size(mine) > 0, F.concat(joined, part(text, done["at"], F.length(text)))).otherwise(text)

    return whole("seq", seq), whole("qual", qual)


def inserted(seq: Column, qual: Column, values: list[tuple[int, Column]]) -> tuple[Column, Column]:
    """seq and qual with each value put in at its position, clamped to the read; equal positions keep the listed order."""
    for pos, value in sorted(values, key=lambda v: v[0])[::-1]:
        at = F.least(F.lit(max(pos, 0)), F.length(seq))
        seq, qual = (F.concat(part(text, 0, at), v, part(text, at, F.length(text))) for text, v in ((seq, value), (qual, filler(F.length(value)))))
    return seq, qual
