"""Column functions on sequences and qualities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FILLER = "K"  # the quality of bases that were not read


def complement(seq: Column) -> Column:
    """A and T, C and G change places; other letters become N."""
    return F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def normalised(seq: Column) -> Column:
    """Upper case; what is not A, C, G or T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def filler(n: Column) -> Column:
    return F.repeat(F.lit(FILLER), n)


def part(text: Column, start: Column | int, length: Column | int) -> Column:
    """length characters from a 0-based start."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(text, start + 1, length)


def barcode(id_: Column, length: int, prefix: str = "") -> Column:
    """An id as bases: digits to the base of four, A C G T, behind a prefix."""
    digits = F.translate(F.conv(id_.cast("string"), 10, 4), "0123", "ACGT")
    return F.concat(F.lit(prefix), F.lpad(digits, length, "A"))


def barcode_id(bases: Column) -> Column:
    return F.conv(F.translate(bases, "ACGT", "0123"), 4, 10).cast("long")


def _scores(qual: Column, threshold: int, phred64: bool) -> Column:
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - (64 if phred64 else 33) - threshold)


def _partial_sum_cut(scores: Column) -> Column:
    """How many leading scores to cut: through the first least running sum, before a sum above zero ends the search."""

    def step(s: Column, x: Column) -> Column:
        total = s.total + x
        over = s["over"] | (total > 0)
        better = ~over & (total < s.least)
        return F.struct(
            total.alias("total"), over.alias("over"), F.when(better, total).otherwise(s.least).alias("least"), (s.at + 1).alias("at"), F.when(better, s.at + 1).otherwise(s.cut).alias("cut")
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("over"), F.lit(1000).alias("least"), F.lit(0).alias("at"), F.lit(0).alias("cut"))
    return F.aggregate(scores, start, step, lambda s: s.cut)


def _run_cut(bad: Column) -> Column:
    """How many leading flags are set."""
    at = F.array_position(bad, False)
    return F.when(at > 0, at.cast("int") - 1).otherwise(F.size(bad))


def quality_cuts(seq: Column, qual: Column, threshold: int, five: bool, three: bool, naive: bool, phred64: bool) -> tuple[Column, Column]:
    """(bases to cut at the start, bases to cut at the end), found independently; null and empty reads: 0."""
    scores = _scores(qual, threshold, phred64)
    if naive:
        bases = F.split(F.upper(seq), "")
        bad = F.zip_with(scores, bases, lambda q, b: (q < 0) | ~b.rlike("[ACGT]"))
        left, right = _run_cut(bad), _run_cut(F.reverse(bad))
    else:
        left, right = _partial_sum_cut(scores), _partial_sum_cut(F.reverse(scores))
    some = F.length(seq) > 0
    return (F.when(some, left).otherwise(0) if five else F.lit(0)), (F.when(some, right).otherwise(0) if three else F.lit(0))


def found_in_name(comment: Column, pattern: str) -> Column:
    """Bases in a header comment behind the first place where the characters of pattern come one after the other."""
    import re

    return F.regexp_extract(comment, "(?s)^" + "".join(f".*?{re.escape(c)}" for c in pattern) + "([ACGTNacgtn]*)", 1)
