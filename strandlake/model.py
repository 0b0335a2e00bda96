"""Layers of tags and rules, and what a layer expands to before it is given to Spark.

Positions are 0-based and half open. ``end`` 0 means up to the end of the read, a negative ``start`` counts from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.operators.neighbourhood import combined, partials

SEGMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "comment", "seq", "qual")])
READS = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("run_id", T.IntegerType()), T.StructField("segs", T.ArrayType(SEGMENT))])


@dataclass(frozen=True)
class Neighbour:
    """Which tag or group has to come before or after, and how far away: lo to hi bases, hi None for any."""

    name: str
    is_group: bool
    lo: int = 0
    hi: int | None = None


@dataclass(frozen=True)
class Tag:
    """A pattern as a user writes it; ``seq`` may list alternatives with "/" and repeats as UNIT:a-b, and may have stars."""

    seq: str
    name: str = ""
    group: str = ""
    mismatches: int = 0
    indels: int = 0
    total: int = 0
    file: int = -1
    start: int = 0
    end: int = 0
    min_finds: int = 0
    max_finds: int = 0
    exclude: bool = False
    left: int | None = None
    right: int | None = None
    after: Neighbour | None = None
    before: Neighbour | None = None
    partial5: tuple[int, float] = (0, 0.0)
    partial3: tuple[int, float] = (0, 0.0)
    sub: str = ""
    revcomp: bool = False


@dataclass(frozen=True)
class Anchor:
    """What an extraction starts or ends at: a tag, a group, or a location (position -1: the end of the read)."""

    tag: str | None = None
    is_group: bool = False
    file: int = -1
    pos: int = -1


@dataclass(frozen=True)
class Extract:
    """One extraction pattern. special: tag, all or placement; source: tag, sub or read."""

    name: str
    lo: int = 0
    hi: int = 0
    left: Anchor | None = None
    right: Anchor | None = None
    pad_left: int = 0
    pad_right: int = 0
    turn: str = ""  # "", revcomp, reverse or complement
    prepend: str = ""
    append: str = ""
    special: str = ""
    source: str = "tag"


@dataclass(frozen=True)
class Placement:
    """Bases taken from a header comment (pattern), or a fixed string, put into a segment; pos -1: into extractions."""

    file: int
    output_file: int
    pos: int
    pattern: str = ""
    fixed: str | None = None


@dataclass
class Layer:
    """One pass over reads of ``n_files`` segments. ``child`` takes what this layer writes."""

    n_files: int = 1
    tags: list[Tag] = field(default_factory=list)
    extracts: list[Extract] = field(default_factory=list)
    placements: list[Placement] = field(default_factory=list)
    trim5: list[int] = field(default_factory=list)
    trim3: list[int] = field(default_factory=list)
    min_finds_group: dict[str, int] = field(default_factory=dict)
    max_finds_group: dict[str, int] = field(default_factory=dict)
    qtrim: int = 0
    qtrim5: bool = False
    qtrim3: bool = False
    qtrim_pre: bool = False
    qtrim_naive: bool = False
    phred64: bool = False
    filter_len: list[tuple[int, int]] = field(default_factory=list)
    keep: dict[tuple[str, ...], str] = field(default_factory=dict)
    keep_group: dict[tuple[str, ...], str] = field(default_factory=dict)
    remove: set[tuple[str, ...]] = field(default_factory=set)
    remove_group: set[tuple[str, ...]] = field(default_factory=set)
    encode: list[str] = field(default_factory=list)
    sub_encode: list[str] = field(default_factory=list)
    sub_assign: list[int] = field(default_factory=list)
    assign: bool = False
    assign_here: bool = False  # @assign in the configuration of a layer with a child
    remultiplex: bool = False
    min_delta: int | None = None
    no_chain: set[str] | None = None  # None: chain all; empty: chain none; else: don't chain these
    listed: DataFrame | None = None  # more tags, as a table (seq, name) of any length: plain sequences under the rules of listed_as
    listed_as: Tag | None = None
    x_next: bool = False  # between two tags: a left tag is done with the next right one, even if nothing is between them
    x_only: bool = False
    no_tags: bool = False
    prefix: str = ""
    bclen: int = 16
    child: Layer | None = None

    @property
    def names(self) -> list[str]:
        """Extraction names in order of first appearance."""
        return list(dict.fromkeys(e.name for e in self.extracts))


@dataclass(frozen=True)
class Pattern:
    """A tag for one sequence, one file and one kind of match."""

    id: int
    tag: Tag
    seq: str
    sub: str
    file: int
    end: int
    at_start: bool = False
    at_end: bool = False
    opens: bool = False
    closes: bool = False


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def alternatives(seq: str) -> list[str]:
    if ":" in seq:
        unit, _, span = seq.partition(":")
        lo, _, hi = span.partition("-")
        a, b = int(lo), int(hi or lo)
        if not 0 < a <= b or "/" in unit:
            raise ValueError(f"{seq} is not a repeat")
        return [unit * n for n in range(a, b + 1)]
    return [s for s in seq.split("/") if s]


@dataclass
class Expanded:
    """Patterns, and for each k-mer (pattern id, errors)."""

    patterns: list[Pattern]
    kmers: dict[str, list[tuple[int, int]]]


def patterns_of(layer: Layer) -> list[Pattern]:
    """The patterns of a layer's tags; an id is a pattern's place."""
    patterns: list[Pattern] = []
    for tag in layer.tags:
        text = tag.seq.upper()
        opens, closes = text.startswith("*"), len(text) > 1 and text.endswith("*")
        seqs = alternatives(text[opens : len(text) - closes])
        seqs += [reverse_complement(s) for s in seqs] if tag.revcomp else []
        if not seqs or any(set(s) - set("ACGT") for s in seqs):
            raise ValueError(f"{tag.seq!r} is no sequence of A, C, G and T")
        for file in range(layer.n_files) if tag.file < 0 else [tag.file]:
            for seq in seqs:
                if tag.end and tag.end - tag.start < len(seq):
                    raise ValueError(f"{seq} does not fit into its location")
                whole = Pattern(len(patterns), tag, seq, seq if tag.sub == "." else tag.sub, file, tag.end, opens=opens, closes=closes)
                patterns.append(whole)
                if tag.partial5[0] and tag.start <= 0:
                    end = min(len(seq), tag.end) if tag.end else len(seq)
                    patterns.append(replace(whole, id=len(patterns), end=end, at_start=True))
                if tag.partial3[0]:
                    patterns.append(replace(whole, id=len(patterns), at_end=True))
    return patterns


def neighbours(p: Pattern) -> dict[str, int]:
    """The k-mers of a pattern, and their errors."""
    if p.at_start or p.at_end:
        return partials(p.seq, *(p.tag.partial5 if p.at_start else p.tag.partial3), five=p.at_start)
    return combined(p.seq, p.tag.mismatches, p.tag.indels, p.tag.total) | {p.seq: 0}


@dataclass(frozen=True)
class Form:
    """A text that a pattern may be in reads, within errors. more: what counts besides where it is not exactly the text."""

    text: str
    mismatches: int
    indels: int
    total: int
    more: int = 0


def forms(p: Pattern) -> list[Form]:
    """What ``neighbours`` are made of."""
    if not (p.at_start or p.at_end):
        most = min(p.tag.mismatches, p.tag.total), min(p.tag.indels, p.tag.total)
        return [Form(p.seq, *most, p.tag.total if any(most) else 0)]
    least, share = p.tag.partial5 if p.at_start else p.tag.partial3
    sizes = [(n, int(share * n + 1e-9)) for n in range(len(p.seq), least - 1, -1)]
    return [Form(p.seq[len(p.seq) - n :] if p.at_start else p.seq[:n], d, 0, d, len(p.seq) - n) for n, d in sizes if n]


def most_neighbours(f: Form) -> int:
    """At least as many as a form has neighbours."""
    m = len(f.text) + f.indels
    subs = sum(comb(m, n) * 4**n for n in range(min(f.mismatches, m) + 1))
    return subs * (1 + sum((5 * (m + 1)) ** n + comb(m, n) for n in range(1, f.indels + 1)))


def expand(layer: Layer) -> Expanded:
    patterns = patterns_of(layer)
    kmers: dict[str, list[tuple[int, int]]] = {}
    for p in patterns:
        for kmer, errors in neighbours(p).items():
            kmers.setdefault(kmer, []).append((p.id, errors))
    return Expanded(patterns, kmers)
