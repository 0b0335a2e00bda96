"""Properties that hold for any reads and tags."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.model import expand, reverse_complement
from strandlake.operators.neighbourhood import combined, indels, substituted
from tests.scanner import Scanner
from strandlake.plans import parse
from strandlake.plans.options import build

DNA = st.text("ACGT", min_size=1, max_size=8)
READ = st.text("ACGTN", max_size=60)


def _scan(layer, read):
    return Scanner(layer).scan([read])



@given(DNA)
def test_reverse_complement_twice(seq):
    assert reverse_complement(reverse_complement(seq)) == seq


@settings(deadline=None)
@given(DNA, st.integers(0, 2))
def test_substitutions_are_as_far_as_they_say(seq, most):
    for s, n in substituted(seq, most).items():
        assert len(s) == len(seq) and sum(a != b for a, b in zip(s, seq, strict=True)) == n


@settings(deadline=None, max_examples=30)
@given(st.text("ACGT", min_size=2, max_size=5), st.integers(0, 1))
def test_neighbours_never_hold_the_tag(seq, d):
    assert all(seq not in s for s in combined(seq, d, 1, d + 1))
    assert all(abs(len(s) - len(seq)) == n for s, n in indels(seq, 2).items())


@settings(deadline=None)
@given(READ, st.lists(DNA, min_size=1, max_size=4, unique=True), st.integers(0, 1))
def test_hits_are_apart_and_where_they_say(read, tags, d):
    layer, _ = build(tags=",".join(tags), distances=",".join([str(min(d, len(t) - 1)) for t in tags]))
    hits, _ = _scan(layer, read)
    at = 0
    for p, start, end, err in hits:
        assert at <= start < end <= len(read)
        assert err or read[start:end] == p.seq
        at = end


@settings(deadline=None)
@given(READ, DNA)
def test_a_tag_alone_is_found_as_text_is(read, tag):
    layer, _ = build(tags=tag)
    assert [start for _, start, *_ in _scan(layer, read)[0]] == [m.start() for m in re.finditer(tag, read)]


@given(st.integers(1, 5), st.integers(0, 5))
def test_repeats(a, more):
    layer, _ = build(tags=f"AC:{a}-{a + more}")
    assert [p.seq for p in expand(layer).patterns] == ["AC" * n for n in range(a, a + more + 1)]


@given(st.integers(0, 9), st.integers(0, 9), st.sampled_from(["", "~", "~r~", "~c~"]))
def test_extraction_notation(lo, more, turn):
    (e,) = parse.extract(f"{{t}}<{turn}u[{lo}-{lo + more}]>0:5")
    assert (e.lo, e.hi, e.left.tag, e.right.pos) == (lo, lo + more, "t", 5)
