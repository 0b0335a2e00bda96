"""The ordered scan as a plain loop over one read: what the fold over candidates has to agree with."""

from __future__ import annotations

from collections import Counter

from strandlake.model import Expanded, Layer, Pattern, expand
from strandlake.operators.scan import place_spans


def placed(p: Pattern, at: int, end: int, length: int) -> bool:
    """Whether bases at..end of a read of that length are where the pattern may be."""
    if (p.at_start and at) or (p.at_end and end != length):
        return False
    start = p.tag.start
    if start < 0:
        start += length
        if start < 0:
            return True  # too short to count from its end: anywhere
    return at >= start and not (p.end and end > p.end)


class Scanner:
    """The patterns of a layer, laid out for lookups."""

    def __init__(self, layer: Layer):
        e: Expanded = expand(layer)
        self.patterns, self.kmers = e.patterns, e.kmers
        self.delta = layer.min_delta
        self.sizes = place_spans(layer, e)
        self.opened = [any(p.opens and p.file == f for p in e.patterns) for f in range(layer.n_files)]
        self.least = Counter({t.name: t.min_finds for t in layer.tags if t.min_finds})
        self.most = {t.name: t.max_finds for t in layer.tags if t.max_finds}
        self.least_group = dict(layer.min_finds_group)
        self.most_group = dict(layer.max_finds_group)
        budget = all(t.group and t.group in self.most_group for t in layer.tags)
        self.budget = sum(self.most_group.values()) if budget and self.most_group else None

    def at(self, seq: str, file: int, pos: int, fits) -> tuple[Pattern, int, int] | None:
        """The pattern at pos, its end and errors; None where names compete. fits: what the scan so far allows."""
        best = None
        for k, lo, hi in self.sizes[file]:
            end = pos + k
            if end > len(seq):
                break
            if pos < lo or end > hi or (found := self.kmers.get(seq[pos:end])) is None:
                continue
            here = [(self.patterns[i], err) for i, err in found if self.patterns[i].file == file]
            here = [(p, err) for p, err in here if fits(p) and placed(p, pos, end, len(seq))]
            if not here:
                continue
            one = min(here, key=lambda h: h[1])
            if self.delta is None:
                clear = len({p.tag.name for p, _ in here}) == 1
            else:
                apart = [abs(a - b) for p, a in here for q, b in here if p.tag.name != q.tag.name]
                clear = not apart or max(apart) > self.delta
            if clear:
                if best and best[0].tag.name != one[0].tag.name:
                    return None
                best = one[0], end, one[1]
        return best

    def scan(self, seqs: list[str]) -> tuple[list[tuple[Pattern, int, int, int]], bool]:
        """(pattern, start, end, errors) of the hits of a read, file by file, and whether a least number is not met."""
        least, most, least_group, most_group = dict(self.least), dict(self.most), dict(self.least_group), dict(self.most_group)
        budget, hits = self.budget, []
        for file, seq in enumerate(seqs[: len(self.sizes)]):
            last: tuple[Pattern, int] | None = None  # the tag before, and its end
            opened, pos, free = not self.opened[file], 0, 0

            def fits(p: Pattern) -> bool:
                if not (opened or p.opens):  # noqa: B023
                    return False
                if last and (a := last[0].tag.after) and a.name != (p.tag.group if a.is_group else p.tag.name):  # noqa: B023
                    return False
                if b := p.tag.before:
                    if not last or b.name != (last[0].tag.group if b.is_group else last[0].tag.name):  # noqa: B023
                        return False
                    return b.lo <= pos - last[1] and (b.hi is None or pos - last[1] <= b.hi)  # noqa: B023
                return True

            for pos in range(len(seq)):
                if budget == 0:
                    break
                if pos < free:
                    continue
                if last and (a := last[0].tag.after):
                    if a.hi is not None and pos - last[1] > a.hi:
                        break
                    if pos - last[1] < a.lo:
                        continue
                if (found := self.at(seq, file, pos, fits)) is None:
                    continue
                p, end, err = found
                opened = True
                name, group = p.tag.name, p.tag.group
                if name in least and p.tag.min_finds:
                    least[name] -= 1
                if group in least_group:
                    least_group[group] -= 1
                if p.tag.max_finds:
                    most[name] -= 1
                    if most[name] < 0:
                        continue
                if group in most_group:
                    budget = budget - 1 if budget else budget
                    most_group[group] -= 1
                    if most_group[group] < 0:
                        continue
                hits.append((p, pos, end, err))
                last = p, end
                if p.closes:
                    break
                free = end
        return hits, any(n > 0 for n in (*least.values(), *least_group.values()))
