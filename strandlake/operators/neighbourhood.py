"""Sequences within some errors of a pattern; N counts as a fifth letter."""

from __future__ import annotations

from itertools import combinations, product

LETTERS = "ATCGN"


def substituted(seq: str, most: int) -> dict[str, int]:
    """Sequences with 1 to ``most`` substitutions, and how many."""
    out = {}
    for n in range(1, min(most, len(seq)) + 1):
        for places in combinations(range(len(seq)), n):
            for letters in product(LETTERS, repeat=n):
                if all(seq[p] != c for p, c in zip(places, letters, strict=True)):
                    other = list(seq)
                    for p, c in zip(places, letters, strict=True):
                        other[p] = c
                    out["".join(other)] = n
    return out


def indels(seq: str, most: int) -> dict[str, int]:
    """Sequences with 1 to ``most`` insertions, or as many deletions, and how many; never both kinds."""
    out: dict[str, int] = {}
    longer, shorter = {seq}, {seq}
    for n in range(1, most + 1):
        longer = {s[:i] + c + s[i:] for s in longer for i in range(len(s) + 1) for c in LETTERS}
        shorter = {t for s in shorter for i in range(len(s)) if (t := s[:i] + s[i + 1 :])}
        for s in longer | shorter:
            out.setdefault(s, n)
    return out


def combined(seq: str, mismatches: int, indel: int, total: int) -> dict[str, int]:
    """Sequences with so many substitutions and indels, ``total`` together; none that is seq or holds it within."""
    mismatches, indel = min(mismatches, total), min(indel, total)
    out = substituted(seq, mismatches)
    for s, used in indels(seq, indel).items():
        for t, n in ({s: 0} | substituted(s, min(mismatches, total - used))).items():
            out[t] = min(used + n, out.get(t, total))
    return {s: n for s, n in out.items() if seq not in s}


def partials(seq: str, least: int, share: float, five: bool) -> dict[str, int]:
    """Ends of seq of ``least`` bases or more, cut off by the start (five) or end of a read.

    A share of the bases may be substituted; that counts with the missing bases, while an exact end counts nothing.
    """
    out: dict[str, int] = {}
    for n in range(len(seq), least - 1, -1):
        part = seq[len(seq) - n :] if five else seq[:n]
        near = {s: e + len(seq) - n for s, e in substituted(part, int(share * n + 1e-9)).items()}
        for s, e in ({part: 0} | near).items():
            out.setdefault(s, e)
    return out
