"""The short notations of tag tables, extraction patterns and nested configurations."""

from __future__ import annotations

import re
from dataclasses import replace

from strandlake.model import Anchor, Extract, Layer, Neighbour, Placement, Tag


def distance(text: str) -> tuple[int, int, int]:
    """mismatches[:indels[:total]]"""
    parts = [int(x) for x in text.split(":")] if text else [0]
    mismatches, indels = parts[0], parts[1] if len(parts) > 1 else 0
    total = parts[2] if len(parts) > 2 and parts[2] else mismatches + indels
    if mismatches > total or indels > total or mismatches + indels < total:
        raise ValueError(f"distance {text}: more in total than in parts, or less than in one")
    return mismatches, indels, total


def location(text: str) -> tuple[int, int, int]:
    """file[:start[:end]]; empty or "-": anywhere"""
    parts = [int(x) for x in re.split("[:,]", text)] if text not in ("", "-") else [-1]
    return (*parts, 0, 0)[:3] if len(parts) < 3 else tuple(parts)


def neighbour(text: str) -> Neighbour | None:
    """{name}lo-hi or {{group}}lo-hi"""
    if text in ("", "-"):
        return None
    m = re.fullmatch(r"\{(\{?)([^{}]+)\}?\}(?:(\d+)(?:-(\d+))?)?", text)
    if not m:
        raise ValueError(f"{text} names no neighbour")
    return Neighbour(m[2], bool(m[1]), int(m[3] or 0), int(m[4]) if m[4] else None)


def trim(text: str) -> int | None:
    """flag[:offset]"""
    flag, _, offset = text.partition(":")
    return int(offset or 0) if flag not in ("", "0", "-") else None


def partial(text: str) -> tuple[int, float]:
    """least[:share]"""
    least, _, share = text.partition(":")
    return (int(least), float(share or 0)) if least not in ("", "0", "-") else (0, 0.0)


def extract(text: str) -> list[Extract]:
    """[anchor][pad]<[~|~r~|~c~][^pre^|^^post^^]name[len|[lo-hi]]>[pad][anchor], several with commas."""
    return [_extract(t) for t in text.replace(" ", "").split(",") if t]


def _length(text: str) -> tuple[int, int]:
    lo, dash, hi = text.partition("-")
    return (int(lo or 0), int(hi or 0)) if dash else (int(lo or 0), int(lo or 0))


def _anchor(text: str, left: bool) -> tuple[Anchor | None, int]:
    """An anchor and the padding that stands between it and the extraction."""
    if not text:
        return None, 0
    if m := re.fullmatch(r"(\d*)(\{\{[^{}]+\}\}|\{[^{}]+\})(\d*)", text):
        pad = m[3] if left else m[1]
        return Anchor(tag=m[2].strip("{}"), is_group=m[2].startswith("{{")), int(pad or 0)
    m = re.fullmatch(r"(\d+):(-?\d+)", text)
    if not m:
        raise ValueError(f"{text} is no anchor")
    return Anchor(file=int(m[1]), pos=int(m[2])), 0


def _extract(text: str) -> Extract:
    m = re.fullmatch(r"([^<>]*)<([^<>]+)>([^<>]*)", text)
    if not m:
        raise ValueError(f"{text} is no extraction pattern")
    before, inner, after = m.groups()
    out = Extract("")
    for mark, turn in (("~r~", "reverse"), ("~c~", "complement"), ("~", "revcomp")):
        if inner.startswith(mark) and len(inner) > len(mark):
            inner, out = inner[len(mark) :], replace(out, turn=turn)
            break
    if p := re.match(r"\^\^(.*?)\^\^", inner):
        inner, out = inner[p.end() :], replace(out, append=p[1])
    elif p := re.match(r"\^(.*?)\^", inner):
        inner, out = inner[p.end() :], replace(out, prepend=p[1])
    tag = None
    if not before and not after and (p := re.fullmatch(r"(.*?)\{(\{?)([#@]?)([^{}]+)\}?\}", inner)):
        inner, source = p[1], {"": "tag", "#": "sub", "@": "read"}[p[3]]
        special = {"*": "all", ":": "placement"}.get(p[4], "tag")
        tag = Anchor(tag=p[4], is_group=bool(p[2])) if special == "tag" else None
        out = replace(out, special=special, source=source)
    if p := re.fullmatch(r"(.*)\[([\d-]+)\]", inner):
        inner = p[1]
        lo, hi = _length(p[2])
        out = replace(out, lo=lo, hi=hi)
    if tag:
        return replace(out, name=inner, left=tag)
    left, pad_left = _anchor(before, True)
    right, pad_right = _anchor(after, False)
    return replace(out, name=inner, left=left, right=right, pad_left=pad_left, pad_right=pad_right)


def placements(text: str) -> list[Placement]:
    """file,output_file,pos,pattern, several with semicolons"""
    out = []
    for part in text.split(";"):
        file, output, pos, pattern = part.split(",", 3)
        out.append(Placement(int(file), int(output), int(pos), pattern))
    return out


def random_placement(text: str) -> Placement:
    """output_file,pos,length: the same bases for every read, drawn by a Mersenne twister of the usual fixed seed 42."""
    output, pos, length = map(int, text.split(","))
    return Placement(0, output, pos, fixed="".join("ATCG"[x % 4] for x in _mt19937(42, length)))


def _mt19937(seed: int, n: int) -> list[int]:
    import numpy as np

    return np.random.RandomState(seed)._bit_generator.random_raw(n).tolist()


#: fixed values: column names of tag tables
_TAG_COLUMNS = {
    "tag": "seq", "barcode": "seq", "distance": "distance", "location": "location", "id": "name", "group": "group", "minfinds": "min_finds", "maxfinds": "max_finds",
    "minfindsg": "min_finds_g", "maxfindsg": "max_finds_g", "revcomp": "revcomp", "exclude": "exclude", "sub": "sub", "after": "after", "next": "after", "before": "before", "previous": "before",
    "left": "left", "right": "right", "partial5": "partial5", "partial3": "partial3",
}


def add_tag(layer: Layer, fields: dict[str, str]) -> None:
    """A tag from texts by the names of the columns above."""
    f = {k: "" if v == "-" and k != "sub" else v for k, v in fields.items()}
    mismatches, indels, total = distance(f.get("distance", ""))
    file, start, end = location(f.get("location", ""))
    left, right = trim(f.get("left", "")), trim(f.get("right", ""))
    if left is not None and right is not None:
        raise ValueError("a tag trims to the left or to the right")
    group = f.get("group", "")
    for key, into in (("min_finds_g", layer.min_finds_group), ("max_finds_g", layer.max_finds_group)):
        if int(f.get(key) or 0):
            into[group] = int(f[key])
    tag = Tag(
        "", name=f.get("name", ""), group=group, mismatches=mismatches, indels=indels, total=total, file=file, start=start, end=end, min_finds=int(f.get("min_finds") or 0),
        max_finds=int(f.get("max_finds") or 0), exclude=f.get("exclude", "") == "1", left=left, right=right, after=neighbour(f.get("after", "")), before=neighbour(f.get("before", "")),
        partial5=partial(f.get("partial5", "")), partial3=partial(f.get("partial3", "")), sub=f.get("sub", ""), revcomp=f.get("revcomp", "") == "1",
    )
    seq = f["seq"]
    if re.fullmatch(r"[ACGTacgt/*]+|[ACGTacgt]+:\d+(-\d+)?", seq):
        layer.tags.append(replace(tag, seq=seq.upper(), name=tag.name or seq))
        return
    with open(seq.removesuffix("$")) as listed:
        seqs = [s for line in listed if (s := line.strip().upper()) and not s.startswith("#")]
    if seq.endswith("$"):
        layer.tags += [replace(tag, seq=s, name=f"{tag.name or seq}-{i}") for i, s in enumerate(seqs)]
    else:
        layer.tags.append(replace(tag, seq="/".join(seqs), name=tag.name or seq))


def tag_lists(layer: Layer, tags: str, **columns: str) -> None:
    """Tags from comma lists by column: ``ids``, ``groups``, ``distances`` and so on; one value stands for all where that is usual."""
    seqs = tags.split(",")
    fields: list[dict[str, str]] = [{"seq": s} for s in seqs]
    for column, text in columns.items():
        key = _TAG_COLUMNS[column.rstrip("s") if column.rstrip("s") in _TAG_COLUMNS else column]
        values = text.split(",")
        if len(values) == 1 and key in ("distance", "location", "max_finds", "min_finds", "left", "right"):
            values *= len(seqs)
        for f, v in zip(fields, values, strict=False):
            f[key] = v
    for f in fields:
        add_tag(layer, f)


def ints(text: str) -> list[int]:
    return [int(x or 0) for x in text.split(",")]


def lengths(text: str) -> list[tuple[int, int]]:
    return [(int(a or 0), int(b or 0)) for a, _, b in (x.partition(":") for x in text.split(","))]


def listed(lines: list[str]) -> dict[tuple[str, ...], str]:
    """names <blank> prefix, a line each"""
    rows = [line.split() for line in lines if line.strip() and not line.startswith("#")]
    return {tuple(r[0].split(",")): r[1] if len(r) > 1 else "" for r in rows}


def config(text: str, layer: Layer | None = None) -> Layer:
    """A layer, and its children behind @nest, from the text of a tag table with directives."""
    layer = layer or Layer()
    lines = text.splitlines()
    cut = next((i for i, s in enumerate(lines) if s.rstrip() == "@nest"), len(lines))
    head, blocks, block = None, {}, None
    for line in lines[:cut]:
        if not line.strip():
            block = None
        elif block is not None:
            block.append(line)
        elif line.startswith("@"):
            word, _, rest = line.strip().partition(" ")
            if word in ("@keep:", "@keep-grp:", "@remove:", "@remove-grp:"):
                block = blocks.setdefault(word, [])
            else:
                _directive(layer, word, rest.strip())
        elif line.startswith("#"):
            continue
        elif head is None:
            head = [c.lower() for c in line.split()]
            head = [_TAG_COLUMNS.get(c) or _TAG_COLUMNS[c.rstrip("s")] for c in head]
        else:
            add_tag(layer, {k: "" if v == "-" else v for k, v in zip(head, line.split(), strict=False)})
    layer.keep |= listed(blocks.get("@keep:", []))
    layer.keep_group |= listed(blocks.get("@keep-grp:", []))
    layer.remove |= set(listed(blocks.get("@remove:", [])))
    layer.remove_group |= set(listed(blocks.get("@remove-grp:", [])))
    if cut < len(lines):
        below = "\n".join(lines[cut + 1 :])
        layer.assign_here = layer.assign_here or any(s.strip() == "@assign" for s in lines[:cut])
        layer.child = Layer(prefix=layer.prefix, bclen=layer.bclen, sub_assign=layer.sub_assign, remultiplex=layer.remultiplex)
        layer.child.assign = layer.assign and not layer.assign_here
        layer.child.n_files = (1 if layer.assign_here else 0) + len(layer.names) + (0 if layer.x_only else layer.n_files)
        config(below, layer.child)
        layer.assign = layer.assign_here
    return layer


def _directive(layer: Layer, word: str, rest: str) -> None:
    #: fixed values: the names of directives, here and below
    flags = {"@qtrim-5": "qtrim5", "@qtrim-3": "qtrim3", "@qtrim-pre": "qtrim_pre", "@qtrim-naive": "qtrim_naive", "@phred64": "phred64", "@x-only": "x_only", "@no-tags": "no_tags", "@assign": "assign"}
    if word in flags:
        setattr(layer, flags[word], True)
    elif word == "@extract":
        layer.extracts += extract(rest)
    elif word == "@no-chain":
        layer.no_chain = set(filter(None, rest.replace(" ", "").split(",")))
    elif word in ("@trim-5", "@trim-3"):
        setattr(layer, word[1:].replace("-", ""), ints(rest))
    elif word == "@qtrim":
        layer.qtrim = int(rest)
    elif word == "@min-delta":
        layer.min_delta = int(rest)
    elif word == "@prefix":
        layer.prefix = rest
    elif word == "@filter-len":
        layer.filter_len = lengths(rest)
    elif word == "@from-name":
        layer.placements += placements(rest)
    elif word == "@random":
        layer.placements.append(random_placement(rest))
    elif word == "@barcode-encode":
        layer.encode, layer.assign = rest.replace(" ", "").split(","), True
    elif word == "@sub-barcode-encode":
        layer.sub_encode = rest.replace(" ", "").split(",")
    elif word == "@sub-assign":
        layer.sub_assign = sorted(set(ints(rest)))
    else:
        raise ValueError(f"{word} is unknown")
