"""A layer and its output from options by their long names, as a user of a command line knows them."""

from __future__ import annotations

from strandlake.model import Layer
from strandlake.operators.render import SAM_TAGS, Output
from strandlake.plans import parse

_TAG_LISTS = ("distances", "locations", "ids", "groups", "minfinds", "maxfinds", "exclude", "left", "right", "next", "previous", "subs", "partial5", "partial3", "revcomp")
_FLAGS = ("pipe", "no_output", "fasta", "outb", "no_outb", "no_x_out", "unassigned", "empty_remove", "keep_comments", "mod_names", "seq_names", "com_names", "bc_names", "loc_names", "x_names")


def build(n_files: int = 1, tags: str = "", config: str = "", assign: bool = False, **options) -> tuple[Layer, Output]:
    """Options, all by name: tag lists (``distances="1,1"``, ``previous="{{g}}0-5,"`` ...), ``extract``, ``trim_5``, ``trim_3``,
    ``filter_len``, ``qtrim`` and its flags, ``min_delta``, ``no_chain``, ``prefix``, ``bclen``, ``barcode_encode``,
    ``sub_assign``, ``from_name``, ``random``, ``keep``, ``keep_grp``, ``remove``, ``remove_grp`` (texts), ``minfinds_g``,
    ``maxfinds_g`` ("group:n,..."), ``remultiplex``, ``x_next``, ``x_only``, and those of the output. Unknown names are errors.
    """
    opts = dict(options)
    layer = Layer(n_files=n_files, assign=assign)
    for name in ("qtrim", "bclen", "min_delta", "prefix", "x_next", "x_only", "remultiplex", "phred64"):
        if name in opts:
            setattr(layer, name, opts.pop(name))
    for name, into in (("qtrim_5", "qtrim5"), ("qtrim_3", "qtrim3"), ("qtrim_pre", "qtrim_pre"), ("qtrim_naive", "qtrim_naive")):
        if name in opts:
            setattr(layer, into, opts.pop(name))
    for name, into, f in (
        ("trim_5", "trim5", parse.ints), ("trim_3", "trim3", parse.ints), ("filter_len", "filter_len", parse.lengths), ("barcode_encode", "encode", lambda t: t.split(",")),
        ("sub_assign", "sub_assign", lambda t: sorted(set(parse.ints(t)))), ("keep", "keep", lambda t: parse.listed(t.splitlines())), ("keep_grp", "keep_group", lambda t: parse.listed(t.splitlines())),
        ("remove", "remove", lambda t: set(parse.listed(t.splitlines()))), ("remove_grp", "remove_group", lambda t: set(parse.listed(t.splitlines()))), ("from_name", "placements", parse.placements),
        ("extract", "extracts", parse.extract), ("no_chain", "no_chain", lambda t: set() if t is True else set(filter(None, t.split(",")))),
    ):
        if name in opts:
            setattr(layer, into, f(opts.pop(name)))
    if "random" in opts:
        layer.placements.append(parse.random_placement(opts.pop("random")))
    for name, into in (("minfinds_g", layer.min_finds_group), ("maxfinds_g", layer.max_finds_group)):
        if name in opts:
            into |= {g: int(n) for g, _, n in (x.partition(":") for x in opts.pop(name).split(","))}
    lists = {k: opts.pop(k) for k in _TAG_LISTS if k in opts}
    if tags:
        parse.tag_lists(layer, tags, **lists)
    out = Output(**{k: opts.pop(k) for k in _FLAGS if k in opts}, name_comments=bool(options.get("from_name")))
    out.empty = opts.pop("empty", "").upper()
    out.limit = opts.pop("limit", None)
    out.unassigned_streams = opts.pop("unassigned_streams", [])
    if "select" in opts:
        out.select = parse.ints(opts.pop("select"))
    if "sam_tags" in opts:
        given = [tuple(t.split("/")) for t in opts.pop("sam_tags").split(",")]
        out.sam_tags = (*given, *SAM_TAGS[len(given) :])
    if opts:
        raise TypeError(f"unknown options: {', '.join(opts)}")
    if config:
        parse.config(config, layer)
    return layer, out
