"""From processed reads to records: headers with annotations, barcode and extraction records, segments, and their streams."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequence import barcode, filler
from strandlake.model import Layer
from strandlake.operators.layer import run_layer
from strandlake.sources.staging import staged

#: fixed values: the annotation tags of tag sequences, extractions, ids, sub-ids, barcodes, places
SAM_TAGS = (("CB:Z:",), ("RX:Z:",), ("BI:i:",), ("SI:i:",), ("BC:Z:",), ("LX:Z:",), ("YM:Z:",))


@dataclass
class Output:
    """How reads are written. pipe: all records of a read in one stream; outb: barcodes in a stream of their own."""

    pipe: bool = False
    no_output: bool = False
    fasta: bool = False
    outb: bool = False
    no_outb: bool = False
    no_x_out: bool = False
    unassigned: bool = False
    unassigned_streams: list[bool] = field(default_factory=list)
    empty: str = ""
    empty_remove: bool = False
    select: list[int] | None = None
    keep_comments: bool = False
    name_comments: bool = False
    mod_names: bool = False
    seq_names: bool = False
    com_names: bool = False
    bc_names: bool = False
    loc_names: bool = False
    x_names: bool = False
    sam_tags: tuple[tuple[str, ...], ...] = SAM_TAGS
    limit: int | None = None


def strictly(df_assigned: Column, discard: Column) -> Column:
    return df_assigned & ~discard


def _numbers(layer: Layer) -> tuple[Column, Column]:
    """(the id shown in headers, the barcode bases)"""
    if layer.remultiplex:
        id_ = F.col("run_id").cast("long")
        return id_, barcode(id_, layer.bclen, layer.prefix)
    bases = barcode(F.col("id"), layer.bclen, layer.prefix)
    if layer.sub_encode:
        bases = F.concat(barcode(F.col("sub_id"), layer.bclen, layer.prefix), bases)
    shift = 0  # a prefix counts in front of the digits
    for c in layer.prefix:
        shift = shift * 4 + "ACGT".index(c)
    return F.col("id") + shift * 4**layer.bclen, bases


def header_suffix(layer: Layer, o: Output, deepest: bool = True) -> Column:
    """What a layer adds to the names of a read's records."""
    if layer.no_tags:
        return F.lit("")
    ours = F.col("assigned") | F.col("discard")
    strict = strictly(F.col("assigned"), F.col("discard"))
    listed = F.filter("hits", lambda h: h.listed)
    text, begun = F.lit(""), F.lit(o.keep_comments)

    def add(cond: Column, value: Column) -> None:
        nonlocal text, begun
        cond = F.coalesce(cond, F.lit(False))
        text = F.concat(text, F.when(cond, F.concat(F.when(begun, "\t").otherwise(" "), value)).otherwise(""))
        begun = begun | cond

    if o.mod_names:
        lead = "\t::" if o.keep_comments else "::"
        text = F.when(ours, F.concat(F.lit(lead), F.array_join(F.transform("names", lambda n: F.concat(F.lit("["), n, F.lit("]"))), ""))).otherwise("")
    if o.seq_names:
        stitched = F.array_join(F.transform(listed, lambda h: h.seq), "")
        add(ours & (stitched != ""), F.concat(F.lit(o.sam_tags[0][0]), stitched))
    number, bases = _numbers(layer)
    numbered = layer.assign or layer.remultiplex
    if o.com_names and numbered:
        add(F.col("assigned"), F.concat(F.lit(o.sam_tags[2][0]), number.cast("string")))
    if o.bc_names and numbered:
        add(F.col("assigned"), F.concat(F.lit(o.sam_tags[4][0]), bases))
    if layer.sub_assign and not layer.sub_encode:
        add(F.col("assigned") & F.col("sub_id").isNotNull(), F.concat(F.lit(o.sam_tags[3][0]), F.col("sub_id").cast("string")))
    if o.loc_names:
        places = F.transform("hits", lambda h: F.concat(h["name"], F.lit(":"), h.file.cast("string"), F.lit(","), h.start.cast("string"), F.lit("-"), h.end.cast("string")))
        add(F.size("hits") > 0, F.concat(F.lit(o.sam_tags[5][0]), F.array_join(places, ",")))
    if o.x_names and layer.extracts:
        tags = o.sam_tags[1]
        values = [F.element_at("umis", i + 1).value for i in range(len(layer.names))]
        joined = F.lit(tags[0])
        for i, v in enumerate(values):
            lead = F.lit("" if i == 0 else f"\t{tags[i]}" if i < len(tags) else "-")
            shown = F.when(v == "", F.lit(o.empty)).otherwise(v)
            joined = F.concat(joined, F.when((v == "") & F.lit(o.empty_remove and deepest and i > 0), F.lit("")).otherwise(F.concat(lead, shown)))
        add(strict & (F.concat(*values) != ""), joined)
    return text


def _name(seg: Column, o: Output) -> Column:
    if not (o.keep_comments or o.name_comments):
        return seg["name"]
    return F.concat(seg["name"], F.when(F.coalesce(seg.comment, F.lit("")) != "", F.concat(F.lit(" "), seg.comment)).otherwise(""))


def _record(o: Output, stream: Column, name: Column, seq: Column, qual: Column) -> Column:
    text = F.concat(F.lit(">" if o.fasta else "@"), name, F.lit("\n"), seq, F.lit("\n"))
    if not o.fasta:
        text = F.concat(text, F.lit("+\n"), qual, F.lit("\n"))
    return F.struct(stream.alias("stream"), text.alias("text"), name.alias("name"), seq.alias("seq"), qual.alias("qual"))


_RECORDS = "array<struct<stream:string,text:string,name:string,seq:string,qual:string>>"


def _when(cond: Column, record: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(record)).otherwise(F.array().cast(_RECORDS))


def _umi_quality(value: Column, umi: Column) -> Column:
    return F.when(F.length(umi.qual) == F.length(value), umi.qual).otherwise(filler(F.length(value)))


def records(df: DataFrame, layer: Layer, o: Output) -> DataFrame:
    """A row a record, in order: read_id, nth, stream, text. Streams: pipe, barcodes, out:j, unassigned:j, umi:name, and
    prefix:barcodes or prefix:j for reads whose list has a prefix. Writers partition by stream."""
    n = layer.n_files
    df = df.where("passes").withColumn("_suffix", header_suffix(layer, o))
    strict = strictly(F.col("assigned"), F.col("discard"))
    numbered = layer.assign or layer.remultiplex
    kept = F.coalesce(F.col("ofile"), F.lit("")) != ""
    piped = F.lit(o.pipe) & ~kept
    apart = F.lit(o.outb) | (kept & F.lit(o.pipe and not o.no_outb))
    _, bases = _numbers(layer)
    segs = [F.element_at("out", j + 1) for j in range(n)]
    first = F.concat(_name(segs[0], o), F.col("_suffix"))
    parts = []
    if numbered and not o.no_outb:
        owner = F.col("assigned") if layer.assign else strict
        stream = F.when(piped & ~apart, "pipe").when(kept, F.concat("ofile", F.lit(":barcodes"))).otherwise("barcodes")
        parts.append(_when(owner & (apart | piped), _record(o, stream, first, bases, filler(F.length(bases)))))
    if layer.extracts and not o.no_x_out:
        for i, name in enumerate(layer.names):
            umi = F.element_at("umis", i + 1)
            value = F.when(umi.value == "", F.lit(o.empty)).otherwise(umi.value)
            cond = strict & ~(F.lit(o.empty_remove) & (umi.value == ""))
            parts.append(_when(cond, _record(o, F.when(piped, "pipe").otherwise(f"umi:{name}"), first, value, _umi_quality(value, umi))))
    chosen = [j for j in range(n) if o.select is None or j in o.select]
    for jj, j in enumerate(chosen if not layer.x_only else []):
        s = segs[j]
        bare = F.length(s.seq) == 0
        seq, qual = s.seq, s.qual
        fill = bare & F.lit(o.empty != "")
        seq, qual = F.when(fill, F.lit(o.empty)).otherwise(seq), F.when(fill, filler(F.lit(len(o.empty)))).otherwise(qual)
        skip = bare & F.lit(o.empty_remove and not o.empty)
        if jj == 0 and numbered and not o.no_outb:
            embed = F.col("assigned") & ~apart & ~piped
            seq, qual = (F.when(embed, F.concat(b, raw)).otherwise(x) for b, raw, x in ((bases, s.seq, seq), (filler(F.length(bases)), s.qual, qual)))
            skip = skip & ~embed
        shown = F.lit(True) if not o.unassigned_streams else strict | F.lit(jj < len(o.unassigned_streams) and o.unassigned_streams[jj])
        stream = F.when(~strict, f"unassigned:{jj}").when(piped, "pipe").when(kept, F.concat("ofile", F.lit(f":{jj}"))).otherwise(f"out:{jj}")
        parts.append(_when((strict | F.lit(o.unassigned)) & shown & ~skip, _record(o, stream, F.concat(_name(s, o), F.col("_suffix")), seq, qual)))
    if not parts or o.no_output:
        return df.select("read_id", F.lit(0).alias("nth"), F.lit("").alias("stream"), F.lit("").alias("text")).limit(0)
    return df.select("read_id", F.posexplode(F.concat(*parts)).alias("nth", "r")).select("read_id", "nth", "r.stream", "r.text")


def hand_off(df: DataFrame, layer: Layer, o: Output) -> DataFrame:
    """The reads that a child gets: barcode (if it is made here), extractions and segments, with the names so far."""
    suffix = header_suffix(layer, o, deepest=False)
    first = F.concat(_name(F.element_at("out", 1), o), F.col("_suffix"))
    none = F.lit("")

    def seg(name: Column, seq: Column, qual: Column) -> Column:
        return F.struct(name.alias("name"), none.alias("comment"), seq.alias("seq"), qual.alias("qual"))

    segs = []
    if layer.assign_here:
        _, bases = _numbers(layer)
        segs.append(seg(first, bases, filler(F.length(bases))))
    for i in range(len(layer.names)):
        umi = F.element_at("umis", i + 1)
        value = F.when(umi.value == "", F.lit(o.empty)).otherwise(umi.value)
        segs.append(seg(first, value, _umi_quality(value, umi)))
    for j in range(0 if layer.x_only else layer.n_files):
        s = F.element_at("out", j + 1)
        seq, qual = (F.when((F.length(s.seq) == 0) & F.lit(o.empty != ""), filled).otherwise(x) for filled, x in ((F.lit(o.empty), s.seq), (filler(F.lit(len(o.empty))), s.qual)))
        segs.append(seg(F.concat(_name(s, o), F.col("_suffix")), seq, qual))
    ours = df.where("passes").where(strictly(F.col("assigned"), F.col("discard"))).withColumn("_suffix", suffix)
    return ours.select("read_id", "run_id", F.array(*segs).alias("segs"))


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads in order of read_id, whatever the ids are."""
    return reads.orderBy("read_id").limit(n)


def process(reads: DataFrame, layer: Layer, o: Output) -> tuple[DataFrame, list[tuple[Layer, DataFrame]]]:
    """(records of all layers, [(layer, processed reads) from the outermost in])."""
    if o.limit is not None:
        reads = first_reads(reads, o.limit)
    df = run_layer(reads, layer)
    if layer.child is None:
        return records(df, layer, o), [(layer, df)]
    df = staged(df, "layer")  # its own records, barcodes and what the child gets come from one run
    own = records(df.where(~strictly(F.col("assigned"), F.col("discard"))), layer, o)
    if layer.assign_here and o.outb:
        own = own.unionByName(records(df, layer, o).where("stream = 'barcodes'"))
    inner = Output(**{**o.__dict__, "keep_comments": False, "name_comments": False})
    below, layers = process(hand_off(df, layer, o), layer.child, inner if o.keep_comments or o.name_comments else Output(**{**o.__dict__, "limit": None}))
    return own.unionByName(below), [(layer, df), *layers]
