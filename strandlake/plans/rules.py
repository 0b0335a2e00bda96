"""Queries over the rules of tags, extractions, assignment, nested layers and reports, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import summary
from strandlake.operators.layer import run_layer
from strandlake.operators.render import process
from strandlake.plans.options import build
from strandlake.plans.queries import _K, _PAIR, _P, _R, _code, _greedy, _layer, _mismatches, _out, _places, _umi, query, reads


def _scan(tags: list[str], also: str = "", first: str = "", state: str = "", begin: str = "") -> str:
    """SQL: as ``_greedy``, with a condition on the next hit, one on the first, and a state that hits carry (h.s)."""
    name = "CASE " + " ".join(f"WHEN seq[pos + 1:pos + {len(t)}] = '{t}' THEN '{t}'" for t in sorted(tags, key=len, reverse=True)) + " END"
    state, begin = state or "0", begin or "0"
    return f"""WITH RECURSIVE {_R}, p AS (SELECT read_id, seq, unnest(range(0, 32)) AS pos FROM r), e AS (SELECT read_id, pos, {name} AS name FROM p), q AS (SELECT * FROM e WHERE name IS NOT NULL),
f AS (SELECT read_id, min(pos) AS pos, arg_min(name, pos) AS name FROM q {f'WHERE {first}' if first else ''} GROUP BY read_id),
h AS (SELECT read_id, 1 AS nth, pos, name, {begin} AS s FROM f
  UNION ALL SELECT read_id, nth, pos, name, {state} AS s FROM (SELECT h.read_id, h.nth + 1 AS nth, h.s AS s, min(q.pos) AS pos, arg_min(q.name, q.pos) AS name FROM h JOIN q ON q.read_id = h.read_id AND q.pos >= h.pos + len(h.name) {f'AND {also}' if also else ''} GROUP BY h.read_id, h.nth, h.s) z)"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("read_id", F.posexplode("hits").alias("nth", "h")).select("read_id", (F.col("nth") + 1).alias("nth"), "h.start", "h.name")


# tags


@query(_scan(["ACG", "CA", "GTT"], also="h.name <> 'GTT'", first="name = 'ACG'") + " SELECT read_id, nth, pos AS start, name FROM h")
def star_tags(spark, sf_dir):
    """The scan begins with an initiator and ends with a terminator."""
    return _hits(_layer(spark, sf_dir, only="hits", tags="*ACG,CA,GTT*", ids="ACG,CA,GTT"))


@query(_scan(["AACG", "CGTT"]) + " SELECT read_id, nth, pos AS start, 'AACG' AS name FROM h")
def revcomp_tag(spark, sf_dir):
    return _hits(_layer(spark, sf_dir, only="hits", tags="AACG", revcomp="1"))


@query(_scan(["ACG", "GT"], also="(h.name <> 'ACG' OR (q.name = 'GT' AND q.pos <= h.pos + 7))") + " SELECT read_id, nth, pos AS start, name FROM h")
def next_tag(spark, sf_dir):
    """Behind ACG only a GT within four bases counts, else the scan ends."""
    return _hits(_layer(spark, sf_dir, only="hits", tags="ACG,GT", next="{GT}0-4,"))


@query(_greedy(["ACG", "CGT", "GTT"]) + ", v AS (SELECT read_id, string_agg(name, ',' ORDER BY nth) AS names FROM h WHERE name <> 'ACG' GROUP BY read_id) SELECT read_id, coalesce(names, '') AS names FROM r LEFT JOIN v USING (read_id)")
def exclude_tag(spark, sf_dir):
    """An excluded tag takes its place in the scan, but none in the list."""
    return _layer(spark, sf_dir, only="names", tags="ACG,CGT,GTT", exclude="1,0,0").select("read_id", F.array_join("names", ",").alias("names"))


@query(_scan(["ACG", "CGT", "GTT"], also="(q.name = 'GTT' OR h.s < 2)", state="z.s + (z.name <> 'GTT')::INT", begin="(name <> 'GTT')::INT") + " SELECT read_id, nth, pos AS start, name FROM h")
def group_limit(spark, sf_dir):
    """Two hits of one group at most; further ones take no place."""
    return _hits(_layer(spark, sf_dir, only="hits", tags="ACG,CGT,GTT", groups="a,a,b", maxfinds_g="a:2"))


@query(f"WITH {_R} SELECT read_id, len(regexp_extract_all(seq, 'CA|TG')) >= 4 AS kept FROM r")
def group_least(spark, sf_dir):
    return _layer(spark, sf_dir, only="names", tags="CA,TG", groups="a,a", minfinds_g="a:4").select("read_id", (F.size("names") > 0).alias("kept"))


_INSERTED = "(seq[pos + 1:pos + 5] SIMILAR TO 'A[CGT]CGT|AC[ACGT]GT|ACG[ACGT]T|[ACGT]ACGT|ACGT[ACGT]' AND NOT contains(seq[pos + 1:pos + 5], 'ACGT'))"


@query(f"""{_P} SELECT read_id, pos, 4 AS k, 0 AS err FROM p WHERE seq[pos + 1:pos + 4] = 'ACGT' UNION ALL SELECT read_id, pos, 3, 1 FROM p WHERE pos <= 29 AND seq[pos + 1:pos + 3] IN ('CGT', 'AGT', 'ACT', 'ACG')
UNION ALL SELECT read_id, pos, 5, 1 FROM p WHERE pos <= 27 AND {_INSERTED}""")
def indel_match(spark, sf_dir):
    return _places(spark, sf_dir, tags="ACGT", distances="0:1").select("read_id", "pos", "k", "err")


@query(f"""{_P}, m AS (SELECT read_id, pos, {_mismatches('ACGT')} AS err FROM p WHERE pos <= 28) SELECT read_id, pos, 4 AS k, err FROM m WHERE err <= 1
UNION ALL SELECT read_id, pos, 3, 1 FROM p WHERE pos <= 29 AND seq[pos + 1:pos + 3] IN ('CGT', 'AGT', 'ACT', 'ACG') UNION ALL SELECT read_id, pos, 5, 1 FROM p WHERE pos <= 27 AND {_INSERTED}""")
def combined_match(spark, sf_dir):
    """A substitution or an indel, one error in all."""
    return _places(spark, sf_dir, tags="ACGT", distances="1:1:1").select("read_id", "pos", "k", "err")


@query(f"WITH {_R}, l AS (SELECT *, coalesce(len(regexp_extract(seq[1:8], '^(.*ACG)', 1)), 0) AS cut FROM r) SELECT read_id, seq[cut + 1:30] AS seq, qual[cut + 1:30] AS qual FROM l")
def config_table(spark, sf_dir):
    """A tag table with a directive."""
    return _out(_layer(spark, sf_dir, config="# a comment\n@trim-3 2\ntag\tid\tlocation\tleft\nACG\tx\t0:0:8\t1\n"))


# cutting


@query(f"WITH {_R}, l AS (SELECT read_id, seq[33 - len(ltrim(qual, '#%&(*,')):][1:5] AS s FROM r) SELECT read_id, instr(s, 'ACG') - 1 AS start FROM l WHERE instr(s, 'ACG') > 0")
def quality_trim_first(spark, sf_dir):
    """A quality trim before the scan moves the places of tags."""
    df = _layer(spark, sf_dir, only="hits", tags="ACG", locations="0:0:5", qtrim=12, qtrim_5=True, qtrim_naive=True, qtrim_pre=True)
    return df.select("read_id", F.explode("hits").alias("h")).select("read_id", "h.start")


@query(f"WITH {_R} SELECT read_id, contains(seq[3:32], 'ACG') AS assigned, CASE WHEN contains(seq[3:32], 'ACG') THEN seq[3:32] ELSE seq END AS seq FROM r")
def trim_if_assigned(spark, sf_dir):
    df = _layer(spark, sf_dir, tags="ACG", trim_5="2", assign=True)
    return df.select("read_id", "assigned", F.element_at("out", 1).seq.alias("seq"))


@query(f"WITH {_R} SELECT read_id, seq[1:5] AS value FROM r")
def umi_from_name(spark, sf_dir):
    """What is found in the header comment goes to an extraction."""
    return _umi(_layer(spark, sf_dir, only="umis", from_name="0,0,-1,::", extract="<u{:}>")).select("read_id", "value")


# extraction


@query(f"WITH {_R} SELECT read_id, seq[3:9] AS value, qual[3:9] AS qual FROM r")
def umi_locations(spark, sf_dir):
    return _umi(_layer(spark, sf_dir, only="umis", extract="0:2<u>0:9"))


@query(f"WITH {_R} SELECT read_id, CASE WHEN instr(seq, 'ACG') > 0 AND instr(seq, 'ACG') + 2 < 20 THEN seq[instr(seq, 'ACG') + 3:20] ELSE '' END AS value FROM r")
def umi_tag_to_location(spark, sf_dir):
    return _umi(_layer(spark, sf_dir, only="umis", tags="ACG", maxfinds="1", extract="{ACG}<u>0:20")).select("read_id", "value")


@query(f"""{_P}, m AS (SELECT read_id, min(pos) AS pos FROM (SELECT read_id, pos, {_mismatches('ACGTAC')} AS err FROM p WHERE pos <= 26) WHERE err <= 1 GROUP BY read_id)
SELECT read_id, CASE WHEN pos IS NULL THEN '' ELSE 'ACGTAC' END AS tag, coalesce(seq[pos + 1:pos + 6], '') AS bases FROM r LEFT JOIN m USING (read_id)""")
def tag_sequence(spark, sf_dir):
    """The tag as it is written, and as the read has it."""
    df = _layer(spark, sf_dir, only="umis", tags="ACGTAC", ids="t", distances="1", maxfinds="1", extract="<u{t}>,<v{@t}>")
    return df.select("read_id", F.element_at("umis", 1).value.alias("tag"), F.element_at("umis", 2).value.alias("bases"))


@query(f"WITH {_R}, l AS (SELECT read_id, seq, coalesce(len(regexp_extract(seq, '^(.*?ACG).', 1)), 0) AS behind FROM r) SELECT read_id, CASE WHEN behind > 0 THEN seq[behind + 1] ELSE '' END AS value FROM l")
def umi_not_chained(spark, sf_dir):
    """Only the first value of a name."""
    return _umi(_layer(spark, sf_dir, only="umis", tags="ACG", extract="{ACG}<u[1]>", no_chain=True)).select("read_id", "value")


@query(f"WITH {_R} SELECT read_id, CASE WHEN contains(seq, 'ACG') THEN seq[1:4] ELSE '' END AS value FROM r WHERE contains(seq, 'ACG')")
def umi_of_assigned(spark, sf_dir):
    """Extractions are written for assigned reads only."""
    layer, o = build(tags="ACG", assign=True, extract="0:0<u[4]>", no_outb=True)
    rows = process(reads(spark, sf_dir), layer, o)[0].where("stream = 'umi:u'")
    return rows.select("read_id", F.element_at(F.split("text", "\n"), 2).alias("value"))


# assignment


@query(f"WITH {_R} SELECT read_id, {_code(1)} - 1 + 17 * ({_code(3)} - 1) AS id, {_code(3)} - 1 AS sub_id FROM r")
def sub_encode(spark, sf_dir):
    """A second code over some of the groups."""
    layer, _ = build(assign=True, barcode_encode="x,y", **_PAIR)
    layer.sub_encode = ["y"]
    return run_layer(reads(spark, sf_dir), layer).select("read_id", "id", "sub_id")


@query(f"WITH {_R} SELECT count(*) AS n_processed, count(*) FILTER (contains(seq, 'ACG')) AS n_assigned, count(*) FILTER (instr(seq, 'ACG') BETWEEN 1 AND 10) AS n_filtered, count(*) FILTER (instr(seq, 'ACG') BETWEEN 1 AND 10) AS n_filtered_assigned FROM r")
def read_counts(spark, sf_dir):
    return summary.counts(_layer(spark, sf_dir, tags="ACG", right="1", filter_len="10", assign=True))


@query(f"WITH {_R}, k AS (SELECT {_K} AS names FROM r) SELECT count(*) FILTER (names NOT IN ('xAA,yAA', 'xAC,yGT')) AS n_assigned FROM k")
def assigned_count(spark, sf_dir):
    return summary.counts(_layer(spark, sf_dir, remove="xAA,yAA\nxAC,yGT", assign=True, **_PAIR)).select("n_assigned")


@query(f"WITH {_R}, k AS (SELECT read_id, {_K} AS names FROM r), l AS (SELECT 'x' || a.c || b.c || ',y' || d.c || e.c AS names FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS c) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) b, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) d, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) e) SELECT read_id, names NOT LIKE 'xT%' AS kept FROM k JOIN l USING (names)")
def keep_many_lists(spark, sf_dir):
    """More lists than an expression takes are a table that is joined."""
    keep = "\n".join(f"x{a}{b},y{c}{d} p{a}" for a in "ACG" for b in "ACGT" for c in "ACGT" for d in "ACGT") + "\n" + "\n".join(f"x{i},y{i}" for i in range(400))
    return _layer(spark, sf_dir, only="discard", keep=keep, **_PAIR).select("read_id", (~F.col("discard")).alias("kept"))


# nested layers


@query(_greedy(["ACG"]) + """, a AS (SELECT read_id, string_agg('[ACG]', '') AS t FROM h GROUP BY read_id),
b AS (SELECT read_id, repeat('[GTT]', len(regexp_extract_all(seq, 'GTT'))) AS t FROM r) SELECT read_id, '>r' || read_id || '::' || coalesce(a.t, '') || '::' || b.t AS name FROM r LEFT JOIN a USING (read_id) JOIN b USING (read_id)""")
def nested_names(spark, sf_dir):
    """Each layer adds its tags to the name."""
    layer, o = build(config="tags\nACG\n\n@nest\n\ntags\nGTT\n", pipe=True, fasta=True, mod_names=True)
    return process(reads(spark, sf_dir), layer, o)[0].select("read_id", F.element_at(F.split("text", "\n"), 1).alias("name"))


@query(f"WITH {_R} SELECT read_id, '>r' || read_id || chr(10) || seq[3:8] || seq[9:10] || chr(10) AS text FROM (SELECT read_id, seq FROM r)")
def nested_extraction(spark, sf_dir):
    """What the first layer extracts is the segment of the second."""
    layer, o = build(config="@x-only\n@extract 0:2<u[8]>\n\n@nest\n\n@trim-5 0\n", pipe=True, fasta=True)
    return process(reads(spark, sf_dir), layer, o)[0].select("read_id", "text")


# reports


@query(f"WITH {_R}, l AS (SELECT 32 - len(rtrim(qual, '#%&(*,')) AS n FROM r) SELECT 0 AS file, sum(n)::BIGINT AS bases_quality_3, count(*) FILTER (n > 0) AS reads_quality_3, 0 AS bases_quality_5 FROM l")
def quality_summary(spark, sf_dir):
    return summary.trims(_layer(spark, sf_dir, qtrim=12, qtrim_3=True, qtrim_naive=True)).select("file", "bases_quality_3", "reads_quality_3", "bases_quality_5")


@query(f"WITH {_R}, l AS (SELECT coalesce(len(regexp_extract(seq, '^(.*ACG)', 1)), 0) AS n FROM r) SELECT 'ACG' AS name, 3 AS match_length, count(*) AS reads, 0 AS errors, sum(n)::BIGINT AS cut_left, 0 AS cut_right FROM l WHERE n > 0 GROUP BY 1, 2")
def tag_trim_summary(spark, sf_dir):
    return summary.trimming_tags(_layer(spark, sf_dir, tags="ACG", left="1"))


@query(f"WITH {_R} SELECT 3 AS n_tags, 2 AS n_names, 1 AS n_groups, 3 AS n_kmers, 1 AS n_extractions, count(*) AS n_reads, count(*) FILTER (contains(seq, 'ACG') OR contains(seq, 'CGT') OR contains(seq, 'GTT')) AS n_found FROM r")
def tag_table(spark, sf_dir):
    """The figures of a tag table, and how many reads have any of its tags."""
    layer, _ = build(tags="ACG/CGT,GTT", groups="a,", extract="{ACG/CGT}<u[4]>")
    rows = run_layer(reads(spark, sf_dir), layer, only=("hits",))
    table = [F.lit(v).alias(k) for k, v in summary.tag_table(layer).items()]
    return rows.agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.size("hits") > 0).alias("n_found")).select(*table, "n_reads", "n_found")


@query(f"WITH {_R} SELECT count(*) AS n_processed, count(*) FILTER (contains(seq, 'ACG')) AS n_assigned, count(*) FILTER (instr(seq, 'ACG') BETWEEN 1 AND 10) AS n_filtered, count(*) FILTER (instr(seq, 'ACG') BETWEEN 1 AND 10) AS n_filtered_assigned FROM r")
def read_counts(spark, sf_dir):
    return summary.counts(_layer(spark, sf_dir, tags="ACG", right="1", filter_len="10", assign=True))


@query(f"WITH {_R}, k AS (SELECT {_K} AS names FROM r) SELECT count(*) FILTER (names NOT IN ('xAA,yAA', 'xAC,yGT')) AS n_assigned FROM k")
def assigned_count(spark, sf_dir):
    return summary.counts(_layer(spark, sf_dir, remove="xAA,yAA\nxAC,yGT", assign=True, **_PAIR)).select("n_assigned")


@query(f"WITH {_R}, k AS (SELECT read_id, {_K} AS names FROM r), l AS (SELECT 'x' || a.c || b.c || ',y' || d.c || e.c AS names FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS c) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) b, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) d, (SELECT unnest(['A', 'C', 'G', 'T']) AS c) e) SELECT read_id, names NOT LIKE 'xT%' AS kept FROM k JOIN l USING (names)")
def keep_many_lists(spark, sf_dir):
    """More lists than an expression takes are a table that is joined."""
    keep = "\n".join(f"x{a}{b},y{c}{d} p{a}" for a in "ACG" for b in "ACGT" for c in "ACGT" for d in "ACGT") + "\n" + "\n".join(f"x{i},y{i}" for i in range(400))
    return _layer(spark, sf_dir, only="discard", keep=keep, **_PAIR).select("read_id", (~F.col("discard")).alias("kept"))


@query(f"WITH {_R} SELECT count(*) AS n_processed, count(*) FILTER (contains(seq, 'ACG')) AS n_assigned, 3 AS k FROM r")
def summary_json(spark, sf_dir):
    """The report as JSON, and some of its fields."""
    layer, _ = build(tags="ACG", assign=True)
    report = summary.as_json(run_layer(reads(spark, sf_dir), layer), layer)
    return report.select(*[F.get_json_object("summary", f"$.{k}").cast("long").alias(k) for k in ("n_processed", "n_assigned")], (F.get_json_object("summary", "$.tag_table.n_kmers").cast("int") + 2).alias("k"))
