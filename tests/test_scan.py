"""The fold over candidates against a plain loop, with candidates from constant tables and from seeds; large tag tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.model import Layer, Tag
from strandlake.operators import scan, seeds
from strandlake.operators.layer import run_layer
from strandlake.plans import queries as Q
from strandlake.plans.options import build
from tests.scanner import Scanner

LAYERS = [
    dict(tags="ACGTAC,GGTA", distances="1,0"),
    dict(tags="AGGC,ACCG", distances="2,2", min_delta=0),
    dict(tags="ACGTA,TTGCA,GGAT", distances="1:1:2,0:1:1,1", locations="0:0:12,0:3:20,0:-8:0"),
    dict(tags="ACGT,TTT,GG", groups="a,a,b", maxfinds="1,2,0", minfinds="1,0,1"),
    dict(tags="AC,GT,CA", groups="g,g,h", maxfinds_g="g:2,h:1", minfinds_g="g:1"),
    dict(tags="ACG,TTG", partial5="2:0.3,", partial3=",2:0.4"),
    dict(tags="*AC,GT*,TA", ids="x,y,z", previous=",,{x}0-6"),
    dict(n_files=2, tags="ACG,GT,TTA", next="{{g}}2-9,,", groups=",g,g", distances="0,0,1"),
]


def _reads(rng, n_files):
    read = lambda n: "".join(rng.choice("ACGTACGTACGTN") for _ in range(n))
    rows = [[read(rng.randrange(40)) for _ in range(n_files)] for _ in range(90)]
    return [*rows, ["ACGT" * 150 + "GGTTACG" * 30] * n_files, [""] * n_files]


@pytest.mark.parametrize("options", LAYERS, ids=lambda o: o["tags"])
def test_fold_agrees_with_the_loop(spark, monkeypatch, options):
    layer, _ = build(**options)
    rows = _reads(random.Random(len(options["tags"])), layer.n_files)
    df = spark.createDataFrame(list(enumerate(rows)), "read_id long, _seqs array<string>").repartition(3)
    scanner = Scanner(layer)
    want = {}
    for i, seqs in enumerate(rows):
        hits, unmet = scanner.scan(seqs)
        want[i] = [(p.id, p.file, a, z, e) for p, a, z, e in hits], unmet
    assert sum(len(h) for h, _ in want.values()) > 20
    for most in (1 << 40, -1):
        monkeypatch.setattr(scan, "LITERAL_KMERS", most)
        rows_ = scan.with_found(df, layer).collect()
        assert len(rows_) == len(rows)
        assert {r.read_id: ([(h.pattern, h.file, h.start, h.end, h.err) for h in r.hits], r._unmet) for r in rows_} == want


def test_no_python_in_a_layer(spark):
    layer, _ = build(tags="ACG,GGT", distances="1,0", right="1,", assign=True, extract="{ACG}<u[4]>")
    segs = "array<struct<name:string,comment:string,seq:string,qual:string>>"
    df = spark.createDataFrame([(1, 0, [("r", "", "TTACGTTTT", "#########")])], f"read_id long, run_id int, segs {segs}")
    plan = run_layer(df, layer)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_barcodes(spark):
    """Barcodes of sixteen bases with one error each, in a table whose neighbourhood has millions of k-mers."""
    rng = random.Random(1)
    codes = list({"".join(rng.choice("ACGT") for _ in range(16)) for _ in range(25_000)})
    layer = Layer(tags=[Tag(c, name=c, mismatches=1, total=1, file=0, end=16) for c in codes])
    near: dict[str, set] = {}
    rows = []
    for i in range(300):
        c = list(rng.choice(codes))
        for p in rng.sample(range(16), rng.choice((0, 1, 1, 2))):
            c[p] = rng.choice("ACGTN")
        rows.append("".join(c) + "".join(rng.choice("ACGT") for _ in range(20)))
        near[rows[-1]] = {d for d in codes if sum(a != b for a, b in zip(d, rows[-1], strict=False)) <= 1}
    df = spark.createDataFrame([(i, 0, [("r", "", s, None)]) for i, s in enumerate(rows)], "read_id long, run_id int, segs array<struct<name:string,comment:string,seq:string,qual:string>>")
    got = {r.read_id: [(h.name, h.start, h.end) for h in r.hits] for r in run_layer(df, layer, only=("hits",)).collect()}
    for i, s in enumerate(rows):
        assert got[i] == ([(*near[s], 0, 16)] if len(near[s]) == 1 else [])


def test_seeds_of_odd_tables(spark):
    reads = spark.createDataFrame([(1, ["ACGT"]), (2, [""]), (3, [None])], "_uid long, _seqs array<string>")
    layer, _ = build(tags="A,ACGTT", distances="1,1")
    got = {r._uid: len(r._flat) for r in seeds.seed_candidates(reads, layer, scan.patterns_of(layer)).collect()}
    assert got.get(1, 0) > 0 and not got.get(3)


def test_tags_that_touch(spark, tmp_path):
    """Two tags that touch have nothing between them: the query takes what lies between the second and the third only, as its
    SQL does; without ``x_next`` the first one stays open for the third."""
    duckdb = pytest.importorskip("duckdb")
    made = str.maketrans(Q.HEX, Q.BASES)
    reads = {i: hashlib.md5(f"t{i}".encode()).hexdigest().translate(made) for i in range(20_000)}
    rows = [(i, f"t{i}") for i, s in reads.items() if re.search("ACGACG.*ACG", s)]
    assert len(rows) > 5
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, _ in rows:
        hits = [m.start() for m in re.finditer("ACG", reads[i])]
        want[i] = "".join(reads[i][a + 3 : b] for a, b in zip(hits, hits[1:], strict=False))
    got = {r.read_id: r.value for r in Q.umi_between(spark, str(tmp_path)).collect()}
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert dict(con.sql(Q.SQL["umi_between"]).fetchall()) == want
    layer, _ = build(tags="ACG", extract="{ACG}<u>{ACG}")
    segs = "array<struct<name:string,comment:string,seq:string,qual:string>>"
    df = spark.createDataFrame([(1, 0, [("r", "", "TTACGACGTTTACGTT", "#" * 16)])], f"read_id long, run_id int, segs {segs}")
    assert run_layer(df, layer).first().umis[0].value == "ACGTTTTTT"


@pytest.mark.parametrize(("errors", "place"), [(0, {}), (1, dict(end=14)), (2, dict(start=3, end=20)), (1, dict(start=-15))])
def test_listed_tags(spark, errors, place):
    """Tags that come as a table give what the same tags in a layer's list give."""
    rng = random.Random(errors + 7)
    codes = list({"".join(rng.choice("ACGT") for _ in range(rng.choice((7, 9, 11)))) for _ in range(900)})
    rows = []
    for i in range(300):
        s = list("".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 6))) + rng.choice(codes) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12))))
        s[rng.randrange(len(s))] = rng.choice("ACGTN")
        rows.append((i, 0, [("r", "", "".join(s), None)]))
    df = spark.createDataFrame(rows, "read_id long, run_id int, segs array<struct<name:string,comment:string,seq:string,qual:string>>")
    rules = dict(mismatches=errors, total=errors, file=0, max_finds=2, **place)
    table = spark.createDataFrame([(c, f"t{c[:2]}") for c in codes + codes[:9]], "seq string, name string")
    one = Layer(tags=[Tag(c, name=f"t{c[:2]}", **rules) for c in sorted(codes)])
    found = [{r.read_id: r.hits for r in run_layer(df, layer, only=("hits",)).collect()} for layer in (one, Layer(listed=table, listed_as=Tag("", **rules)))]
    assert found[0] == found[1] and sum(map(len, found[0].values())) > 30


def test_listed_tags_are_checked(spark):
    df = spark.createDataFrame([(1, 0, [("r", "", "ACGT", None)])], "read_id long, run_id int, segs array<struct<name:string,comment:string,seq:string,qual:string>>")
    for seq, rules in (("ACX", {}), ("ACGTA", dict(end=4)), ("A", dict(mismatches=1, total=1)), ("ACGT", dict(indels=1, total=1))):
        with pytest.raises(ValueError):
            run_layer(df, Layer(listed=spark.createDataFrame([(seq, "x")], "seq string, name string"), listed_as=Tag("", file=0, **rules)), only=("hits",))


def test_barcode_list_leaves_the_list_in_spark(spark, tmp_path, monkeypatch):
    """The query makes no Python object a barcode: the driver held them all, with their patterns."""
    spark.range(1, 3000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(Q, "Tag", lambda *a, **b: made.append(a) or Tag(*a, **b))
    assert Q.barcode_list(spark, str(tmp_path)).count() == 50 and len(made) == 1
