import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from strandlake.llm import quality
from tests.llm import helpers

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _tables(spark, folder, rows, labels):
    kind = "doc_id long, text string, lang string, source string, n_chars long, target double, _row string, _sha string"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, "r", "x") for i, t, s in rows], kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def _rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def _largest(rows):
    """One row of equal texts: the largest id."""
    by = defaultdict(list)
    for r in rows.elements():
        by[r[1] or ""].append(r)
    return {t: max((r[0] for r in rs if r[0] is not None), default=None) for t, rs in by.items()}


def test_stages(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version."""
    rows = [(r[0], r[1], r[3]) for r in helpers.docs_rows()]
    rows += [(100 + i, f"{'clean words go on ' * 3}{i} " * 3, "ab"[i % 2]) for i in range(40)] + [(200 + i, f"x{i} | y{i} | z{i} | " * 12, "a") for i in range(20)]
    labels = [(i, 1, 0) for i in range(100, 140)] + [(i, 0, 0) for i in range(200, 220)] + [(4, None, 0), (None, 1, 1), (100, 1, 1)]
    docs, sf = _tables(spark, str(tmp_path), rows, labels), str(tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]

    good = stage["quality classifier"](spark, docs, sf)
    assert good.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = dict(zip([r[1] for r in rows], model.score([r[1] for r in rows])))
    want = Counter(r for r in rows if score[r[1]] >= 0.7)
    assert _rows(good) == want and not any(200 <= (i or 0) < 220 for i, *_ in want) and sum(100 <= (i or 0) < 140 for i, *_ in want) == 40

    one = stage["exact dedup"](spark, good, sf)
    assert one.columns == docs.columns
    got, keep = _rows(one), _largest(want)
    assert Counter((i, t or "") for i, t, _ in got.elements()) == Counter((i, t) for t, i in keep.items()) and not got - want

    near = stage["n-gram Jaccard join"](spark, one, sf)
    assert near.columns == docs.columns
    classes = helpers.near_copies([(i, t) for i, t, _ in got.elements()])
    left = _rows(near)
    assert not left - got
    assert Counter(i for i, *_ in left.elements() if i not in (None, 18)) == Counter({c[1]: 1 for c in classes if c[1] not in (None, 18)})

    mixed = stage["mixing sources"](spark, near, sf)
    assert mixed.columns == docs.columns
    size = defaultdict(int)
    for _, t, s in left.elements():
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, copies = defaultdict(int), _rows(mixed)
    for _, t, s in copies.elements():
        taken[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert not set(copies) - set(left) and max(copies.values()) <= 2
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, budget, clamped = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), set()
    while True:
        rest = budget - sum(2 * size[s] for s in clamped)
        free = sum(weight[s] for s in names if s not in clamped)
        target = {s: 2 * size[s] if s in clamped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in clamped and target[s] > 2 * size[s]}
        if not over:
            break
        clamped |= over
    longest = {s: max((len((t or "").split()) for _, t, z in left.elements() if z == s), default=0) for s in names}
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in names)

    tokens = stage["byte-level BPE"](spark, mixed, sf).collect()
    with open(BYTE_BPE, "rb") as f:
        import base64

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want_ids = Counter((i, tuple(plain.encode_ordinary(t or ""))) for i, t, _ in copies.elements())
    assert Counter((r.doc_id, tuple(r.ids)) for r in tokens) == want_ids and all(r.n_tokens == len(r.ids) for r in tokens)
    assert Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == want_ids


def test_empty_tables(spark, tmp_path):
    _tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_and_no_words(spark, tmp_path):
    _tables(spark, str(tmp_path), [(1, None, "a"), (2, "", None), (2, "", None)], [(1, None, 0)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_python_gets_small_batches(spark):
    """Long texts come to Python some megabytes at a time, and a worker keeps what one operator needs only."""
    import pyarrow as pa

    from strandlake.llm import common

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 512), 40) AS text").coalesce(1)
    corpus_pipeline.encode_texts(spark, docs, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(found) > 2 and sum(found) > 3000 * 5120 and max(found) < 2 * common.BATCH_BYTES
    one = common.kept("one", list)
    assert common.kept("one", list) is one and common.kept("two", dict) == {} and common.kept("one", list) is not one
