"""Source divergence audit: how the words of the sources of a language differ, on integer-encoded dense counts.

Terms are runs of ASCII letters (A-Z lower-cased) and of characters beyond ASCII. Each language keeps the terms that are in
``least`` of its documents or more. Kept terms are numbered in order of UTF-8, languages one after the other, and cut into
chunks of ``WIDTH`` ids. A chunk is one sorted term array; the counts that fall into it get their ids by ``searchsorted``
and become one dense vector a source by ``bincount``, and one for the language. Ids rise with UTF-8, so ties are settled by
the smaller id. A smoothed share p of a term is 1 + floor(10^9 (count + 2) / (N + 2 V)), in whole numbers, and two shares are
apart by f = floor((p - q)^2 / (p + q)). Part ``pair`` sums f of two sources over all kept terms, zero counts included; part
``term`` shows the ``top`` kept terms that a source has more of than its language.

How it is spread: a task counts terms of the texts it reads and sends each (language, source, term) once per ``ENTRIES``
of them; Spark adds up with partial aggregation, so a source or a word with a third of all rows arrives as one row a task.
Rare terms are dropped by a join before anything is grouped, so a chunk has ``WIDTH`` terms times the sources of a language
at most. The list of a language's sources goes to its chunks by a salted join; sums of pairs are added up by Spark. A
chunk compares sources in blocks of ``SOURCES``; what grows with the square of a language's sources is the result itself.
Division is long division by thousands, exact for sums up to 9 * 10^15.

Edge cases: null text, lang and source are ''; texts may have any length; an empty or wordless text adds its group only; rows
that agree in all columns are documents of their own; a language without kept terms has pairs of value 0 and no terms; a
source that is alone in its language has no pairs; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import salted_join, staged
from strandlake.operators.ordering import numbered

LEAST, TOP, WIDTH, SOURCES, ENTRIES = 10, 10, 4096, 256, 200_000
#: bytes of terms as they count, all others as a space
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = ["lang", "source", "term", "n", "docs"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, found) in held.items():
                columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([found[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, _COUNTED)
            held.clear()

        for b in batches:
            for text, lang, source in zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
                own = Counter(bytes(text.as_buffer()).translate(_BYTES).split())
                n, found = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                found.update(own.keys())
                entries += len(n) - before
                if entries > ENTRIES:
                    yield from flushed()
                    entries = 0
        yield from flushed()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _encoded(table: pa.Table) -> pa.Table:
    """Counts of one chunk -> a row a source with its dense vector, and one with the sorted terms and the language's vector."""
    names = np.array([t.as_py().encode() for t in table.column("term")], object)
    terms = np.unique(names)
    ids = np.searchsorted(terms, names)
    sources, at = np.unique(np.array(table.column("source").to_pylist(), object), return_inverse=True)
    n = table.column("n").to_numpy()
    cells = np.zeros((len(sources), len(terms)), np.int64)
    cells.ravel()[np.unique(at * len(terms) + ids)] = _summed(at * len(terms) + ids, n)
    vectors = [*cells, cells.sum(axis=0)]
    k = len(vectors)
    return pa.table({
        "lang": pa.array([table.column("lang")[0].as_py()] * k), "chunk": pa.array([table.column("chunk")[0].as_py()] * k, pa.int64()),
        "source": pa.array([*sources, None], pa.string()), "n": pa.array([int(v.sum()) for v in vectors], pa.int64()), "counts": pa.array(vectors, pa.list_(pa.int64())),
        "terms": pa.array([None] * (k - 1) + [[t.decode() for t in terms]], pa.list_(pa.string())),
    })


def _summed(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n by cell, cells in order: ``bincount`` of the upper and lower halves, exact beyond 2^53."""
    at = np.unique(cells, return_inverse=True)[1]
    return np.bincount(at, n >> 26).astype(np.int64) * (1 << 26) + np.bincount(at, n & ((1 << 26) - 1)).astype(np.int64)


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 v)), exactly."""
    if not v:
        return np.zeros(counts.shape, np.int64)
    whole, rest = np.divmod(counts + 2, total + 2 * v)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (total + 2 * v), rest % (total + 2 * v)
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compared(vectors: pa.Table, chunk: pa.Table, top: int) -> pa.Table:
    """The parts of all values of one language that come from one chunk. chunk: one row of lang, v, total and sources (source, n)."""
    lang, v, total = (chunk.column(c)[0].as_py() for c in ("lang", "v", "total"))
    groups = chunk.column("sources")[0].as_py()
    terms, language, counts = [], np.zeros(0, np.int64), {}
    for source, n, names in zip(*(vectors.column(c) for c in ("source", "counts", "terms")), strict=True):
        if names.is_valid:
            terms, language = names.as_py(), shares(n.values.to_numpy(), total, v)
        else:
            counts[source.as_py()] = n.values.to_numpy()
    none = np.zeros(len(terms), np.int64)
    p = np.stack([shares(counts.get(g["source"], none), g["n"], v) for g in groups])
    names = [g["source"] for g in groups]
    parts: list[tuple[str, str, str, int]] = []
    for a in range(len(names)):
        for begin in range(a + 1, len(names), SOURCES):
            others = p[begin : begin + SOURCES]
            for b, value in enumerate(apart(others, p[a]).sum(axis=1).tolist(), begin):
                parts += [(names[a], "pair", names[b], value), (names[b], "pair", names[a], value)]
    for a, name in enumerate(names):
        if name in counts:
            more = np.flatnonzero((counts[name] > 0) & (p[a] > language))
            value = apart(p[a][more], language[more])
            best = np.argsort(-value, kind="stable")[:top]  # ids rise with UTF-8
            parts += [(name, "term", terms[more[i]], int(value[i])) for i in best]
    columns = list(zip(*parts, strict=True)) or [(), (), (), ()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table({"lang": pa.array([lang] * len(parts), pa.string())} | {c: pa.array(x, k) for c, x, k in zip(("source", "part", "item", "value"), columns, kinds, strict=True)})


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """lang, source, part, item, value, rank."""
    counts = staged(term_counts(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    ids = numbered(terms, ["lang", "term"], "id").select("lang", "term", F.floor(F.col("id") / width).alias("chunk"))
    rows = counts.select("lang", "source", "term", "n").join(ids, ["lang", "term"])
    vectors = "lang string, chunk long, source string, n long, counts array<long>, terms array<string>"
    vectors = staged(rows.groupBy("lang", "chunk").applyInArrow(_encoded, vectors), "term-vectors")
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.size("terms").cast("long")).alias("v"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    known = groups.join(totals.where("source is not null").drop("v"), ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    whole = totals.where("source is null").select("lang", F.col("n").alias("total"), "v")
    langs = known.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")).join(whole, "lang", "left")
    langs = staged(langs.select("lang", F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("v", F.lit(0).cast("long")).alias("v"), "sources"), "term-sources")
    chunks = vectors.where("terms is not null").select("lang", "chunk").unionByName(langs.select("lang", F.lit(-1).cast("long").alias("chunk")))
    sides = staged(salted_join(chunks, langs, ["lang"], F.col("chunk")), "term-sides")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(left, right, top)

    parts = vectors.groupBy("lang", "chunk").cogroup(sides.groupBy("lang", "chunk")).applyInArrow(compared, "lang string, source string, part string, item string, value long")
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return values.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
e AS (SELECT lang, source, term, n FROM c UNION ALL SELECT lang, NULL, term, sum(n) FROM c GROUP BY lang, term),
s AS (SELECT lang, source, sum(n) AS total FROM e GROUP BY lang, source),
p AS (SELECT x.lang, x.source, k.term, coalesce(e.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(e.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v)::HUGEINT AS p
  FROM (SELECT lang, source FROM g UNION ALL SELECT DISTINCT lang, NULL FROM g) x JOIN k ON k.lang = x.lang JOIN v ON v.lang = x.lang
  LEFT JOIN e ON e.lang = x.lang AND e.source IS NOT DISTINCT FROM x.source AND e.term = k.term LEFT JOIN s ON s.lang = x.lang AND s.source IS NOT DISTINCT FROM x.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND a.source <> b.source GROUP BY ALL),
w AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT a.lang, a.source, 'term', a.term, (a.p - b.p) * (a.p - b.p) // (a.p + b.p) FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source IS NULL WHERE a.source IS NOT NULL AND a.n > 0 AND a.p > b.p)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM w) WHERE part = 'pair' OR rank <= {TOP}
"""
