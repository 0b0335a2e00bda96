"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of runs of ``SHINGLE`` words (a shorter text is its one run of all words); two texts are linked if the
Jaccard similarity of their sets is ``THRESHOLD`` or more. Equal texts are one text with a number of copies.

1. Every text gets ``HASHES`` MinHash values, kept to 8 bits, and ``HASHES / ROWS`` keys of ``ROWS`` values of 16 bits each.
   Texts that share a key are candidates: two linked texts share none with a probability of 5e-8 at the threshold itself.
   Lower thresholds get keys of fewer values (``band_rows``), down to about 0.12; below that there is an error.
2. Candidates compare their MinHash values ``STEP`` at a time and are dropped as soon as the posterior probability that
   their similarity reaches the threshold (uniform prior, binomial likelihood) falls below ``TOLERANCE``. Candidates that
   stay are joined to clusters; a cluster holds at least all texts that are linked to each other.
3. In each cluster all pairs are pruned in the same way and what stays is verified exactly, on the sets themselves. That
   gives each text its number of links, and the clusters fall apart into the classes that links connect.

A key with more than ``KEY_SIDE`` texts, or a cluster with more than ``CLUSTER_SIDE``, is cut into blocks, and each pair of
blocks is a group of its own, so no task holds more than two blocks. Groups compare in arrays and give a row a text: pairs
are never rows. Exact sets are of runs numbered by their words, no hashes. Texts that are in no cluster stay where they
are: a bitmap of bounded size sorts most of them out before the exchange.

Edge cases: texts may have any length (a group of long texts takes as much more memory); a null text is the empty text, which has no runs and no links, only copies; rows with equal text are copies of
each other, whatever their id; a null id is never the name of a class with other ids. An empty table gives an empty table.
Other columns are ignored by ``near_copies`` and pass through ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import components, fold_repeats, keep_one, kept, maybe_among, repeated_rows, salted_join, small_batches, staged
from strandlake.llm.substring import Words, _mixed

SHINGLE, THRESHOLD, HASHES, ROWS, STEP, TOLERANCE, MISSED = 5, 0.8, 128, 4, 16, 1e-6, 1e-7
KEY_SIDE, CLUSTER_SIDE = 1024, 256
BLOCK_BYTES, TEXT_BYTES, CHUNK_ROWS, SLICE_ROWS = 2 << 20, 1 << 19, 20_000, 500
_SEEDS = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_XOR, _TIMES = _SEEDS[:HASHES].astype(np.uint32), _SEEDS[HASHES:].astype(np.uint32) | np.uint32(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Values compared -> the fewest matches with which the posterior of reaching the threshold is at least the tolerance.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its mass from t on is the
    probability of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def band_rows(threshold: float) -> int:
    """Values a key: as many, up to ``ROWS``, as let two texts at the threshold share no key with a probability of ``MISSED`` at most."""
    for rows in (r for r in (4, 2, 1) if r <= ROWS):
        if (1 - threshold**rows) ** (HASHES // rows) <= MISSED:
            return rows
    raise ValueError(f"{HASHES} MinHash values don't find all links at a threshold of {threshold}")


def _in_blocks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """texts, about TEXT_BYTES at a time: the arrays over their words stay small."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < TEXT_BYTES:
            size += len(texts[end] or b"")
            end += 1
        yield texts[at:end]
        at = end


def shingles(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of texts, and how many each text has; in the order of the texts."""
    parts = [_shingles(Words(block), size) for block in _in_blocks(texts)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = [w.runs(size), *(w.first[w.count == n] for n in range(1, size))]
    h = np.concatenate([w.hashes(a, n) for a, n in zip(at, [size, *range(1, size)], strict=True)])
    doc = np.concatenate([w.doc[a] for a in at]) if len(w.doc) else np.zeros(0, np.int64)
    return h[np.argsort(doc, kind="stable")], np.bincount(doc, minlength=len(w.count))


def numbered_runs(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of each run of words: runs have the same number if, and only if, their words are the same.

    Words are numbered by the words themselves; a longer run by its first part and its last word, a power of two at a time.
    """
    at, code, length = w.runs(size), w.id, 1
    while 2 * length <= size:
        n = len(code) - length
        code = _numbers(code[:n] if n > 0 else code[:0], code[length:])
        length *= 2
    last = code[at] if len(at) else np.zeros(0, np.int64)
    for k in range(length, size):
        last = _numbers(last, w.id[at + k])
    short = np.flatnonzero((w.count > 0) & (w.count < size))  # a text below the size is one run
    whole: dict[tuple[int, ...], int] = {}
    base = int(last.max()) + 1 if len(last) else 0
    own = np.array([base + whole.setdefault(tuple(w.id[a : a + n].tolist()), len(whole)) for a, n in zip(w.first[short], w.count[short], strict=True)], np.int64)
    return np.concatenate((last, own)), np.concatenate((w.doc[at], short))


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs."""
    return np.unique(a * (b.max() + 1 if len(b) else 1) + b, return_inverse=True)[1]


def signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The MinHash values of each text, 16 bits each; zeros for texts without runs."""
    out = np.zeros((len(count), HASHES), np.uint16)
    real = count > 0
    if real.any():
        at, low = (np.cumsum(count) - count)[real], h.astype(np.uint32)
        for k in range(HASHES):
            out[real, k] = np.minimum.reduceat((low ^ _XOR[k]) * _TIMES[k], at) & np.uint32(0xFFFF)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each so many values (4, 2 or 1), with the number of the band mixed in."""
    v = np.ascontiguousarray(sig).view(f"u{2 * rows}").astype(np.uint64).reshape(len(sig), HASHES // rows)
    return _mixed(v ^ _mixed(np.arange(1, v.shape[1] + 1, dtype=np.uint64))).view(np.int64)


def pruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (a, b) of rows of sig (8 bits a value) stay."""
    stay, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        part = sig[:, n - STEP : n]
        for at in range(0, len(stay), 1 << 18):
            s = slice(at, at + (1 << 18))
            same[s] += (part[a[stay[s]]] == part[b[stay[s]]]).sum(1, dtype=np.int32)
        good = same >= least[n]
        stay, same = stay[good], same[good]
    return stay


def group_pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (rows of a group follow each other), some at a time: of side 0 all, of 1 and 2 across."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    end = np.repeat(starts + sizes, sizes)
    later = end - np.arange(len(group)) - 1  # rows of the group behind each row
    upto, at = np.cumsum(later), 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
        n = later[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        ok = (side[a] == 0) == (side[b] == 0)
        ok &= (side[a] == 0) | (side[a] != side[b])
        yield a[ok], b[ok]
        at = stop


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lowers labels in place until rows that pairs connect have the label of the smallest row."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int, size: Callable[[pa.Table], int] | None = None, most: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups (equal values of _group follow each other), of about that many rows, or that size."""
    held: list[pa.RecordBatch] = []
    for b in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
        held.append(b)
        t = pa.Table.from_batches(held)
        if t.num_rows >= rows or (size and size(t) >= most):
            g = t.column("_group").to_numpy()
            last = np.flatnonzero(g[1:] != g[:-1])
            if len(last):
                cut = int(last[-1]) + 1
                yield t.slice(0, cut).combine_chunks()
                held = t.slice(cut).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t.combine_chunks()


def _blocks(df: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """A row for each group that a row belongs to: _group and _side. n: how many rows its key has; most: rows a block."""
    count = F.ceil(F.col(n) / most).cast("int")
    mine = F.pmod(F.xxhash64("node", key), F.col("_count")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_count") - 1))
    out = df.withColumn("_count", count).withColumn("_mine", mine).withColumn("_other", other)
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2).cast("int")
    return out.withColumn("_group", F.xxhash64(key, F.least("_mine", "_other"), F.greatest("_mine", "_other"))).withColumn("_side", side).drop("_count", "_mine", "_other")


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("digest")


def _signed(docs: DataFrame, per_key: int) -> DataFrame:
    """doc_id, uid, digest, sig (8 bits a value), keys (none for texts without runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("jaccard")
        for b in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sigs, keys = [], []
            for block in _in_blocks(texts):
                h, n = shingles(block)
                s = signatures(h, n)
                sigs += map(bytes, s.astype(np.uint8))
                keys += [k if c else None for k, c in zip(band_keys(s, per_key), n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("uid"), b.column("digest"), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "uid", "digest", "sig", "keys"]
            )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), _digest(), F.col("text").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"doc_id {kind}, uid long, digest binary, sig binary, keys array<long>"), "jaccard-signed")


def _clusters(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root, members) for texts that keep a candidate; texts: node, sig, keys."""
    least = least_matches(threshold)
    keys = texts.select("node", F.explode("keys").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = _blocks(keys.join(several, "key"), "key", "n", KEY_SIDE).join(texts.select("node", "sig"), "node").select("_group", "_side", "node", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, CHUNK_ROWS):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            label, node = np.arange(len(sig)), t.column("node").to_numpy()
            for a, b in group_pairs(t.column("_group").to_numpy(), t.column("_side").to_numpy()):
                stay = pruned(sig, a, b, least)
                joined(label, a[stay], b[stay])
            tied = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], ["a", "b"])

    edges = held.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, "a long, b long")
    roots = components(edges, "jaccard-clusters")
    return roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact links in groups. rows: _group, _side, node, copies, sig, text. A row a text and group: node, links, documents, root."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, CHUNK_ROWS, lambda t: t.column("text").nbytes, BLOCK_BYTES):
            group, node = t.column("_group").to_numpy(), t.column("node").to_numpy()
            order = np.lexsort((node, group))
            once = order[np.concatenate(([True], (np.diff(node[order]) != 0) | (np.diff(group[order]) != 0)))]  # a row repeated with its id
            t = t.take(pa.array(once))
            group, node, side, copies = (t.column(c).to_numpy() for c in ("_group", "node", "_side", "copies"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            word, key = numbered_runs(Words(t.column("text").cast(pa.binary()).to_pylist()))
            order = np.lexsort((word, key))
            word, key = word[order], key[order]
            own = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(word) != 0))) if len(word) else np.zeros(0, bool)
            word, n = word[own], np.bincount(key[own], minlength=len(node))
            first, mark = np.cumsum(n) - n, np.zeros(int(word.max()) + 1 if len(word) else 0, np.int64)
            links, documents, label = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.arange(len(n))
            for a, b in group_pairs(group, side):
                near = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
                a, b = a[near], b[near]
                stay = pruned(sig, a, b, least)
                a, b = a[stay], b[stay]
                common = np.zeros(len(a), np.int64)
                cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), [len(a)])) if len(a) else np.zeros(0, np.int64)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    mine = word[first[a[x]] : first[a[x]] + n[a[x]]]
                    mark[mine] = 1
                    for lo in range(x, y, 512):
                        other = b[lo : min(lo + 512, y)]
                        size = n[other]
                        at = np.cumsum(size) - size
                        theirs = np.arange(size.sum()) + np.repeat(first[other] - at, size)
                        common[lo : lo + len(other)] = np.add.reduceat(mark[word[theirs]], at)
                    mark[mine] = 0
                linked = common >= threshold * (n[a] + n[b] - common) - 1e-9
                a, b = a[linked], b[linked]
                for x, y in ((a, b), (b, a)):
                    np.add.at(links, x, 1)
                    np.add.at(documents, x, copies[y])
                joined(label, a, b)
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has]), pa.array(documents[has]), pa.array(node[label[has]])], ["node", "links", "documents", "root"])

    return rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, "node long, links long, documents long, root long")


def _joined(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, uid, digest) and the texts: digest, node, rep_id, copies, n_links, n_linked_docs, root."""
    signed = _signed(docs, band_rows(threshold))
    texts = staged(
        signed.groupBy("digest").agg(F.min("uid").alias("node"), F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies")), "jaccard-texts"
    )
    firsts = signed.join(texts.select(F.col("node").alias("uid")), "uid").where("keys is not null").select(F.col("uid").alias("node"), "sig", "keys")
    clusters = _clusters(firsts, threshold).join(firsts.select("node", "sig"), "node")
    clustered = staged(clusters.join(texts, "node").select("node", "root", "members", "sig", "digest", "rep_id", "copies"), "jaccard-clustered")
    rows = docs.select(F.col("doc_id").alias("_id"), _digest(), F.col("text").cast("string").alias("text"))
    rows = maybe_among(rows, F.col("digest"), clustered.select(F.col("digest").alias("_sha"))).where("_maybe").drop("_maybe")
    rows = fold_repeats(rows, "_id", "digest", repeated_rows(signed, "doc_id", "digest")).drop("times")
    rows = rows.join(clustered.hint("merge"), (F.col("_id").eqNullSafe(F.col("rep_id"))) & (rows["digest"] == clustered["digest"]))
    found = staged(_verified(_blocks(rows, "root", "members", CLUSTER_SIDE).select("_group", "_side", "node", "copies", "sig", "text"), threshold), "jaccard-links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("documents").alias("n_linked_docs"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    out = texts.join(links, "node", "left").join(roots, "node", "left")
    out = out.select("digest", "node", "rep_id", "copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_linked_docs", F.lit(0).cast("long")).alias("n_linked_docs"), F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "uid", "digest"), staged(out, "jaccard-joined")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: doc_id, class_id, rep_id, copies, n_links, n_linked_docs.

    class_id: the smallest doc_id of all documents that links and equal texts connect with it. rep_id: the smallest doc_id
    with its text, and copies: how many rows have it. n_links: the different texts it is linked to, and n_linked_docs: how
    many documents have these.
    """
    rows, texts = _joined(docs, threshold)
    names = texts.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    texts = salted_join(texts, names, ["root"], F.col("node"))
    return salted_join(rows, texts, ["digest"], F.col("uid")).select("doc_id", "class_id", "rep_id", "copies", "n_links", "n_linked_docs")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: that with the smallest doc_id."""
    rows, texts = _joined(docs, threshold)
    best = F.min(F.struct(F.col("rep_id").isNull().alias("unknown"), "rep_id", "digest")).alias("best")
    classes = texts.groupBy("root").agg(best, F.sum("copies").alias("rows")).where("rows > 1").select("root", "best.rep_id", F.col("best.digest").alias("best"))
    several = texts.select("digest", "root").join(classes, "root").select("digest", "rep_id", (F.col("digest") == F.col("best")).alias("first"))
    several = salted_join(rows, several, ["digest"], F.col("uid"))
    stays = F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    pairs = staged(several.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_sha"), stays.alias("stays")).agg(F.count(F.lit(1)).alias("_n")), "jaccard-several")
    return keep_one(docs, pairs.where("not stays").select("_id", "_sha"), pairs.where("stays and _n > 1").select("_id", "_sha"), _digest())


ORACLE = r"""
WITH RECURSIVE d AS (SELECT coalesce(text, '') AS t, min(doc_id) AS rep_id, count(*) AS copies FROM documents GROUP BY 1),
w AS (SELECT rep_id, copies, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
s AS (SELECT rep_id, copies, CASE WHEN len(ws) > 0 THEN list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
u AS (SELECT rep_id, copies, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.rep_id AS a, b.rep_id AS b, any_value(a.copies) AS ca, any_value(b.copies) AS cb FROM u a JOIN u b ON a.x = b.x AND a.rep_id < b.rep_id
      GROUP BY 1, 2 HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))),
e AS (SELECT a, b, cb AS c FROM p UNION ALL SELECT b, a, ca FROM p),
r(a, b) AS (SELECT rep_id, rep_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS rep_id, min(b) AS class_id FROM r GROUP BY 1),
l AS (SELECT a AS rep_id, count(*) AS n_links, sum(c)::BIGINT AS n_linked_docs FROM e GROUP BY 1)
SELECT doc_id, class_id, rep_id, copies, coalesce(n_links, 0) AS n_links, coalesce(n_linked_docs, 0) AS n_linked_docs
FROM documents JOIN d ON d.t = coalesce(text, '') JOIN c USING (rep_id) LEFT JOIN l USING (rep_id)
"""
