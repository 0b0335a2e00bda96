"""Substring dedup: repeated passages of at least ``WINDOW`` words, found by fixed-block anchors.

Every text is a sequence of words (runs of anything but ASCII white space). Non-overlapping blocks of ``BLOCK`` words are
the index; any window of ``WINDOW`` = 2 * BLOCK words holds a whole block of its own text. Every rolling run of BLOCK
words of every text probes the index. Hits are extended to both sides by all windows that contain the hit, in the text of
the block and in the text of the probe, and windows with equal words are compared by the id of their document; what the
windows of a document cover together are its maximal repeats. A word is removed if it lies in a window that also starts in
a document with a smaller id.

How it is spread: documents are dealt by id and text into batches of about ``BATCH_BYTES``. A batch sends the distinct
hashes of its probes and blocks, packed, to buckets of the hash; a bucket answers with the anchors that several batches
share. Then a batch sends the distinct windows around its anchors, each with its smallest document, and gets back a bit a
window: whether another batch has a smaller one. Passages of many documents are thus folded to one entry a batch before
each exchange; no pairs are made. Rows of an exchange are made and read by array operations, however many buckets there
are; a batch sends one row a bucket, but never more rows than it has probes.

Words are hashed by BLAKE2b to 128 bits and a run of words by two polynomials of these, mod 2^64 each, so windows are
equal by 128 bits in which every word counts as a whole. Probes travel as 48 bits, which can only add anchors.

Edge cases: a null text has no words; rows with the same id don't remove each other's words; a null id counts as larger
than every other, and rows with null ids are dealt by their texts; rows that agree in id and text go as one with their
number, and each of them gets the answer. A text of any length is taken whole: one beyond ``BATCH_BYTES`` makes its batch as large as it is. Texts shorter than a window stay
whole; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import fold_repeats, repeated_rows, staged

WINDOW, BATCH_BYTES, BUCKET_BYTES, MOST_BUCKETS = 50, 2 << 20, 16 << 20, 1 << 15
_BASES, _LAST = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (1 << 63) - 1
_STEP = np.uint64((1 << 32) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(part: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (or more) of a base and of its inverse."""
    if part not in _powers or len(_powers[part][0]) < n:
        n += n // 4 + 1
        both = []
        for base in (_BASES[part], pow(_BASES[part], -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[part] = both[0], both[1]
    return _powers[part]


class Words:
    """The words of some texts, one text after the other, with hashes of runs of words."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(split)), self.count)
        self.words = list(chain.from_iterable(split))
        index: dict[bytes, int] = {}
        self.id = np.fromiter((index.setdefault(w, len(index)) for w in self.words), np.int64, len(self.words))
        self.distinct = list(index)
        digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in index), np.uint64).reshape(-1, 2)
        self.hash_of = np.ascontiguousarray(digests.T)
        self.sums: list[np.ndarray | None] = [None, None]

    def runs(self, n: int) -> np.ndarray:
        """The words that begin a run of n words in one text."""
        if len(self.doc) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])

    def hashes(self, at: np.ndarray, n: int, part: int = 0) -> np.ndarray:
        """64 bits of the runs of n words from at on; part 0 and 1 are independent of each other."""
        up, down = _power(part, len(self.id) + 1)
        if self.sums[part] is None:
            sums = np.zeros(len(self.id) + 1, np.uint64)
            np.cumsum(self.hash_of[part][self.id] * up[: len(self.id)], out=sums[1:])
            self.sums[part] = sums
        return _mixed((self.sums[part][at + n] - self.sums[part][at]) * down[at])

    def joined(self, start: int, end: int) -> bytes:
        return b" ".join(self.words[start:end])


def bucket_floors(buckets: int) -> np.ndarray:
    """The smallest 48-bit key of each bucket, and the end of the last."""
    return np.array([-(-(i << 48) // buckets) for i in range(buckets + 1)], np.uint64)


def _column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column over data; ends: where each row ends, in bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _cells(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one row after the other, and the size of each row."""
    parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in column.chunks:
        if len(c):
            _, ends, data = c.buffers()
            ends = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else parts[0])
            sizes.append(np.diff(ends).astype(np.int64))
    return np.concatenate(parts), np.concatenate(sizes)


def pack(keys: np.ndarray, ends: np.ndarray, floors: np.ndarray) -> pa.Array:
    """Sorted distinct numbers of each row as 32-bit steps from the row's floor; ends: where each row's numbers end. A long
    step is cut by numbers that stand for nothing."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else np.zeros(0, np.int64)
    step = np.diff(keys, prepend=np.uint64(0))
    real = ends > starts
    step[starts[real]] = keys[starts[real]] - floors[real]
    cuts = (step // _STEP).astype(np.int64)
    upto = np.cumsum(cuts + 1)
    out = np.full(int(upto[-1]) if len(upto) else 0, _STEP, np.uint64)
    out[upto - 1] = step % _STEP
    return _column(out.astype(np.uint32), 4 * np.concatenate(([0], upto))[ends])


def unpack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, counted from each row's floor, and their rows."""
    data, sizes = _cells(column)
    n = sizes // 4
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data.view(np.uint32), dtype=np.uint64)))
    row = np.repeat(np.arange(len(n)), n)
    return upto[1:] - upto[np.cumsum(n) - n][row], row


def _within(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table."""
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class Batch:
    """The words of a batch, the hashes of its rolling runs, and what it asks."""

    def __init__(self, docs: pa.Table, window: int, buckets: int):
        docs = docs.combine_chunks()
        ids = docs.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: _LAST if ids[i] is None else ids[i])
        self.window, self.block, self.floors = window, (window + 1) // 2, bucket_floors(buckets)
        self.rows = [ids[i] for i in order]
        times = docs.column("times").to_pylist()
        self.times = [times[i] for i in order]
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        self.words = w = Words([texts[i] for i in order])
        self.ids = np.array([_LAST if i is None else i for i in self.rows], np.int64)
        self.at = w.runs(self.block)
        self.key = w.hashes(self.at, self.block) >> np.uint64(16)
        self.anchor = (self.at - w.first[w.doc[self.at]]) % self.block == 0

    def probes(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(buckets, packed probes, packed blocks) of the buckets that the batch has probes for."""
        keys, blocks = np.unique(self.key), np.unique(self.key[self.anchor])
        k = np.searchsorted(keys, self.floors)
        some = np.flatnonzero(k[1:] > k[:-1])
        ends, floors = k[some + 1], self.floors[some]
        return some, pack(keys, ends, floors), pack(blocks, np.searchsorted(blocks, self.floors)[some + 1], floors)

    def extended(self, shared: np.ndarray) -> None:
        """Finds the windows around the shared anchors: their words, documents and hashes, and the distinct hashes in order."""
        w = self.words
        id_of = self.ids[w.doc[self.at]]
        mine = np.unique(self.key[self.anchor])
        near = np.flatnonzero(_within(self.key, mine))
        near = near[np.lexsort((id_of[near], self.key[near]))]  # anchors that two documents of this batch share
        k, d = self.key[near], id_of[near]
        twice = np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])
        hit = np.zeros(len(w.doc) + 1, np.int64)
        hit[self.at[_within(self.key, np.union1d(shared, twice))] + 1] = 1
        upto = np.cumsum(hit)
        at = w.runs(self.window)
        self.windows = at = at[upto[at + self.window - self.block + 1] > upto[at]]
        self.hash, self.of = _distinct(w.hashes(at, self.window), w.hashes(at, self.window, 1))
        self.least = np.full(len(self.hash), _LAST, np.int64)
        np.minimum.at(self.least, self.of, self.ids[w.doc[at]])
        self.bounds = np.searchsorted(self.hash[:, 0] >> np.uint64(16), self.floors)

    def asked(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(buckets, window hashes, their smallest ids, in 4 bytes each if all of the batch fit)."""
        some = np.flatnonzero(self.bounds[1:] > self.bounds[:-1])
        ends, short = self.bounds[some + 1], not len(self.least) or (0 <= self.least.min() and self.least.max() < 1 << 32)
        least = self.least.astype(np.uint32) if short else self.least
        return some, _column(self.hash, 16 * ends), _column(least, least.itemsize * ends)

    def covered(self, buckets: np.ndarray, bits: pa.ChunkedArray) -> np.ndarray:
        """Which words are removed. bits, of some buckets: a bit a window, whether another batch has a smaller document."""
        w, before = self.words, np.zeros(len(self.hash), bool)
        data, sizes = _cells(bits)
        for i, end, size in zip(buckets.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            a, b = self.bounds[i], self.bounds[i + 1]
            before[a:b] = np.unpackbits(data[end - size : end], count=b - a)
        gone = self.windows[before[self.of] | (self.ids[w.doc[self.windows]] > self.least[self.of])]
        edge = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        return np.cumsum(edge[:-1]) > 0

    def kept(self, removed: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]], bytes]]:
        """A document at a time, as in ``rows``: words, removed words, their spans, the kept words joined."""
        w = self.words
        lost = np.bincount(w.doc[removed], minlength=len(self.rows))
        for a, n, gone in zip(w.first.tolist(), w.count.tolist(), lost.tolist(), strict=True):
            if not gone:
                yield n, 0, [], w.joined(a, a + n)
                continue
            flips = np.flatnonzero(np.diff(removed[a : a + n].astype(np.int8), prepend=0, append=0)).tolist()
            spans = list(zip(flips[::2], flips[1::2], strict=True))
            stays = [(x, y) for x, y in zip([0, *flips[1::2]], [*flips[::2], n], strict=True) if x < y]
            yield n, gone, spans, b" ".join(w.joined(a + x, a + y) for x, y in stays)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order, a row each, and which of them each pair is."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.stack((a[new], b[new]), 1), of


def _shared_anchors(table: pa.Table, buckets: int) -> pa.Table:
    """Of a bucket: the probes that lie in a block and come from two batches, for each batch."""
    keys, row = unpack(table.column("probes"))
    hit = _within(keys, np.unique(unpack(table.column("blocks"))[0]))
    keys, row = keys[hit], row[hit]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    shared = shared[np.lexsort((keys[shared], row[shared]))]
    rows, n = np.unique(row[shared], return_counts=True)
    floor = bucket_floors(buckets)[table.column("bucket")[0].as_py()]
    batch = table.column("batch").to_numpy()[rows]
    return pa.table({"batch": pa.array(batch), "bucket": pa.array(np.full(len(rows), -1, np.int32)), "answer": _column(keys[shared] + floor, 8 * np.cumsum(n))})


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """Of a bucket: for each batch a bit a window, whether another batch has it in a smaller document."""
    data, sizes = _cells(table.column("probes"))
    h, n = data.view(np.uint64).reshape(-1, 2), sizes // 16
    ids, widths = _cells(table.column("blocks"))
    short = widths == 4 * n
    if short.all() or not short.any():
        ids = ids.view(np.uint32 if short.all() else np.int64).astype(np.int64)
    else:
        ends = np.cumsum(widths)
        ids = np.concatenate([ids[e - w : e].view(np.uint32 if s else np.int64).astype(np.int64) for e, w, s in zip(ends, widths, short, strict=True)])
    every, of = _distinct(np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))
    least = np.full(len(every), _LAST, np.int64)
    np.minimum.at(least, of, ids)
    smaller = least[of] < ids
    row = np.repeat(np.arange(len(n)), n)
    rows = np.unique(row[smaller])
    size = -(-n // 8)[rows]  # the answers begin at whole bytes
    begin = np.zeros(len(n), np.int64)
    begin[rows] = np.cumsum(size) - size
    bits = np.zeros(8 * int(size.sum()), np.uint8)
    place = 8 * begin[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    bits[place[smaller]] = 1
    batch = table.column("batch").to_numpy()[rows]
    bucket = np.full(len(rows), table.column("bucket")[0].as_py(), np.int32)
    return pa.table({"batch": pa.array(batch), "bucket": pa.array(bucket), "answer": _column(np.packbits(bits), np.cumsum(size))})


def _asking(batch: int, buckets: np.ndarray, probes: pa.Array, blocks: pa.Array) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets.astype(np.int32)), "batch": pa.array(np.full(len(buckets), batch, np.int64)), "probes": probes, "blocks": blocks})


def _anchors(answers: pa.Table) -> np.ndarray:
    found = answers.filter(pa.array(answers.column("bucket").to_numpy() < 0))
    return np.unique(_cells(found.column("answer"))[0].view(np.uint64))


def drop_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, spans (of removed words, ends excluded), and kept_sha256 or, with texts, kept_text."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    batches = max(1, -(-size // batch_bytes))
    buckets = int(min(MOST_BUCKETS, max(8, -(-size // bucket_bytes))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    once = fold_repeats(rows, "doc_id", "digest", repeated_rows(rows, "doc_id", "digest")).drop("digest")
    dealt = once.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def ask_anchors(table: pa.Table) -> pa.Table:
        return _asking(table.column("batch")[0].as_py(), *Batch(table, window, buckets).probes())

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Batch(table, window, buckets)
        b.extended(_anchors(answers))
        return _asking(table.column("batch")[0].as_py(), *b.asked())

    def resolve(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = Batch(table, window, buckets)
        b.extended(_anchors(answers))
        bits = answers.filter(pa.array(answers.column("bucket").to_numpy() >= 0))
        n, gone, spans, kept = zip(*b.kept(b.covered(bits.column("bucket").to_numpy(), bits.column("answer"))), strict=True)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({
            "doc_id": pa.array(b.rows, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
            "spans": pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], span),
            "kept": pa.array([k.decode() for k in kept] if texts else [hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "times": pa.array(b.times, pa.int64()),
        })

    def shared(table: pa.Table) -> pa.Table:
        return _shared_anchors(table, buckets)

    asking, answer = "bucket int, batch long, probes binary, blocks binary", "batch long, bucket int, answer binary"
    by_batch = dealt.groupBy("batch")
    anchors = staged(by_batch.applyInArrow(ask_anchors, asking).groupBy("bucket").applyInArrow(shared, answer), "anchors")
    windows = by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(ask_windows, asking)
    smaller = windows.groupBy("bucket").applyInArrow(_smaller_elsewhere, answer)
    out = by_batch.cogroup(anchors.union(smaller).groupBy("batch")).applyInArrow(resolve, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string, times long")
    out = out.withColumn("times", F.explode(F.expr("array_repeat(0, int(times))"))).drop("times")
    return out.withColumnRenamed("kept", "kept_text" if texts else "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT *, CASE WHEN i + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM w),
f AS (SELECT *, h IS NOT NULL AND min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM k),
c AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
