"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and its runs of three bytes, hashed to ``HASHED`` places each, pairs of character classes
(next to each other, and one apart), and marks of repetition: words equal to one of the words before, words and lines seen
before in the text, by tenths of all. Terms are weighted by log frequency and inverse document frequency; each of the four
kinds is scaled to the length in ``WEIGHTS``, then the whole to length 1. A truncated singular value decomposition of the
vectors of the labelled texts gives the latent space. Their latent vectors and labels are broadcast - at most
``MAX_LABELLED`` rows of ``RANK`` numbers, and ``RANK`` numbers a term, whatever the input - and every document's exact
cosine products with all of them are computed in blocks. The ``NEIGHBOURS`` nearest vote, weighted by a power of their
similarity; the weights of the two labels are balanced only by the neighbours themselves, so the score estimates the share
of label 1 near the text.

``MAX_LABELLED`` bounds the fit: beyond it the labels with the smallest digests of their ids, of those whose documents are
there, are the sample. An id that several rows have gives one text, the smallest, however many they are. Rows whose
crc32 of the id as text leaves 2 on division by 4 are held out, never learnt. Labels, language, source and id are no
inputs of a score.

Edge cases: a null text is the empty text and is scored as such (it has the mark of emptiness only); texts may have any
length; rows without label or id are not learnt; several different labels of one id count each, equal ones once. A text's
vector is computed from the text alone, cosines are rounded to nine places, equal ones go by the order of id and label, and
scores are rounded to six places, so equal texts have equal scores wherever they lie. Without labelled rows the score is
0.5, and ``keep_good`` keeps all rows. An empty table gives an empty table. Other columns are ignored by ``scores`` and pass
through ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import kept, small_batches

MAX_LABELLED, RANK, NEIGHBOURS, POWER, THRESHOLD = 4000, 48, 25, 8.0, 0.7
HASHED, WEIGHTS = 4096, (0.5, 0.5, 1.0, 1.0)  # of words, runs of bytes, pairs of classes, marks
BLOCK, SEED = 256, 7


def _classes() -> np.ndarray:
    """Byte -> class: vowels, consonants, capitals, digits, white space of three kinds, each mark, bytes beyond ASCII."""
    out = np.zeros(256, np.intp)  # 0: control characters
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            out[b] = 1
        elif b >= 0x80:
            out[b] = 2
        elif c.islower():
            out[b] = 3 if c in "aeiou" else 4
        elif c.isupper():
            out[b] = 5
        elif c.isdigit():
            out[b] = 6
        elif c == " ":
            out[b] = 7
        elif c == "\n":
            out[b] = 8
        elif c in "\t\r\v\f":
            out[b] = 9
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = 10 + np.arange(len(marks))
    return out


CLASS = _classes()
N = int(CLASS.max()) + 1
#: where words, runs of bytes, pairs next to each other and one apart, and five groups of eleven marks begin and end
KINDS = (0, HASHED, 2 * HASHED, 2 * HASHED + 2 * N * N, 2 * HASHED + 2 * N * N + 5 * 11)
TERMS = KINDS[-1]


def _tenths(part: int, whole: int) -> int:
    return min(10, -(-10 * part // whole)) if whole else 0


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text, in order, and how often it has each."""
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8)
    c, wide = CLASS[b], b.astype(np.uint32)
    words, lines = raw.split(), re.split(rb"\n+", raw)
    n, seen = len(words), Counter(words)
    at = np.fromiter((zlib.crc32(w) % HASHED for w in seen), np.int64, len(seen))
    count = np.bincount(at, np.fromiter(seen.values(), np.float64, len(seen)), HASHED)
    runs = ((wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)) % np.uint32(65521) % np.uint32(HASHED)
    pairs = [np.bincount(c[:-k] * N + c[k:], minlength=N * N) for k in (1, 2)]
    marks = np.zeros(5 * 11)
    marks[[
        _tenths(sum(map(bytes.__eq__, words, words[1:])), n), 11 + _tenths(sum(map(bytes.__eq__, words, words[2:])), n), 22 + _tenths(n - len(seen), n),
        33 + _tenths(len(lines) - len(set(lines)), len(lines)), 44 + min(10, n.bit_length()),
    ]] = 1
    every = np.concatenate((count, np.bincount(runs, minlength=HASHED), *pairs, marks))
    has = np.flatnonzero(every)
    return has.astype(np.int32), every[has].astype(np.float32)


def weighed(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The weights of a text's terms: log frequencies times idf, each kind scaled to its length, then all to length 1."""
    x = np.log1p(count) * idf[at]
    ends = np.searchsorted(at, KINDS)
    for a, b, weight in zip(ends, ends[1:], WEIGHTS, strict=False):
        x[a:b] *= weight / max(float(np.sqrt((x[a:b] ** 2).sum())), 1e-9)
    return x / max(float(np.sqrt((x**2).sum())), 1e-9)


def latent_space(rows: list[tuple[np.ndarray, np.ndarray]], rank: int) -> np.ndarray:
    """The leading right singular vectors of the matrix with these rows (terms, weights), by a randomised range finder with
    power iterations; some rows at a time are laid out in full."""

    def dense() -> Iterator[np.ndarray]:
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            x = np.zeros((len(part), TERMS), np.float32)
            for line, (term, weight) in zip(x, part, strict=True):
                line[term] = weight
            yield x

    rank = min(rank, len(rows))
    q = np.random.default_rng(SEED).standard_normal((TERMS, min(rank + 16, len(rows)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(sum(x.T @ (x @ q) for x in dense()))[0]
    _, _, v = np.linalg.svd(np.concatenate([x @ q for x in dense()]), full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :rank], np.float32)


class Voters:
    """The fitted model: idf, the latent space, the labelled vectors and their labels."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        has = np.bincount(np.concatenate([at for at, _ in found]), minlength=TERMS)
        self.idf = (np.log((1 + len(found)) / (1 + has)) + 1).astype(np.float32)
        self.space = latent_space([(at, weighed(at, n, self.idf)) for at, n in found], RANK)
        self.vectors, self.labels = np.stack([self.latent(at, n) for at, n in found]), labels.astype(float)

    def latent(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The latent vector of a text, of length 1."""
        z = (weighed(at, count, self.idf) @ self.space[at]).astype(float)
        return z / max(float(np.sqrt((z**2).sum())), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, most = [np.zeros(0)], len(self.labels)
        k = min(NEIGHBOURS, most)
        for at in range(0, len(texts), BLOCK):
            near = np.rint(np.stack([self.latent(*terms(x)) for x in texts[at : at + BLOCK]]) @ self.vectors.T * 1e9).astype(np.int64)
            place = near * most + np.arange(most)[::-1]  # no two are equal: of equal cosines the first labelled row is nearer
            top = np.sort(np.partition(place, most - k, axis=1)[:, most - k :], axis=1)[:, ::-1]
            w = np.maximum((top // most) / 1e9, 1e-6) ** POWER
            out.append((w * self.labels[most - 1 - top % most]).sum(1) / w.sum(1))
        return np.round(np.concatenate(out), 6)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Voters | None:
    """Learns from the labelled documents that are not held out, at most ``max_labelled`` pairs of an id and a label."""
    learn = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    there = learn.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = there.orderBy(F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), "doc_id", "quality").limit(max_labelled)
    chosen = F.broadcast(sample.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("quality").cast("int"))).alias("_labels")))  # at most max_labelled rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                found = [terms(x) for x in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].tolist(), "quality": part["quality"].tolist(), "terms": [a.tobytes() for a, _ in found], "counts": [n.tobytes() for _, n in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "_labels").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "text", F.explode("_labels").alias("quality"))
    got = rows.mapInPandas(run, f"doc_id {kind}, quality int, terms binary, counts binary").toPandas()
    if got.empty:
        return None
    got = got.iloc[np.lexsort([got["quality"], got["doc_id"]])]  # the same order, and so the same space, in each run
    found = [(np.frombuffer(a, np.int32), np.frombuffer(n, np.float32)) for a, n in zip(got["terms"], got["counts"], strict=True)]
    return Voters(found, got["quality"].to_numpy())


def _scored(docs: DataFrame, voters: Voters | None, columns: list[str]) -> DataFrame:
    """The columns of docs and ``_score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    names = [*columns, "_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("quality")
        model = shared.value
        for b in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            texts = b.column("_text").to_pylist()
            score = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(np.clip(score, 0, 1), pa.float64())], names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, f"{kinds}, _score double")


def scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted."""
    out = _scored(docs.select("doc_id", "text"), fit(docs, labels, max_labelled), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all of them where nothing can be learnt."""
    voters = fit(docs, labels, max_labelled)
    if voters is None:
        return docs
    packed = docs.select(F.struct("*").alias("_row"), "text")
    return _scored(packed, voters, ["_row"]).where(F.col("_score") >= threshold).select("_row.*")
