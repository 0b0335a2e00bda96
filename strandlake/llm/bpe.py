"""Byte-level BPE by corpus-level merge replay.

A task takes its documents in blocks. The distinct pre-tokens of a block that its worker has not met yet are laid out as
one array of tokens; an inverted index from the id that a pair merges to, to the positions of such pairs, then applies
the merges of all these words at once, in rank order, and touches only the neighbours of each merge. Words don't
influence each other, so a replay over a block gives what a replay over the whole corpus gives; blocks bound the memory
and spare the corpus a shuffle of all its words. A document's ids are those of its pre-tokens, in order.

As tiktoken does: a pre-token that is a token is that token; else the pair whose joined bytes have the lowest rank is
merged first, the leftmost of equal ones.

Edge cases: a null text is the empty text, with no ids (their digest is that of the empty string); texts may have any
length (one longer than a block is a block); equal rows give equal results, and rows that follow their equals, as a mixture
repeats them, are encoded once; other columns are ignored by ``encode`` and ``token_digests``. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import kept, small_batches

BLOCK_CHARS, CACHED_WORDS, CACHED_PAIRS = 4_000_000, 300_000, 600_000  # what a worker keeps: some 150 MB
SLICE_ROWS = 500


class MergeReplay:
    """Encodes sets of words by replaying the merges of a rank file over all of them."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.token = {i: t for t, i in self.ranks.items()}
        self.byte = [self.ranks[bytes([b])] for b in range(256)]
        self.joined: list[dict[int, int]] = [{} for _ in range(max(self.token) + 1)]  # of a left id, by the right one
        self.known = 0

    def _join(self, left: int, right: int) -> int:
        """The id that a pair merges to, or -1."""
        if self.known > CACHED_PAIRS:
            for row in self.joined:
                row.clear()
            self.known = 0
        self.known += 1
        out = self.joined[left][right] = self.ranks.get(self.token[left] + self.token[right], -1)
        return out

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        words, byte, joined, join = list(words), self.byte, self.joined, self._join
        out: list = [None] * len(words)
        tok: list[int] = []
        after: list[int] = []
        starts: list[tuple[int, int]] = []
        for w, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = [whole]
            elif word:
                at = len(tok)
                starts.append((w, at))
                tok.extend(map(byte.__getitem__, word))
                after.extend(range(at + 1, at + len(word)))
                after.append(-1)
            else:
                out[w] = []
        before = [-1] * len(tok)
        places: dict[int, list[int]] = {}
        for p, n in enumerate(after):
            if n >= 0:
                before[n] = p
                r = joined[tok[p]].get(tok[n])
                if r is None:
                    r = join(tok[p], tok[n])
                if r >= 0:
                    if r in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            todo, row = sorted(places.pop(rank, ())), joined[rank]
            for i, p in enumerate(todo):
                n, lower = after[p], False
                if n < 0 or tok[p] < 0:
                    continue
                r = joined[tok[p]].get(tok[n])
                if (join(tok[p], tok[n]) if r is None else r) != rank:
                    continue
                tok[p], tok[n] = rank, -1
                after[p], after[n] = after[n], -1
                n, o = after[p], before[p]
                if n >= 0:
                    before[n] = p
                    r = row.get(tok[n])
                    if r is None:
                        r = join(rank, tok[n])
                    if r >= 0:
                        lower = r < rank
                        if r in places:
                            places[r].append(p)
                        else:
                            places[r] = [p]
                            heapq.heappush(heap, r)
                if o >= 0:
                    r = joined[tok[o]].get(rank)
                    if r is None:
                        r = join(tok[o], rank)
                    if r >= 0:
                        lower = lower or r < rank
                        if r in places:
                            places[r].append(o)
                        else:
                            places[r] = [o]
                            heapq.heappush(heap, r)
                if lower and i + 1 < len(todo):  # a lower rank came up: it goes first
                    places.setdefault(rank, []).extend(todo[i + 1 :])
                    heapq.heappush(heap, rank)
                    break
        for w, p in starts:
            ids = []
            while p >= 0:
                ids.append(tok[p])
                p = after[p]
            out[w] = ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Dictionary:
    """The words that a worker has met, and their ids."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex

        self.replay, self.find = MergeReplay(vocabulary), regex.compile(pattern).findall
        self.digits = [str(i) for i in range(max(self.replay.token) + 1)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text (the same list for equal texts in a row); the words of some texts at a time are replayed together."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < BLOCK_CHARS:
                size += len(texts[end] or "")
                end += 1
            here = list(map(text_or_empty, texts[at:end]))
            found = {t: self.find(t) for t in dict.fromkeys(here)}  # a text that comes again in the block is encoded once
            if len(self.words) > CACHED_WORDS // 2:  # words that come again move on, the others go
                self.older, self.words = self.words, {}
            new = [w for w in set().union(*found.values()) if w not in self.words]
            self.words.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in self.older]
            self.words.update(zip(new, map(tuple, self.replay.encode([w.encode() for w in new])), strict=True))
            last = None, []
            for t in here:
                if last[0] is not t and last[0] != t:
                    last = t, list(chain.from_iterable(map(self.words.__getitem__, found[t])))
                yield last[1]
            at = end


def _dictionary(vocabulary: str, pattern: str) -> _Dictionary:
    return kept(("byte-level BPE", vocabulary, pattern), lambda: _Dictionary(vocabulary, pattern))


def text_or_empty(text: str | None) -> str:
    return text or ""


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row a document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(vocabulary, pattern)
        for b in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            n, digests, back, last = [], [], [], None
            for ids in d.encode(b.column("text").to_pylist()):
                again = ids is last
                n.append(len(ids))
                digests.append(digests[-1] if again else _sha(",".join(map(d.digits.__getitem__, ids)).encode()))
                back.append(back[-1] if again else _sha(d.replay.decode(ids)))
                last = ids
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row a document: doc_id, ids, and the digest of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dictionary(vocabulary, pattern)
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                ids, back, last = [], [], None
                for x in d.encode(part.column("text").to_pylist()):
                    again = x is last
                    ids.append(ids[-1] if again else np.array(x, np.int32))
                    back.append(back[-1] if again else _sha(d.replay.decode(x)))
                    last = x
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded_sha256 string")


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """The texts of what ``encode`` gives: doc_id, text. Bytes that are not UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _dictionary(vocabulary, pattern).replay
        for b in batches:
            texts = [replay.decode(ids or ()).decode(errors="replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
