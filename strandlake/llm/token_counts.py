"""Token counts: pieces are counted once for each distinct pre-token and summed by a document's pre-token frequencies.

The model's pieces begin with its space mark or have none, so no merge crosses a place where a run of spaces begins: the
text, with the space that the model puts before it, falls apart there into pre-tokens (spaces, then what follows up to
the next space) that are encoded alone with the same result. ``separable`` checks that of a model. A task counts the
pieces of the distinct pre-tokens of a block of documents that its worker hasn't met, then joins the counts to the
frequencies of each document, within the block; ids are never kept.

Edge cases: a null text is the empty text, which has no tokens; texts may have any length (one longer than a block is a
block); equal rows give equal results; other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
BLOCK_CHARS, CACHED_WORDS = 4_000_000, 600_000
_PRE_TOKEN = re.compile(" ( *[^ ]*)")


def separable(pieces: list[str]) -> bool:
    """No piece has the space mark after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """Each without the first of its spaces, which the model puts back."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    return _PRE_TOKEN.findall(" " + text) if "  " in text or text[0] == " " else text.split(" ")


class _Pieces:
    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if not separable([self.model.id_to_piece(i) for i in range(self.model.vocab_size())]):
            raise ValueError(f"pieces of {model} cross spaces; its texts can't be counted by pre-token")
        self.count: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.count) > CACHED_WORDS:
            self.count.clear()
        new = [w for w in words if w not in self.count]
        if "" in new:  # the space mark alone, which the model can't be given
            new.remove("")
            self.count[""] = 1 if self.model.piece_to_id(MARK) != self.model.unk_id() else len(MARK.encode())
        self.count.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))


_models: dict[str, _Pieces] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """A row a document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _models:
            _models[model] = _Pieces(model)
        m = _models[model]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n, at = [], 0
            while at < len(texts):
                size, freq, met = 0, [], set()
                while at < len(texts) and size < BLOCK_CHARS:
                    freq.append(Counter(pre_tokens(texts[at])))
                    met.update(freq[-1])
                    size += len(texts[at])
                    at += 1
                m.learn(met)
                n += [sum(k * m.count[w] for w, k in f.items()) for f in freq]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
