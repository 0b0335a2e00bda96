"""Odd inputs and brute-force versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

LONG = " ".join(f"w{i % 977}x" for i in range(12_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, _size long, _row string, target double, digest string, key long, batch int, node long, _text string, kept boolean"


def docs_rows() -> list[tuple]:
    rng = random.Random(5)
    body = [" ".join(f"t{rng.randrange(4000)}" for _ in range(n)) for n in (3, 40, 120, 200, 300)]
    near = body[3].split()
    near[10] = "other"
    texts = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, body[0], "b"), (5, body[0], "b"), (5, body[0], "b"), (6, body[1] + " " + PASSAGE, "a"),
        (7, PASSAGE + " tail words", "c"), (8, body[3], "a"), (9, " ".join(near), None), (10, LONG, "a"), (11, LONG + " end", "b"), (12, "x" * 30_000, "c"),
        (None, body[2], "a"), (None, body[2], None), (13, body[2], "é"), (14, "naïve 日本語 𝒳 <s> ▁ \x00 \u0085 a b  c\r\n", "a"), (15, body[4], "a"), (16, body[4], "a"),
        (17, "W | W | W | W | " * 30, "a"), (18, "one", "z"), (18, "two", "z"),
    ]
    return [(i, t, "en", s, len(t or ""), -1, -2, "r", 0.5, "d", 7, 3, 9, "x", True) for i, t, s in texts]


def small(spark):
    return spark.createDataFrame(docs_rows(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(rows: list[tuple]) -> Counter:
    """rows (id, text) -> how often each (doc_id, class_id, rep_id, copies, n_links, n_linked_docs) comes."""
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    keys = list(texts)
    sets = [shingle_set(t) for t in keys]
    linked = defaultdict(set)
    for a in range(len(keys)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                linked[a].add(b)
                linked[b].add(a)
    out: Counter = Counter()
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    for a, t in enumerate(keys):
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        name = low([i for b in seen for i in texts[keys[b]]])
        for i in texts[t]:
            out[i, name, low(texts[t]), len(texts[t]), len(linked[a]), sum(len(texts[keys[b]]) for b in linked[a])] += 1
    return out
