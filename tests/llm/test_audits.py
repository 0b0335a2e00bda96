import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from strandlake.llm import divergence, filter_audit, secret_scan
from tests.llm import helpers

# 11: secrets

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans_of(text):
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for c in secret_scan.CLASSES:
        w = c.window
        for m in re.finditer(c.pattern, text):
            s, spans = m[0], []
            if re.search("|".join(secret_scan.ALLOWED), s.lower()):
                continue
            for i in range(len(s) - w + 1):
                n = Counter(s[i : i + w])
                if sum(round(k * math.log2(k) * 1e6) for k in n.values()) <= c.most and all(set(s[i : i + w]) & set(x) for x in c.needs):
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + w
                    else:
                        spans.append([i, i + w])
            more += [(c.kind, m.start() + a, m.start() + b) for a, b in spans]
    more = [x for x in more if not any(b[1] <= x[1] and x[2] <= b[2] for b in base)]
    kinds = [*secret_scan.PATTERNS, *[c.kind for c in secret_scan.CLASSES]]
    order = lambda s: (s[1], kinds.index(s[0]), s[2])
    return sorted(base, key=order), sorted(base + more, key=order)


def secret_texts():
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    some = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    texts = [None, "", " ", "token=abc", "token=token:abcdefgh", "naïve 日本 PASSWORD : 'x.y=zabc' 𝒳 apikey==abcdefg api_key=\"12345", "ſecret=abcdefgh toKen=abcdefgh"]
    texts += [f"AKIA{some(16, 'ABCDEFG123')} AKIAAKIA{some(15, 'XYZ9')} xAKIA{some(3, 'A')}", "deadbeef" * 3, "é" + "0a" * 11 + "g" + "0a" * 12]
    texts += [f"see {some(n)} and {some(n, '0123456789ABCDEF')}, {some(n, '0123456789abcdef')}é{some(n)}" for n in (19, 20, 23, 24, 40, 90)]
    texts += [some(9000), some(4096 + 23), "a" * 20_000 + some(30) + "b" * 5000, "0123456789" + some(40), "sha256-" + some(43), some(20) + "EXAMPLE" + some(20), "internationalization-of-the-words-that-are-long"]
    texts += [" ".join(f"token={some(8)}" for _ in range(1200)), "12345678901234567890123456789012345678901234567890"]
    return list(enumerate(texts)) + [(3, "token=abcdef"), (3, "token=abcdef"), (None, "AKIA" + "B2" * 10)]


def test_secrets_against_brute_force(spark):
    rows = secret_texts()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, spans int, _text string").repartition(3)
    got = Counter(tuple(r) for r in secret_scan.scan_digests(docs).collect())
    want = Counter()
    shown = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for i, t in rows:
        base, every = spans_of(t or "")
        n = Counter(k for k, *_ in base)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)] += 1
    assert got == want
    assert sum("entropy" in r[5] for r in want) == 8


def test_secrets_edges(spark):
    assert secret_scan.scan_digests(helpers.empty(spark)).count() == 0
    got = secret_scan.secret_spans(helpers.small(spark)).collect()
    assert len(got) == len(helpers.docs_rows())
    docs = spark.createDataFrame([(1, "T-12 T-12345 é " + "ab1" * 20)], "doc_id long, text string")
    row = secret_scan.secret_spans(docs, patterns={"ticket": (r"T-([0-9]+)", 1, 5)}, classes=(secret_scan.Class("all", "ab1", "[ab1]{6,}", 6, 1.5, ("1",)),), allowed=()).first()
    assert [tuple(s) for s in row.base] == [("ticket", 5, 12)] and [tuple(s) for s in row.spans] == [("ticket", 5, 12), ("all", 15, 75)]


def test_secrets_stay_in_the_engine(spark):
    plan = secret_scan.scan_digests(helpers.small(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 12: divergence


def divergent(rows, least, top):
    terms = [(lang or "", source or "", Counter(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in terms}:
        seen = Counter(t for x, _, c in terms if x == lang for t in c)
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        sums = defaultdict(Counter)
        for x, source, c in terms:
            if x == lang:
                sums[source].update({t: n for t, n in c.items() if t in set(kept)})
                sums[None].update({t: n for t, n in c.items() if t in set(kept)})
        p = {s: [1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept] for s, c in sums.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            if s is None:
                continue
            pairs = sorted(((-sum(map(f, p[s], p[o])), o.encode()) for o in p if o is not None and o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(pairs, 1)}
            words = sorted((-f(a, q), t.encode()) for t, a, q in zip(kept, p[s], p[None], strict=True) if sums[s][t] and a > q)
            out |= {(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(words[:top], 1)}
    return out


def divergent_rows():
    rng = random.Random(9)
    words = ["the", "The", "été", "ÉTÉ", "日本", "zz", "a", "Zebra", "naïve", "x" * 5000] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = [(" ".join(rng.choice(words[: rng.choice((10, 60, 130))]) + rng.choice(("", ".", "1", "_")) for _ in range(rng.randrange(60))), rng.choice(("en", "en", "de", None)), rng.choice(("s1", "s2", "s10", "é", None))) for _ in range(160)]
    return [*rows, (None, "en", "s3"), ("", "fr", "only"), ("one two", "xx", "a"), ("1 2 3", "xx", "b"), *[("same words the", "en", "s1")] * 20]


def test_divergence_against_brute_force(spark):
    rows = divergent_rows()
    docs = spark.createDataFrame([(t, x, s, 5, 6, "q") for t, x, s in rows], "text string, lang string, source string, n long, chunk long, term string").repartition(5)
    for least, top, width in ((10, 10, 4096), (3, 4, 7), (500, 10, 8)):
        got = [tuple(r) for r in divergence.divergence(docs, least, top, width).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == divergent(rows, least, top)


def test_divergence_flushes_and_is_exact(spark, monkeypatch):
    import numpy as np

    big = np.array([0, 7, 10**15, 3 * 10**14 + 1])
    assert divergence.shares(big, int(big.sum()), 4).tolist() == [1 + 10**9 * (int(c) + 2) // (int(big.sum()) + 8) for c in big]
    assert divergence._summed(np.array([5, 2, 5, 5]), np.array([2**60 + 1, 3, 2**60 + 1, 1])).tolist() == [3, 2**61 + 3]
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    docs = spark.createDataFrame([(t, x, s) for t, x, s in divergent_rows()], "text string, lang string, source string").repartition(2)
    got = {tuple(r) for r in divergence.divergence(docs, 3, 4).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == divergent(divergent_rows(), 3, 4)
    assert divergence.divergence(helpers.empty(spark)).count() == 0


# 13: filters


def failures(rows):
    """rows (doc_id, text, lang) -> [(doc_id, lang, mask)]"""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least.get(t, i))
        out.append((i, lang or "", sum(f << k for k, f in enumerate(fails))))
    return out


def filter_rows():
    rng = random.Random(11)
    word = lambda: rng.choice(("Aa", "bb", "c#", "dé", "e")) + str(rng.randrange(3000))
    texts = [" ".join(word() if rng.random() < p else "x" for _ in range(n)) for n in (0, 99, 100, 150) for p in (1, 0.9, 0.7) for _ in range(3)]
    rows = [(rng.randrange(400), rng.choice(texts), rng.choice(("en", "de", None))) for _ in range(300)]
    hot = [(i, "one text that very many rows have " * 20, "en") for i in range(1000, 1600)]
    return [*rows, *hot, (None, None, "en"), (None, "", None), (5, None, "fr"), (5, "", "fr"), (7, "", "fr"), (2000, "A" * 40_000, "de"), (2001, "A" * 40_000, "de"), (-1, hot[0][1], "de")]


def test_filter_masks_over_borders(spark):
    rows = filter_rows()
    docs = spark.createDataFrame([(i, t, x, 1, 2, 3) for i, t, x in rows], "doc_id long, text string, lang string, mask int, run long, task int").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("2", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = Counter(tuple(r) for r in filter_audit.masks(docs).collect())
            assert got == Counter(failures(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_filter_audit_against_replay(spark):
    rows = filter_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1700, 2)] + [(i, None, None) for i in range(1, 50, 2)] + [(4, 1, 1), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    table = spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, table).collect()}
    every = failures(rows)
    want = {}
    for part in {x for _, x, _ in every}:
        mine, shapley = [(i, m) for i, x, m in every if x == part], Counter()
        for o in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(o, 1):
                bit = 1 << "ABCDE".index(f)
                out = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                shapley[f] += len(out)
                fail = sum(1 for _, m in mine if m & bit)
                want[part, "".join(o), k] = [len(left), len(out), fail - len(out), sum(m == bit for _, m in mine), sum(i in good for i, _ in out), sum(i in toxic for i, _ in out)]
        for o in permutations("ABCDE"):
            for k, f in enumerate(o, 1):
                want[part, "".join(o), k].append(shapley[f])
    assert got == {k: tuple(v) for k, v in want.items()}
    assert filter_audit.audit(helpers.empty(spark), table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
