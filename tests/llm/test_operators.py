import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, common, exact_dedup, jaccard, media, mixing, quality, substring, token_counts, url_filter, warc
from tests.llm import helpers

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    return [(r[0], r[1]) for r in helpers.docs_rows()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# 1: mixing


def test_mix_targets_and_rows(spark):
    docs = helpers.small(spark)
    got = mixing.mix_report(docs).collect()
    size = Counter()
    for i, t, _, s, *_ in helpers.docs_rows():
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, clamped = 1.5 * sum(size.values()), {}
    while True:
        free = [s for s in names if s not in clamped]
        level = (budget - sum(clamped.values())) / sum(weight[s] for s in free)
        over = {s: 2.0 * size[s] for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        clamped |= over
    target = clamped | {s: weight[s] * level for s in free}
    largest = {s: max(len(helpers.words(r[1])) for r in helpers.docs_rows() if r[3] == s) for s in names}
    assert len(got) == len(helpers.docs_rows())
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= largest[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == sum((Counter({r.doc_id: r.repeats}) for r in got), Counter())
    assert sorted(map(str, mixing.mix_report(docs.repartition(5)).collect())) == sorted(map(str, got))


def test_mix_empty(spark):
    assert mixing.mix_report(helpers.empty(spark)).count() == 0 and mixing.mix(helpers.empty(spark)).count() == 0


# 2: exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    docs = helpers.small(spark)
    got = exact_dedup.exact_groups(docs, keep, fan_in=2).collect()
    groups = {}
    for i, t in texts():
        groups.setdefault(t or "", []).append(i)
    best = {t: {"largest": max, "smallest": min}[keep]((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), sha((t or "").encode())) for i, t in texts())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({sha(t.encode()): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.drop_exact_copies(docs, keep)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter({(best[t], t): 1 for t in groups})


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(helpers.empty(spark)).count() == 0 and exact_dedup.drop_exact_copies(helpers.empty(spark)).count() == 0


# 3 and 7: tokenizers


def test_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = helpers.small(spark)
    got = bpe.token_digests(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in texts():
        ids = tik.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, got)) == want
    tokens = bpe.encode(docs, BYTE_BPE, public_tokenizers.PATTERN)
    back = bpe.decode(tokens, BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in texts())
    assert bpe.encode(helpers.empty(spark), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_merge_replay_order(tmp_path, seed):
    """Rank files in which a merge can open a pair of a lower rank."""
    import tiktoken

    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    tokens += sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 5))) for _ in range(30)}, key=lambda _: rng.random())
    ranks = {t: i for i, t in enumerate(tokens)}
    (tmp_path / "r").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for t, i in ranks.items()))
    tik = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    ws = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(50)]
    assert bpe.MergeReplay(str(tmp_path / "r")).encode(w.encode() for w in ws) == [tik.encode_ordinary(w) for w in ws]


def test_token_counts_are_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(helpers.small(spark), PIECES).collect()
    want = Counter()
    for i, t in texts():
        n = len(sp.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert Counter(map(tuple, got)) == want
    assert token_counts.token_counts(helpers.empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pre_tokens(seed):
    import sentencepiece

    sp, rng = token_counts._Pieces(PIECES), random.Random(seed)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\t é日𝒳12.▁<s>\x00 ") for _ in range(rng.randrange(30)))
        pre = Counter(token_counts.pre_tokens(t))
        sp.learn(set(pre))
        assert sum(n * sp.count[w] for w, n in pre.items()) == len(model.encode(t)), t


# 4: quality


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(600):
        good = i % 5 > 0
        rows.append((i, " ".join(word() + ("" if good else " |") for _ in range(rng.randint(30, 90))) + ("." if good else "")))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in got.items() if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert np.mean([got[i].predicted == m for i, m in marks if i in held]) > 0.97
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scores(docs, wrong).collect()} == {i: r.score for i, r in got.items()}


def test_quality_odd_rows(spark):
    docs = helpers.small(spark)
    labels = spark.createDataFrame([(4, 1), (4, 1), (8, 0), (17, 0), (None, 1), (12, None), (99, 1)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == len(helpers.docs_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(docs, labels, threshold=0.0).columns == docs.columns
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(helpers.empty(spark), labels).count() == 0


def test_quality_fit_is_bounded_by_learnt_rows(spark):
    rows = [(i, f"text number {i} " * (1 + i % 5)) for i in range(40) if i % 2] + [(1, "text of an id with many rows")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    there = [(i, i % 3 % 2) for i in range(40) if i % 2]
    model = quality.fit(docs, spark.createDataFrame(there, "doc_id long, quality int"), 1000)
    learnt = spark.createDataFrame(there, "doc_id long, quality int").where(~quality.held_out(F.col("doc_id"))).count()
    assert len(model.labels) == learnt  # the rows of id 1 count once
    away = [(i, 1) for i in range(1000, 1400)] * 2
    labels = spark.createDataFrame(there + away, "doc_id long, quality int")
    assert len(quality.fit(docs, labels, 10).labels) == 10  # labels without documents use up nothing
    nothing = spark.createDataFrame(away, "doc_id long, quality int")
    assert Counter(quality.keep_good(docs, nothing).collect()) == Counter(docs.collect())


def test_quality_votes(spark):
    """Every score against the vote worked out row by row: terms by dictionaries, all cosines, all labelled rows in order."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["one", "two", "Three!", "4|"]) + rng.choice("xyz") for _ in range(rng.randrange(30)))) for i in range(160)] + [(500, None), (501, ""), (502, rows_long := "w " * 50_000)]
    rows += [(600 + i, rows[i][1]) for i in range(40)]  # equal texts
    labels = [(i, int("Three!" not in (t or "")[:20])) for i, t in rows if i % 3]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, table)
    got = {r.doc_id: r.score for r in quality.scores(docs.repartition(5), table).collect()}
    text = dict(rows)
    learnt = sorted((i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    space, vectors = model.space.astype(float), {}

    def latent(t):
        if t not in vectors:
            at, n = quality.terms(t)
            weight = {a: np.log1p(c) * model.idf[a] for a, c in zip(at.tolist(), n.tolist())}
            x = {}
            for k, (lo, hi) in enumerate(zip(quality.KINDS, quality.KINDS[1:])):
                part = {a: v for a, v in weight.items() if lo <= a < hi}
                length = sum(v * v for v in part.values()) ** 0.5
                x |= {a: v / length * quality.WEIGHTS[k] for a, v in part.items()}
            z = sum(v * space[a] for a, v in x.items())
            vectors[t] = z / (z @ z) ** 0.5
        return vectors[t]

    assert np.abs(model.vectors - np.stack([latent(text[i]) for i, _ in learnt])).max() < 1e-5
    assert [float(q) for _, q in learnt] == model.labels.tolist()
    for i, t in rows:
        z = model.latent(*quality.terms(t))
        near = sorted(((-round(float(z @ v), 9), k) for k, v in enumerate(model.vectors)))[: quality.NEIGHBOURS]
        w = [max(-s, 1e-6) ** quality.POWER for s, _ in near]
        assert abs(got[i] - sum(x * learnt[k][1] for x, (_, k) in zip(w, near)) / sum(w)) < 2e-6, i
    assert all(got[600 + i] == got[i] for i in range(40))
    assert rows_long and 0 <= got[502] <= 1


def test_quality_terms_are_of_words_and_bytes():
    same_classes = quality.terms("some plain words"), quality.terms("same plein wirds")
    assert set(same_classes[0][0].tolist()) != set(same_classes[1][0].tolist())


# 5: WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a b/\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "y" * 100_000), (None, "u", "x"), (7, "u", "é"), (7, "u", "é"), (8, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, _sha int, payload string").repartition(2)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        p, top = (h or "").encode(), first[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    for split in (100, 1 << 20):
        assert Counter(map(tuple, warc.round_trip(pages, split).collect())) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_splits_anywhere():
    import io

    rng = random.Random(3)
    made = [(f"urn:x-page:{i}", rng.randbytes(rng.randint(0, 300)) if i % 3 else warc.MAGIC * rng.randint(0, 50) + b"WARC/1.1\r\n\r\n") for i in range(120)]
    data = b"".join(warc.member("response", i, "http://x", p) for i, p in made)
    for split in (64, 777, 5000, 1 << 20):
        for step in (128, 100_000):
            got = [warc.parse(r) for a in range(0, len(data), split) for _, r in warc.records(io.BytesIO(data), a, min(a + split, len(data)), len(data), step)]
            assert [(g["record_id"], g["payload"]) for g in got] == made


def test_warc_long_headers():
    rng = random.Random(4)
    urls = ["http://x", *(f"data:,{base64.b64encode(rng.randbytes(n)).decode()}" for n in (60_000, 90_000, 400_000)), "http://y"]
    data = b"".join(warc.member("response", f"urn:x-page:{i}", u, b"p") for i, u in enumerate(urls))
    for split in (50_000, len(data)):
        got = [warc.parse(r) for a in range(0, len(data), split) for _, r in warc.records(io.BytesIO(data), a, min(a + split, len(data)), len(data))]
        assert [r["target_uri"] for r in got] == urls


def test_warc_cut_off_members_and_read_errors_fail():
    rng = random.Random(6)
    members = [warc.member("response", f"urn:x-page:{i}", f"http://{i}", rng.randbytes(40)) for i in range(3)]
    data = b"".join(members)

    def read(data: bytes, split: int, f=io.BytesIO) -> int:
        file = f(data)
        return sum(1 for a in range(0, len(data), split) for _ in warc.records(file, a, min(a + split, len(data)), len(data)))

    whole = len(data) - len(members[-1])
    for split in (len(members[0]), 100, 7, len(data)):
        assert read(data, split) == 3 and read(data[:whole], split) == 2
        for n in range(whole + 1, len(data)):
            with pytest.raises(OSError):
                read(data[:n], split)

    class Failing(io.BytesIO):
        def read(self, n=-1):
            if self.tell():
                raise OSError("no storage")
            return super().read(min(n, 60))

    with pytest.raises(OSError, match="no storage"):
        read(data, len(data), Failing)
    damaged = bytearray(data)
    damaged[len(members[0]) + 60] ^= 0xFF
    with pytest.raises((OSError, zlib.error)):
        read(bytes(damaged), len(data))


# 6: substring dedup


@pytest.mark.parametrize("batch_bytes", [3_000, 1 << 21])
def test_repeats(spark, batch_bytes):
    rng = random.Random(2)
    shared = [" ".join(f"s{k}_{j}" for j in range(n)) for k, n in enumerate((49, 50, 51, 90, 260))]
    rows = [(i, t) for i, t in texts() if i is not None]
    for i in range(100, 160):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(shared).split()
            a = rng.randrange(max(1, len(w) - 48))
            parts += [" ".join(w[a:] if rng.random() < 0.5 else w), " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40)))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows.append((160, "same words " * 100))
    rows.append((161, "same words " * 70))
    starts = {}
    for d, t in rows:
        w = helpers.words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            starts[k] = min(starts.get(k, d), d)
    want = Counter()
    for d, t in rows:
        w = helpers.words(t)
        gone = {j for i in range(len(w) - 49) if starts[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[d, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, batch int, probes string").repartition(3)
    got = substring.drop_repeats(docs, batch_bytes=batch_bytes)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.collect())


def test_repeats_null_ids(spark):
    rows = [(None, helpers.PASSAGE), (5, helpers.PASSAGE), (None, helpers.PASSAGE), (None, None)]
    got = substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=True).collect()
    assert Counter((r.doc_id, r.n_removed, r.kept_text) for r in got) == Counter([(5, 0, helpers.PASSAGE), (None, 60, ""), (None, 60, ""), (None, 0, "")])
    assert substring.drop_repeats(helpers.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("buckets", (1, 8, 4096))
def test_packed_keys(seed, buckets):
    k, floors = np.unique(np.random.default_rng(seed).integers(0, 1 << 48, 2000 * seed, np.uint64)), substring.bucket_floors(buckets)
    cut = np.searchsorted(k, floors)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    got, row = substring.unpack(pa.chunked_array([substring.pack(k, cut[some + 1], floors[some])]))
    back = got + floors[some][row]
    assert np.isin(k, back).all() and len(back) <= len(k) + (1 << 16) + 1


def test_repeats_are_of_equal_words(spark):
    """Two words of 4,096 letters that have one hash by any polynomial mod 2^64 are two words."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    body = [f"w{i}" for i in range(49)]
    rows = [(1, " ".join([*body, word])), (2, " ".join([*body, other])), (3, " ".join([*body, word]))]
    got = {r.doc_id: r.n_removed for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    links = {r.doc_id: (r.n_links, r.copies) for r in jaccard.near_copies(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")).collect()}
    assert links == {1: (0, 2), 2: (0, 1), 3: (0, 2)}


def test_repeats_of_a_text_beyond_the_batch(spark):
    rows = [(i, helpers.LONG + f" t{i}") for i in (1, 2)] + [(None, helpers.PASSAGE), (None, helpers.PASSAGE + " x"), (3, helpers.PASSAGE)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=500).collect()}
    assert got == {(1, 12_001): 0, (2, 12_001): 12_000, (None, 60): 60, (None, 61): 60, (3, 60): 0}


def test_numbered_runs():
    rng = random.Random(3)
    rows = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))).encode() for _ in range(60)] + [None, b"a", b"a b", b"a b c d"]
    number, text = jaccard.numbered_runs(substring.Words(rows))
    runs = [tuple(w[i : i + 5]) for r in rows for w in [(r or b"").split()] for i in range(len(w) - 4)] + [tuple(w) for r in rows for w in [(r or b"").split()] if 0 < len(w) < 5]
    assert len(runs) == len(number) == len(text)
    assert len(set(zip(runs, number.tolist()))) == len(set(runs)) == len(set(number.tolist()))


# 8: media


def test_media(spark):
    got = media.text_media(helpers.small(spark), split_bytes=5_000).collect()
    want = Counter()
    for i, t in texts():
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[i, len(b), len(p), sha(p), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.text_media(helpers.empty(spark)).count() == 0


def test_media_is_png(tmp_path):
    """Members read by another reader: chunk by chunk from the standard, lines unfiltered one byte at a time."""
    for payload in (b"", b"a", b"xyz" * 50, bytes(range(256)) * 3):
        m = media.to_png(payload)
        assert m[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        f, chunks = io.BytesIO(m[8:]), {}
        while head := f.read(8):
            data = f.read(int.from_bytes(head[:4], "big"))
            assert int.from_bytes(f.read(4), "big") == zlib.crc32(head[4:] + data)
            chunks.setdefault(head[4:], []).append(data)
        width, height = (int.from_bytes(chunks[b"IHDR"][0][k : k + 4], "big") for k in (0, 4))
        assert chunks[b"IHDR"][0][8:] == bytes([8, 0, 0, 0, 0]) and list(chunks)[-1] == b"IEND"
        raw = zlib.decompress(b"".join(chunks[b"IDAT"]))
        lines = [raw[k : k + width + 1] for k in range(0, len(raw), width + 1)]
        assert len(lines) == height and all(x[0] == 0 for x in lines)
        assert b"".join(x[1:] for x in lines) == payload.ljust(max(64, -(-len(payload) // 64) * 64), b"\0")
        assert media.from_png(m)[1] == len(payload)
    grey = media.to_png(b"abc")
    rgb = bytearray(grey)
    rgb[25] = 2  # colour type
    rgb[29:33] = zlib.crc32(rgb[12:29]).to_bytes(4, "big")
    packed = zlib.compress(bytes([1]) + bytes(64))
    filtered = grey[: grey.index(b"IDAT") - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + zlib.crc32(b"IDAT" + packed).to_bytes(4, "big") + grey[-12:]
    for other in (bytes(rgb), filtered):
        with pytest.raises(ValueError):
            media.from_png(other)


def test_media_members_are_tried_again(tmp_path):
    import io
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(20):
            z.writestr(f"{i:07d}-{i}.png", media.to_png(bytes([i]) * 1000))
    fails = {"left": 2}

    class Flaky(io.BytesIO):
        def read(self, n=-1):
            if self.tell() > 1200 and fails["left"] and n and n > 40 and not self.tell() > len(path.read_bytes()) - 1600:
                fails["left"] -= 1
                raise OSError("lost")
            return super().read(n)

    got = list(media.members(lambda: Flaky(path.read_bytes()), 0, 1 << 30))
    assert [media.from_png(m)[0][:1000].tobytes() for _, _, m in got] == [bytes([i]) * 1000 for i in range(20)]
    assert fails["left"] == 0
    halves = [o for a, b in ((0, 3000), (3000, 1 << 30)) for o, _, _ in media.members(lambda: path.open("rb"), a, b)]
    assert halves == [o for o, _, _ in got]


# 9: Jaccard join


@pytest.mark.parametrize("side", [1024, 4])
def test_near_copies(spark, monkeypatch, side):
    monkeypatch.setattr(jaccard, "KEY_SIDE", side)
    monkeypatch.setattr(jaccard, "CLUSTER_SIDE", side)
    rng = random.Random(4)
    base = [[f"b{k}_{j}" for j in range(rng.randint(30, 120))] for k in range(4)]
    rows = texts()
    for i in range(200, 260):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(i, t, 1, 2, b"s") for i, t in rows], "doc_id long, text string, node int, uid int, sig binary").repartition(3)
    want = helpers.near_copies(rows)
    assert Counter(map(tuple, jaccard.near_copies(docs).collect())) == want
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns
    kept = Counter(r.doc_id for r in left.collect())
    assert {i for i in kept if i is not None} == {w[1] for w in want if w[1] is not None} - {w[1] for w in want if w[0] is None and w[0] == w[1]}
    once = Counter({i: 1 for i in kept})
    once[18] = 2  # the id of two texts, which are classes of their own
    assert {i: n for i, n in kept.items() if i is not None} == {i: n for i, n in once.items() if i is not None}


def test_a_row_repeated_many_times(spark):
    """A row that comes 200,000 times is worked on as one, and each of its rows gets the answer."""
    near = helpers.PASSAGE.split()
    near[30] = "other"
    few = spark.createDataFrame([(3, helpers.PASSAGE + " tail"), (9, " ".join(near)), (7, "short"), (7, None), (7, "")], "doc_id long, text string")
    many = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(helpers.PASSAGE).alias("text"))
    docs = many.unionByName(few)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    folded = common.fold_repeats(rows, "doc_id", "digest", common.repeated_rows(rows, "doc_id", "digest"))
    assert Counter((r.doc_id, r.text, r.times) for r in folded.collect()) == Counter([(3, helpers.PASSAGE + " tail", 1), (9, " ".join(near), 1), (7, "short", 1), (7, "", 2), (7, helpers.PASSAGE, 200_000)])
    got = {(r.doc_id, r.n_words, r.n_removed): r.n for r in substring.drop_repeats(docs).groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {(3, 61, 0): 1, (9, 60, 0): 1, (7, 60, 60): 200_000, (7, 1, 0): 1, (7, 0, 0): 2}
    got = {(r.doc_id, r.class_id, r.copies, r.n_links): r.n for r in jaccard.near_copies(docs).groupBy("doc_id", "class_id", "copies", "n_links").agg(F.count("*").alias("n")).collect()}
    assert got == {(3, 3, 1, 2): 1, (9, 3, 1, 2): 1, (7, 3, 200_000, 2): 200_000, (7, 7, 1, 0): 1, (7, 7, 2, 0): 2}


def test_near_copies_empty(spark):
    assert jaccard.near_copies(helpers.empty(spark)).count() == 0 and jaccard.drop_near_copies(helpers.empty(spark)).count() == 0


def test_near_copies_at_a_lower_threshold(spark):
    rng = random.Random(8)
    base = [[f"b{k}_{j}" for j in range(100)] for k in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {t: helpers.shingle_set(t) for _, t in rows}
    want = {i: sum(2 * len(sets[t] & sets[u]) >= len(sets[t] | sets[u]) for u in sets if u != t) for i, t in rows}
    got = {r.doc_id: r.n_links for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 0.5).collect()}
    assert got == want
    assert [jaccard.band_rows(t) for t in (0.95, 0.8, 0.5, 0.2)] == [4, 4, 2, 1]
    with pytest.raises(ValueError):
        jaccard.band_rows(0.05)


def test_least_matches():
    least = jaccard.least_matches()
    assert list(least) == list(range(16, 129, 16)) and all(least[n] < 0.8 * n for n in least) and least[128] > 0.5 * 128


# 10: URLs


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x?q"), (4, "https://a.example.com/en/1"), (5, "https://example.com/de/"), (6, "http://x.net/es/1"), (7, "http://notexample.com/en/"), (8, "http://x.com"), (9, ""), (9, "http://x.org/é\n1#f"), (10, "http://net/fr/://x")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, html string, score int").repartition(2)
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_filter.filter_urls(pages).collect()), key=str)
    want = [
        (1, "", "", None), (2, "", "", None), (3, "www.example.com", "/en/x", "www.example.com/en/"), (4, "a.example.com", "/en/1", "example.com/en/"), (5, "example.com", "/de/", "com/"),
        (6, "x.net", "/es/1", "net/es/"), (7, "notexample.com", "/en/", "com/"), (8, "x.com", "", None), (9, "", "", None), (9, "x.org", "/é\n1", None), (10, "net", "/fr/://x", "net/fr/"),
    ]
    assert got == sorted(want, key=str)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    one_sided = url_filter.filter_urls(pages.where("page_id in (2, 5)")).collect()
    assert {r.verdict for r in one_sided} == {"allow"}


def test_url_model_tells_classes_apart(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h{i}.{'com' if i % 2 else 'net'}/{'es/casino-' if i % 2 == 0 else 'news/'}{rng.randrange(10**5)}") for i in range(200)]
    rows += [(1000 + i, f"http://h{i}.org/{'es/casino-' if i % 2 == 0 else 'news/'}{rng.randrange(10**5)}") for i in range(100)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[1000 + i] == ("block" if i % 2 == 0 else "allow") for i in range(100)) >= 95


def test_url_scores(spark):
    """Score, cut and verdict against models of nested dictionaries; the same for a scan, a shuffle and repeated rows."""
    rng = random.Random(12)
    part = lambda: "".join(rng.choice("abAB01é-") for _ in range(rng.randrange(6)))
    rows = [(i, f"http://{part()}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es/', 'fr/', 'en/', ''])}{part()}") for i in range(120)] + [(7, None), (7, ""), (8, "x"), (9, "http://a.com/"), (9, "http://a.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(map(tuple, url_filter.filter_urls(pages).collect()), key=str)
    assert got == sorted(map(tuple, url_filter.filter_urls(pages.repartition(5)).collect()), key=str)
    kind = {}
    for _, u in rows:
        host, _, path = (u or "").partition("://")[2].partition("/")
        fits = [(len(h + p), s) for h, p, s in url_filter.RULES if (host.lower() == h or host.lower().endswith("." + h)) and ("/" + path).startswith(p)]
        kind[u] = max(fits)[1] if fits and u else None
    order = url_filter.ORDER
    counts = {k: {"allow": Counter(), "block": Counter()} for k in range(order + 1)}
    grams = lambda u: [("^" * order + u)[i : i + order + 1] for i in range(len(u))]
    for _, u in rows:
        for g in grams(u or ""):
            for k in range(order + 1):
                if kind[u]:
                    counts[k][kind[u]][g[order - k :]] += 1
    letters = {c for _, u in rows for c in u or ""}

    def likely(s, g):
        p = (counts[0][s][g[-1]] + 1) / (sum(counts[0][s].values()) + len(letters))
        for k in range(1, order + 1):
            context = g[order - k : order]
            p = (counts[k][s][context + g[-1]] + 8 * p) / (sum(n for x, n in counts[k][s].items() if x[:-1] == context) + 8)
        return p

    gain = {g: round(1e6 * (np.log(likely("allow", g)) - np.log(likely("block", g)))) for _, u in rows for g in grams(u or "")}
    score = {u: round(np.mean([gain[g] for g in grams(u)])) if u else 0 for _, u in rows}
    of = {s: [score[u] for _, u in rows if kind[u] == s] for s in ("allow", "block")}
    dev = {s: max(np.std(x), 1) for s, x in of.items()}
    cut = (np.mean(of["allow"]) * dev["block"] + np.mean(of["block"]) * dev["allow"]) / sum(dev.values())
    want = sorted((i, score[u], kind[u] or ("allow" if score[u] >= cut else "block")) for i, u in rows)
    assert {abs(r[6] - cut) < 1.5 for r in got} == {True}
    assert sorted((a[0], a[2]) for a in want) == sorted((r[0], r[4]) for r in got)
    assert all(abs(a[1] - b) <= 1 for a, b in zip(want, [s for _, s in sorted((r[0], r[5]) for r in got)]))


def test_a_very_long_url(spark):
    rows = [(1, "http://x.com/" + "ab/c" * 250_000), (2, "http://y.net/fr/z")]
    got = {r.page_id: (r.verdict, r.rule, len(r.path)) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {1: ("allow", "com/", 1_000_001), 2: ("block", "net/fr/", 5)}


# shared helpers


def test_maybe_among(spark):
    rows = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"), "id")
    few = rows.where("id % 50 = 0").select(F.col("d").alias("_sha"))
    got = common.maybe_among(rows, F.col("d"), few, 1 << 16).collect()
    assert len(got) == 3000 and all(r._maybe for r in got if r.id % 50 == 0)
    assert sum(r._maybe for r in got) < 70
    assert not any(r._maybe for r in common.maybe_among(rows, F.col("d"), few.limit(0)).collect())


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "t").collect())) == want


def test_salted_join(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", i) for i in range(200)], "k string, i long")
    got = common.group_lookup(df, ["k"], F.col("i"), {"most": (F.col("i"), "max")}).collect()
    assert Counter((r.k, r.most) for r in got) == Counter({(None, 49): 50, ("a", 199): 200})
