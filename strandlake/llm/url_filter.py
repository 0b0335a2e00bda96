"""URL filters: host rules, and for other urls a ratio of two character language models.

``RULES`` judge the urls that they fit; these urls also teach two variable-order Markov models, one of accepted and one
of rejected urls. A model counts every character, as it is, after each of its last ``ORDER`` characters and after fewer, down
to none; an order is smoothed by the next lower one with ``PRIOR`` imagined characters, the lowest by one for each character
of the alphabet that the urls have. Model tables grow with the urls; they are joined by gram and never broadcast as such. A
url's score is the mean over its characters of the difference of their log likelihoods, in millionths, so sums are whole
numbers and reruns agree. The cut is calibrated on the rules' urls: the point between the two classes' mean scores that
lies as many standard deviations from either. A url passes from the cut on. If the rules reject nothing or accept nothing,
there is no cut and the other urls pass.

How it is spread: equal urls are counted first and scored once. Grams are counted before their exchange; a gram that all
urls have is looked up once in each of 64 parts of the urls, so no task holds all places of one gram.

Edge cases: a null url, or one without "://", has an empty host and path and fits no rule; a null or empty url has the
score of an empty mean, 0. A url may be of any length: grams are made in one pass over its characters, 1 MB in about a
second. Equal urls have equal scores and verdicts; rows with the same page_id are judged one by one. An empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import salted_join, staged

#: fixed values: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER, PRIOR, BEFORE = 5, 8.0, "^"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _judged(pages: DataFrame, rules) -> DataFrame:
    at = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url")).select(
        "*", F.translate(F.regexp_extract("_url", PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract("_url", PARTS, 2).alias("path"), F.monotonically_increasing_id().alias("_row")
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest comes last and is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return at.withColumn("rule", rule).withColumn("_says", verdict)


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row a character: _gram is the character behind the ORDER ones before it (BEFORE stands before the first)."""
    letters, n = F.split("_url", ""), F.char_length("_url")
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(BEFORE), k), letters), F.lit(1), n).alias(f"_{k}") for k in range(ORDER, -1, -1)]
    rows = urls.where("_url <> ''").select(*keep, F.inline(F.arrays_zip(*shifted)))
    return rows.select(*keep, F.concat(*[f"_{k}" for k in range(ORDER, -1, -1)]).alias("_gram"))


def _model(grams: DataFrame) -> DataFrame:
    """A row a gram: how many millionths likelier its last character is, after the others, in accepted urls. grams: _gram, _a, _b."""
    full = staged(grams.groupBy("_gram").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")), "url-grams")
    likely = None
    for k in range(1, ORDER + 2):
        level = full.groupBy(F.substring("_gram", ORDER + 2 - k, k).alias("_gram")).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")) if k <= ORDER else full
        if k == 1:
            level = staged(level, "url-letters")  # a row a character of the alphabet
            total = [level.agg(f).scalar() for f in (F.sum("_a"), F.sum("_b"), F.count(F.lit(1)))]
            likely = level.select("_gram", *[((F.col(f"_{x}") + 1.0) / (total[i] + total[2])).alias(f"_p{x}") for i, x in enumerate("ab")])
            continue
        context = Window.partitionBy(F.substring("_gram", 1, k - 1))  # as many rows as the alphabet has characters, at most
        level = level.select("*", *[F.sum(f"_{x}").over(context).alias(f"_all_{x}") for x in "ab"], F.substring("_gram", 2, k - 1).alias("_shorter"))
        level = level.join(likely.withColumnRenamed("_gram", "_shorter").hint("merge"), "_shorter")
        likely = level.select("_gram", *[((F.col(f"_{x}") + F.col(f"_p{x}") * PRIOR) / (F.col(f"_all_{x}") + PRIOR)).alias(f"_p{x}") for x in "ab"])
    return likely.select("_gram", F.round((F.log("_pa") - F.log("_pb")) * 1e6).cast("long").alias("_gain"))


def _cut(urls: DataFrame) -> Column:
    """The cut, from url scores and how often each url comes; null without urls of either class."""
    score, n = F.col("score").cast("decimal(19,0)"), F.col("_n").cast("decimal(19,0)")

    def moments(says: str) -> list[Column]:
        of = F.col("_says") == says
        return [F.sum(F.when(of, x)).cast("double") for x in (n, n * score, (n * score).cast("decimal(28,0)") * score)]

    sums = urls.agg(*[m.alias(f"{s}{i}") for s in ("allow", "block") for i, m in enumerate(moments(s))])
    mean = {s: F.col(f"{s}1") / F.col(f"{s}0") for s in ("allow", "block")}
    apart = {s: F.greatest(F.sqrt(F.greatest(F.col(f"{s}2") / F.col(f"{s}0") - mean[s] * mean[s], F.lit(0.0))), F.lit(1.0)) for s in mean}
    return sums.select(F.round((mean["allow"] * apart["block"] + mean["block"] * apart["allow"]) / (apart["allow"] + apart["block"])).cast("long").alias("cut")).scalar()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict, score (millionths a character), cut."""
    judged = staged(_judged(pages, rules), "urls-judged")
    urls = staged(judged.groupBy("_url", "_says").agg(F.count(F.lit(1)).alias("_n")).withColumn("_uid", F.monotonically_increasing_id()), "urls")
    learnt = urls.select("_url", *[F.when(F.col("_says") == s, F.col("_n")).otherwise(0).alias(x) for s, x in (("allow", "_a"), ("block", "_b"))])
    gains = salted_join(_grams(urls, "_uid"), staged(_model(_grams(learnt, "_a", "_b")), "url-model"), ["_gram"], F.col("_uid"), merge=True)
    known = gains.groupBy("_uid").agg(F.round(F.avg("_gain")).cast("long").alias("score"))
    scored = staged(urls.join(known.hint("merge"), "_uid", "left").select("_url", "_says", "_n", F.coalesce("score", F.lit(0).cast("long")).alias("score")), "url-scores")
    rows = salted_join(judged, scored.select("_url", "score"), ["_url"], F.col("_row"), merge=True).withColumn("cut", _cut(scored))
    passes = F.coalesce(F.col("score") >= F.col("cut"), F.lit(True))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_says", F.when(passes, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score", "cut")


def _levels() -> str:
    """SQL: the counts and likelihoods of each order."""
    top, out = ORDER + 1, ""
    for k in range(top - 1, 0, -1):
        out += f"l{k} AS (SELECT right(g, {k}) AS g, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM l{k + 1} GROUP BY 1),\n"
    out += "p1 AS (SELECT g, (a + 1e0::DOUBLE) / (sum(a) OVER () + count(*) OVER ())::DOUBLE AS pa, (b + 1e0::DOUBLE) / (sum(b) OVER () + count(*) OVER ())::DOUBLE AS pb FROM l1),\n"
    for k in range(2, top + 1):
        p = ", ".join(f"({x} + p{x} * 8e0::DOUBLE) / ((sum({x}) OVER (PARTITION BY left(l{k}.g, {k - 1})))::DOUBLE + 8e0::DOUBLE) AS p{x}" for x in "ab")
        out += f"p{k} AS (SELECT l{k}.g, {p} FROM l{k} JOIN p{k - 1} ON p{k - 1}.g = right(l{k}.g, {k - 1})),\n"
    return out


ORACLE = (
    r"""
WITH h AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
r AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM h),
j AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS says FROM r),
q AS (SELECT url, says, count(*) AS n FROM j GROUP BY url, says),
c AS (SELECT url, says, n, substring('^^^^^' || url, i, 6) AS g FROM (SELECT url, says, n, unnest(range(1, length(url) + 1)) AS i FROM q)),
l6 AS (SELECT g, sum(CASE WHEN says = 'allow' THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN says = 'block' THEN n ELSE 0 END)::BIGINT AS b FROM c GROUP BY g),
"""
    + _levels()
    + r"""m AS (SELECT g, round(1e6::DOUBLE * (ln(pa) - ln(pb)))::BIGINT AS gain FROM p6),
k AS (SELECT url, round(avg(gain))::BIGINT AS score FROM c JOIN m USING (g) GROUP BY url),
s AS (SELECT url, q.says AS kind, n, coalesce(score, 0) AS score FROM q LEFT JOIN k USING (url)),
t AS (SELECT kind, sum(n)::DOUBLE AS n, sum(n * score)::DOUBLE / sum(n)::DOUBLE AS mean, sum(n::HUGEINT * score * score)::DOUBLE AS squares FROM s WHERE kind IS NOT NULL GROUP BY kind),
v AS (SELECT kind, mean, greatest(sqrt(greatest(squares / n - mean * mean, 0e0::DOUBLE)), 1e0::DOUBLE) AS dev FROM t),
x AS (SELECT round((a.mean * b.dev + b.mean * a.dev) / (a.dev + b.dev))::BIGINT AS cut FROM v a JOIN v b ON a.kind = 'allow' AND b.kind = 'block')
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN coalesce(score >= (SELECT cut FROM x), true) THEN 'allow' ELSE 'block' END) AS verdict,
       score, (SELECT cut FROM x) AS cut FROM j JOIN s USING (url)
"""
)
