"""Secret scans: patterns of known forms, and sliding-window Shannon entropy by character class.

``PATTERNS`` find what has the form of a secret. The method adds what has none: candidate strings are maximal runs of a
class of characters (``CLASSES``); a window slides over a candidate, one character in and one out, and the counts of its
characters and the sum of c * log2(c) over them are updated by these two only. A window whose entropy reaches the bits of
its class, and which has characters of all the kinds that the class asks for, is hot; hot windows that overlap or touch
are one span. Candidates in which a pattern of ``ALLOWED`` is found (placeholders, alphabets, published digests of files)
are passed over, and so are spans that lie within one of the patterns'. Sums are whole millionths, so reruns agree.

How it is spread: everything is an expression on one row, so a row is read once and nothing is exchanged. A text without
any candidate costs a search for each kind. Candidates are cut into blocks of ``BLOCK`` characters that share a window less one,
and matches are counted out in blocks of ``LAID``, so time grows in proportion to a text.

Edge cases: a null text is empty; an empty text has no spans; texts may have any length; positions are code points, ends
exclusive; rows with the same id or text are scanned one by one; an empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: kind -> (pattern, group that is the secret, its least number of characters)
PATTERNS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Class:
    """Candidates of one class of characters: runs of the alphabet with a window or more. needs: kinds that a window has to hold."""

    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float
    needs: tuple[str, ...]

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c), in millionths, of a window that is hot."""
        return math.floor((self.window * math.log2(self.window) - self.window * self.bits) * 1e6)


CLASSES = (
    Class("entropy_hex", DIGITS + "ABCDEFabcdef", "[0-9A-Fa-f]{20,}", 20, 3.0, (DIGITS, "ABCDEFabcdef")),
    Class("entropy_mixed", DIGITS + UPPER + LOWER + "+/_-", "[A-Za-z0-9+/_-]{24,}", 24, 3.9, (DIGITS, UPPER, LOWER)),
)
#: what no secret holds, searched for in the candidate in lower case
ALLOWED = ("example|sample|dummy|placeholder|changeme|redacted|xxxx", "0123456789|abcdefghij|qwertyuiop", "^sha(1|256|384|512)-")
BLOCK, LAID = 4096, 512
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _laid(items: Column) -> Column:
    """Places of matches: items (gap, size, ...) in order -> the same with ``start``. Blocks first, then the blocks' offsets."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(LAID)), lambda i: F.slice(items, i + 1, F.lit(LAID)))

    def within(block: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(block, none, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")))

    parts = F.transform(blocks, within)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    before = F.aggregate(parts, start, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before")))["before"]
    return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["starts"], lambda x: x + b)))


def _places(rows: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """rows with ``name``: array<struct<start, match, secret>> of the matches in _text, leftmost and not overlapping."""
    whole, secret, gaps = f"{name}_whole", f"{name}_secret", f"{name}_gaps"
    some = F.col("_text").rlike(pattern)

    def of(column: Column) -> Column:
        return F.when(some, column).otherwise(F.array().cast("array<string>"))

    rows = rows.withColumns({whole: of(F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))), secret: of(F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))), gaps: of(F.split("_text", pattern, -1))})
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.col(whole), lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size")))
    rows = rows.withColumn(f"{name}_sizes", sizes)
    rows = rows.withColumn(f"{name}_start", _laid(F.col(f"{name}_sizes")))
    found = F.transform(F.arrays_zip(f"{name}_start", whole, secret), lambda m: F.struct(m[f"{name}_start"].alias("start"), m[whole].alias("match"), m[secret].alias("secret")))
    return rows.withColumn(name, found).drop(whole, secret, gaps, f"{name}_sizes", f"{name}_start")


def _formed(rows: DataFrame, kind: int, pattern: str, group: int, least: int) -> DataFrame:
    """rows with _k<kind>: what a pattern finds."""
    if not group:  # the same runs, without those that are too short
        head = pattern.removesuffix("+")
        pattern = f"{head}{{{least - head.index('[')},}}"
    kept = F.filter("_at", lambda m: F.char_length(m["secret"]) >= least)
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["match"])).alias("end")))
    return _places(rows, "_at", pattern, group).withColumn(f"_k{kind}", spans.cast(_SPANS)).drop("_at")


def _merged(spans: Column, kind: int) -> Column:
    """Spans in order of start, those that overlap or touch made one."""
    kinds = "struct<start:int,end:int>"
    start = F.struct(F.lit(None).cast(kinds).alias("open"), F.array().cast(f"array<{kinds}>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        joins = F.coalesce(x["start"] <= s["open"]["end"], F.lit(False))
        last = F.struct(F.when(joins, s["open"]["start"]).otherwise(x["start"]).alias("start"), x["end"].alias("end"))
        return F.struct(last.alias("open"), F.when(joins | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"))

    whole = F.aggregate(spans, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return F.transform(whole, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbers(values: Iterable[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _hot(block: Column, c: Class) -> Column:
    """array<struct<start, end>> of a block: its hot windows, in order, those that overlap or touch made one."""
    table = _numbers(round(n * math.log2(n) * 1e6) if n else 0 for n in range(c.window + 1))  # c * log2(c)
    code = F.transform(F.split(block, ""), lambda x: F.position(x, F.lit(c.alphabet)).cast("int"))
    holds = [_numbers(int(x in chars) for x in c.alphabet) for chars in c.needs]
    span = "struct<start:int,end:int>"
    state = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).alias("sum"), F.array_repeat(F.lit(0), len(holds)).alias("held"),
        F.lit(None).cast(span).alias("open"), F.array().cast(f"array<{span}>").alias("done"),
    )

    def at(values: Column, place: Column) -> Column:
        return F.coalesce(F.get(values, place), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"] - 1, x["leaves"] - 1, x["i"]
        n, m = at(s["counts"], enters), at(s["counts"], leaves)
        same = enters == leaves
        gained = F.get(table, n + 1) - F.get(table, n)
        lost = F.when(leaves >= 0, F.get(table, m) - F.get(table, m - 1)).otherwise(0)
        total = s["sum"] + F.when(same, 0).otherwise(gained - lost)
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda v, k: v + (k == enters).cast("int") - (k == leaves).cast("int")))
        held = F.array(*[F.get(s["held"], F.lit(j)) + at(h, enters) - at(h, leaves) for j, h in enumerate(holds)])
        hot = (i >= c.window) & (total <= c.most) & F.forall(held, lambda v: v > 0)
        return _let(F.struct(counts.alias("counts"), total.alias("sum"), held.alias("held"), hot.alias("hot")), lambda y: marked(s, i, y))

    def marked(s: Column, i: Column, y: Column) -> Column:
        begin = i - c.window
        joins = F.coalesce(begin <= s["open"]["end"], F.lit(False))
        open_ = F.struct(F.when(joins, s["open"]["start"]).otherwise(begin).alias("start"), i.alias("end"))
        done = F.when(y["hot"] & ~joins & s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        return F.struct(y["counts"].alias("counts"), y["sum"].alias("sum"), y["held"].alias("held"), F.when(y["hot"], open_).otherwise(s["open"]).alias("open"), done.alias("done"))

    moves = _let(code, lambda codes: F.transform(codes, lambda x, i: F.struct(x.alias("enters"), at(codes, i - c.window).alias("leaves"), (i + 1).alias("i"))))
    return F.aggregate(moves, state, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def _entropy(rows: DataFrame, kind: int, c: Class, allowed: tuple[str, ...]) -> DataFrame:
    """rows with _k<kind>: spans of hot windows in candidates of a class."""
    suspect = F.filter("_at", lambda m: ~F.lower(m["match"]).rlike("|".join(f"(?:{a})" for a in allowed))) if allowed else F.col("_at")

    def blocks(m: Column) -> Column:
        cut = F.regexp_extract_all(m["match"], F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
        more = lambda xs, i: F.coalesce(F.substring(F.get(xs, i + 1), 1, c.window - 1), F.lit(""))
        return _let(cut, lambda xs: F.transform(xs, lambda x, i: F.struct(F.concat(x, more(xs, i)).alias("text"), (m["start"] + i * BLOCK).alias("at"))))

    rows = _places(rows, "_at", c.pattern).withColumn("_blocks", F.transform(suspect, blocks))
    hot = F.transform("_blocks", lambda bs: F.transform(bs, lambda b: F.struct(b["at"].alias("at"), _hot(b["text"], c).alias("hot"))))
    rows = rows.withColumn("_hot", hot)
    within = F.transform("_hot", lambda bs: F.flatten(F.transform(bs, lambda b: F.transform(b["hot"], lambda h: F.struct((b["at"] + h["start"]).alias("start"), (b["at"] + h["end"]).alias("end"))))))
    rows = rows.withColumn("_hot", within)
    return rows.withColumn(f"_k{kind}", F.flatten(F.transform("_hot", lambda spans: _merged(spans, kind))).cast(_SPANS)).drop("_at", "_blocks", "_hot")


def secret_spans(docs: DataFrame, patterns=PATTERNS, classes: tuple[Class, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """A row a document: doc_id, base and spans (array of kind, start, end, in order of start, then kind): what the patterns
    find, and that with what the method adds."""
    kinds = [*patterns, *[c.kind for c in classes]]
    named, n = F.array(*map(F.lit, kinds)), len(patterns)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for k, pattern in enumerate(patterns.values()):
        rows = _formed(rows, k, *pattern)
    for k, c in enumerate(classes, n):
        rows = _entropy(rows, k, c, allowed)
    rows = rows.select("doc_id", F.array_sort(F.concat(*[f"_k{k}" for k in range(n)])).alias("_base"), F.concat(*[f"_k{k}" for k in range(n, len(kinds))]).alias("_more"))
    new = F.filter("_more", lambda m: ~F.exists("_base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))

    def shown(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.get(named, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select("doc_id", shown(F.col("_base")).alias("base"), shown(F.array_sort(F.concat("_base", new))).alias("spans"))


def scan_digests(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_spans(docs).select("doc_id", *map(number, PATTERNS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def _oracle() -> str:
    def laid(name: str, pattern: str, group: int) -> str:
        p, quote = pattern.replace("'", "''"), f"regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}'"
        return f"""{name}_m AS (SELECT r, string_split_regex(t, '{p}') AS g, {quote}, 0) AS m, {quote}, {group}) AS s FROM d WHERE regexp_matches(t, '{p}')),
{name}_p AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(g[1:len(m)]) AS g, unnest(m) AS m, unnest(s) AS s FROM {name}_m),
{name} AS (SELECT r, m, s, (sum(len(g)) OVER w + sum(len(m)) OVER w - len(m))::BIGINT AS a FROM {name}_p WINDOW w AS (PARTITION BY r ORDER BY i)),
"""

    out = "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\n"
    base, more = [], []
    for k, (name, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += laid(name, pattern, group)
        base.append(f"SELECT r, {k} AS k, '{name}' AS kind, a, a + len(m) AS z FROM {name} WHERE len(s) >= {least}")
    out += f"base AS ({' UNION ALL '.join(base)}),\n"
    for k, c in enumerate(CLASSES, len(PATTERNS)):
        n, f = c.kind, "[" + ", ".join(str(round(x * math.log2(x) * 1e6)) for x in range(1, c.window + 1)) + "]"
        needs = " AND ".join(f"regexp_matches(w, '[{x}]')" for x in c.needs)
        out += laid(n, c.pattern, 0)
        out += f"""{n}_w AS (SELECT r, a, a + i AS x, m[i + 1:i + {c.window}] AS w FROM (SELECT r, a, m, unnest(range(0, len(m) - {c.window} + 1)) AS i FROM {n} WHERE NOT regexp_matches(lower(m), '{"|".join(f"(?:{x})" for x in ALLOWED)}'))),
{n}_c AS (SELECT r, a, x, w, c, count(*) AS n FROM (SELECT r, a, x, w, unnest(string_split(w, '')) AS c FROM {n}_w) GROUP BY ALL),
{n}_h AS (SELECT r, a, x FROM {n}_c GROUP BY r, a, x, w HAVING sum(({f})[n]) <= {c.most} AND {needs}),
{n}_b AS (SELECT r, a, x, coalesce(x > lag(x) OVER (PARTITION BY r, a ORDER BY x) + {c.window}, true)::INT AS b FROM {n}_h),
{n}_s AS (SELECT r, {k} AS k, '{n}' AS kind, min(x) AS a, max(x) + {c.window} AS z FROM (SELECT r, a, x, sum(b) OVER (PARTITION BY r, a ORDER BY x) AS g FROM {n}_b) GROUP BY r, a, g),
"""
        more.append(f"SELECT * FROM {n}_s m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.a <= m.a AND m.z <= b.z)")
    out += f"""every AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(more)}),
b AS (SELECT r, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k, z) AS s, {', '.join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in PATTERNS)} FROM base GROUP BY r),
e AS (SELECT r, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k, z) AS s FROM every GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{x}, 0) AS n_{x}' for x in PATTERNS)}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans FROM d LEFT JOIN b USING (r) LEFT JOIN e USING (r)"""
    return out


ORACLE = _oracle()
