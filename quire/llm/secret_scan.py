"""Secrets in texts: three fixed patterns and a battery of randomness tests.

Every run of 20 or more token characters gets the smallest alphabet it may be
written in, and three tests of the hypothesis that its symbols are drawn uniformly
and independently: chi-squared of the symbol counts, runs above and below the middle
of the alphabet, and serial correlation at lag one. Fisher's method joins the three.

Random tokens have uniform p-values, ordinary ones have p-values near zero, the nearer
the longer they are. For each alphabet and class of lengths the share of random tokens
follows from the upper half of the p-values over the whole corpus; a token is reported
if its p-value reaches the class's threshold, the least at which the expected share of
ordinary tokens among the reported stays within ``fdr``. Classes too short to tell
random from ordinary thus report nothing.

Everything is DataFrame and SQL functions. What reaches the driver is one histogram
whose size depends on the number of classes alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_column

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the narrowest first: name, pattern of a whole token, symbols in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _UPPER.lower()),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _UPPER.lower()),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("letters", "^[A-Za-z]+$", _UPPER + _UPPER.lower()),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _UPPER.lower()),
    ("base64", "^[0-9A-Za-z+/]+$", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", _UPPER + _UPPER.lower() + _DIGITS + "-_"),
    ("mixed", "", _UPPER + _UPPER.lower() + _DIGITS + "+/-_"),
)
BINS = 50
#: Characters of a long text that are redacted at once.
CHUNK = 4096


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def chunked(items: Column) -> Column:
    """items in chunks of about the square root of their number, in order."""
    size = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))), F.lit(1)).cast("int")
    return let(size, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / c).cast("int")), lambda k: F.slice(items, k * c + 1, c)))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column) -> Column:
    """The sum of the numbers (some) before each: by chunk, then within it, so n of them take n ** 1.5 steps."""

    def within(chunks):
        totals = F.transform(chunks, total)
        return let(
            totals,
            lambda t: F.flatten(F.transform(chunks, lambda chunk, k: let(total(F.slice(t, 1, k)), lambda base: F.transform(chunk, lambda _, j: base + total(F.slice(chunk, 1, j)))))),
        )

    return let(chunked(numbers), within)


def with_matches(rows: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """rows and ``name``: array<struct<start int, end int, found string>> of the leftmost matches in text, in code points.

    Step by step in columns of their own, so that nothing is evaluated once a match.
    """
    found, gaps, before = (F.col(f"{name}_{part}") for part in ("found", "gaps", "before"))
    numbers = F.array().cast("array<int>")
    hit = F.when(F.col(text).rlike(pattern), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn(f"{name}_found", hit)
    rows = rows.withColumn(f"{name}_gaps", F.when(F.size(found) > 0, F.transform(F.split(F.col(text), pattern, -1), F.length)).otherwise(numbers))
    rows = rows.withColumn(f"{name}_steps", let(gaps, lambda g: F.transform(found, lambda one, i: g[i] + F.length(one))))
    rows = rows.withColumn(f"{name}_before", F.when(F.size(found) > 0, let(F.col(f"{name}_steps"), sums_before)).otherwise(numbers))

    def placed(known):
        return F.transform(found, lambda one, i: let(known["before"][i] + known["gaps"][i], lambda start: F.struct(start.alias("start"), (start + F.length(one)).alias("end"), one.alias("found"))))

    rows = rows.withColumn(name, let(F.struct(before.alias("before"), gaps.alias("gaps")), placed))
    return rows.drop(*(f"{name}_{part}" for part in ("found", "gaps", "steps", "before")))


def of_kind(kind: str, hits: Column) -> Column:
    """array<struct<start, order, end, kind>>, which sorts as spans are listed."""
    return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), h["end"].alias("end"), F.lit(kind).alias("kind")))


def with_base(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows and ``name``: the base spans in text, sorted."""
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        rows = with_matches(rows, text, f"{name}_{kind}", pattern)
    assign = F.filter(f"{name}_assign", lambda h: F.length(F.regexp_extract(h["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(of_kind("assign", assign), of_kind("access", F.col(f"{name}_access")), of_kind("hex", F.col(f"{name}_hex"))))
    return rows.withColumn(name, base).drop(f"{name}_assign", f"{name}_access", f"{name}_hex")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; the error is under 1e-6 (a rational approximation of erfc)."""

    def at(a):
        def half(t):
            return F.lit(0.5) * t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429))))) * F.exp(-a * a)

        return let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * a), half)

    return let(z, lambda x: let(at(F.abs(x) / F.lit(math.sqrt(2))), lambda tail: F.when(x >= 0, tail).otherwise(F.lit(1.0) - tail)))


def chi_squared(body: Column, symbols: Column, n: Column, k: Column) -> Column:
    """Normal score of the symbol counts' distance from uniform (Wilson and Hilferty's cube
    root, with the exact mean and variance for n draws); large for ordinary text."""
    squares = F.aggregate(
        F.sequence(F.lit(1), F.length(symbols)), F.lit(0.0),
        lambda a, i: a + F.pow((F.length(body) - F.length(F.replace(body, F.substring(symbols, i, F.lit(1))))).cast("double"), F.lit(2.0)),
    )
    freedom = (k - 1) * n / (n - 1)

    def score(f):
        return (F.pow(F.greatest(k / n * squares - n, F.lit(0.0)) / (k - 1), F.lit(1.0) / F.lit(3.0)) - (1 - F.lit(2.0) / (9 * f))) / F.sqrt(F.lit(2.0) / (9 * f))

    return let(freedom, score)


def runs(high: Column, pairs: Column, n: Column, k: Column) -> Column:
    """Normal score of the number of runs in the upper and the lower half of the alphabet."""
    found = F.size(F.filter(pairs, lambda p: (p["u"] * 2 >= k) != (p["v"] * 2 >= k))) + F.lit(1.0)

    def score(due):
        return (found - due) / F.sqrt(F.greatest((due - 1) * (due - 2) / (n - 1), F.lit(1e-9)))

    return let(high, lambda h: F.when((h == 0) | (h == n), F.lit(8.0)).otherwise(let(1 + 2 * (n - h) * h / n, score)))


def serial(x: Column, pairs: Column, n: Column) -> Column:
    """Normal score of the correlation of neighbouring symbols."""

    def about(middle):
        moved = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - middle) * (v - middle))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["u"] - middle) * (p["v"] - middle))
        return let(moved, lambda m: F.when(m == 0, F.lit(8.0)).otherwise((lagged / m + 1 / n) * F.sqrt(n)))

    return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n, about)


def battery(body: Column, symbols: Column) -> Column:
    """p-value of the joint test for one token over its alphabet."""
    n, k = F.length(body).cast("double"), F.length(symbols).cast("double")

    def fisher(half):
        return F.exp(-half) * (1 + half + half * half / 2)

    def joint(x):
        neighbours = F.zip_with(F.slice(x, F.lit(1), F.length(body) - 1), F.slice(x, F.lit(2), F.length(body) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))

        def tests(pairs):
            high = F.size(F.filter(x, lambda v: v * 2 >= k)).cast("double")
            tails = (upper_tail(chi_squared(body, symbols, n, k)), 2 * upper_tail(F.abs(runs(high, pairs, n, k))), 2 * upper_tail(F.abs(serial(x, pairs, n))))
            logs = [-F.log(F.greatest(p, F.lit(1e-300))) for p in tails]
            return let(logs[0] + logs[1] + logs[2], fisher)

        return let(neighbours, tests)

    return let(F.transform(F.split(body, ""), lambda c: F.instr(symbols, c) - 1), joint)


def encoding_of(body: Column) -> Column:
    found = F.lit(len(ENCODINGS) - 1)
    for at, (_, pattern, _) in reversed([*enumerate(ENCODINGS)][:-1]):
        found = F.when(body.rlike(pattern), F.lit(at)).otherwise(found)
    return found


def with_tested(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows and ``name``: array<struct<start, end, encoding, size, token, p>>, every candidate token in text with its class, hash and p-value."""
    names, alphabets = F.array(*(F.lit(name) for name, _, _ in ENCODINGS)), F.array(*(F.lit(letters) for _, _, letters in ENCODINGS))

    def one(h):
        def of(body):
            size = F.floor(F.log2(F.length(body).cast("double")) * 2).cast("int")
            return let(
                encoding_of(body),
                lambda e: F.struct(
                    h["start"].alias("start"), h["end"].alias("end"), names[e].alias("encoding"), size.alias("size"), F.xxhash64(body).alias("token"),
                    let(alphabets[e], lambda symbols: battery(body, symbols)).alias("p"),
                ),
            )

        return let(F.rtrim(h["found"], F.lit("=")), of)

    rows = with_matches(rows, text, f"{name}_tokens", TOKEN)
    return rows.withColumn(name, F.transform(f"{name}_tokens", one)).drop(f"{name}_tokens")


def thresholds(docs: DataFrame, fdr: float) -> dict[str, float]:
    """Least p-value that is reported, by "encoding size"; classes that report nothing are left out.

    A token counts once, however often it occurs: copies are no further draws.
    """
    tokens = with_tested(docs.select(text_column().alias("text")), "text", "tested").select(F.explode("tested").alias("t"))
    distinct = tokens.select("t.encoding", "t.size", "t.token", F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).distinct()
    bins = distinct.groupBy("encoding", "size", "bin").count()
    classes: dict[str, list[int]] = {}
    for encoding, size, at, n in bins.collect():  # at most 12 encodings x 62 sizes x BINS rows
        classes.setdefault(f"{encoding} {size}", [0] * BINS)[at] = n
    found = {}
    for name, counts in classes.items():
        total = sum(counts)
        random = min(total, 2 * sum(counts[BINS // 2 :]))
        for at in range(BINS):
            reported = sum(counts[at:])
            if reported and 1 - min(reported, random * (1 - at / BINS)) / reported <= fdr:
                found[name] = at / BINS
                break
    return found


def with_spans(rows: DataFrame, text: str, base: str, spans: str, least: dict[str, float]) -> DataFrame:
    """rows, their base spans, and all spans: base ones and reported tokens that overlap none of them."""
    rows = with_base(rows, text, base)
    if not least:
        return rows.withColumn(spans, F.col(base))
    cut = F.create_map(*(F.lit(x) for pair in sorted(least.items()) for x in pair))
    reported = lambda t: t["p"] >= F.coalesce(cut[F.concat_ws(" ", t["encoding"], t["size"].cast("string"))], F.lit(2.0))
    rows = with_tested(rows, text, spans).withColumn(spans, F.filter(spans, reported)).withColumn(spans, apart(F.col(spans), F.col(base)))
    return rows.withColumn(spans, F.array_sort(F.concat(F.col(base), of_kind("random", F.col(spans)))))


def apart(hits: Column, spans: Column) -> Column:
    """The hits that overlap none of spans (sorted by start); chunks of spans are passed over by their range."""

    def overlap(x, y):
        return (x["start"] < y["end"]) & (y["start"] < x["end"])

    def by_chunk(chunks):
        ranges = F.transform(chunks, lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda b: b["end"])).alias("end"), c.alias("of")))
        return let(ranges, lambda r: F.filter(hits, lambda h: ~F.exists(r, lambda x: overlap(x, h) & F.exists(x["of"], lambda b: overlap(b, h)))))

    return F.when(F.size(spans) == 0, hits).otherwise(let(chunked(spans), by_chunk))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """The rows of docs (doc_id, text) as doc_id, text, base and spans, one for one.

    base and spans are array<struct<start, order, end, kind>> in code points, sorted by
    start, then kind. Null and empty texts have none. Whole texts are scanned; n matches in
    one text take n ** 1.5 steps. Repeated rows get a row each; no rows: no rows. Other
    columns are not read.
    """
    rows = docs.select("doc_id", "text", text_column().alias("whole"))
    return with_spans(rows, "whole", "base", "spans", thresholds(rows, fdr)).drop("whole")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each of spans (sorted) replaced; overlapping spans are replaced together.

    Done by chunks of CHUNK characters, so no step copies the whole of a long text.
    """

    def of_chunk(chunk, first):
        def step(done, s):
            start = F.greatest(s["start"] - first, F.lit(0))
            before = F.substring(chunk, done["at"] + 1, start - done["at"])
            opens = F.when((s["start"] >= first) & (start >= done["at"]), F.lit(mark)).otherwise(F.lit(""))
            out = F.when(start >= done["at"], F.concat(done["out"], before, opens)).otherwise(done["out"])
            return F.struct(F.greatest(done["at"], s["end"] - first).alias("at"), out.alias("out"))

        here = F.filter(spans, lambda s: (s["start"] < first + CHUNK) & (s["end"] > first))
        whole = lambda some: F.aggregate(some, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda d: F.concat(d["out"], F.substring(chunk, d["at"] + 1, F.lit(CHUNK))))
        return let(here, lambda some: F.when(F.size(some) > 0, whole(some)).otherwise(chunk))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, F.array_join(F.transform(chunks, lambda c, k: of_chunk(c, k * CHUNK)), "")).otherwise(text)


def without_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """The rows of docs with all their columns, one for one, with the secrets in text replaced.

    Null and empty texts stay as they are. A column n_chars is counted anew, null for a null
    text. Texts of any length are scanned whole; a redacted one is put together by chunks.
    Ids may be null or repeat. No rows: no rows.
    """
    whole, base, spans = "quire_whole", "quire_base", "quire_spans"
    found = with_spans(docs.withColumn(whole, text_column()), whole, base, spans, thresholds(docs.select("text"), fdr))
    changed = found.withColumn("text", redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*docs.columns)
