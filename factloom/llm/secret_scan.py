"""Secret scans: named patterns, and a battery of randomness tests over long tokens. All in DataFrame functions.

Tokens are runs of at least `TOKEN` characters of the encodings' alphabets. A token's encoding is inferred (decimal,
hexadecimal, base32, letters, base62, base64), and on its characters' places in that alphabet run a chi-squared test of
uniformity, a runs test about the middle and a lag-one serial-correlation test; Fisher's sum joins their p-values. Within
each band of lengths the Benjamini-Hochberg step-up over all the corpus's tokens decides which of them the battery
rejects, so that of the tokens rejected as not random at most the share `RATE` is random, whatever their length and
number.

What is left must also be unlike text, as a battery has little power on short tokens: the log-likelihood ratio of uniform
against the letter frequencies of the corpus's other text, with a fixed prior for a corpus that has little of it, standardised by its mean and variance for the token's length, gives the
p-value of "this is a word", and the same step-up in each band holds the rate of false discoveries at `RATE`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = 20
_CHARS = "[A-Za-z0-9+/_-]"
#: A '=' ends a token unless it is trailing padding, which counts: what stands behind NAME= is a token of its own.
_PADDED = "|".join(rf"{_CHARS}{{{TOKEN - p}}}={{{p},}}+(?!{_CHARS})" for p in range(1, TOKEN - 3))
RANDOM = rf"(?<!{_CHARS})(?:{_CHARS}{{{TOKEN},}}+(?:=++(?!{_CHARS}))?|(?={_CHARS}{{4,{TOKEN - 1}}}+=)(?:{_PADDED}))"
RATE = 0.01
#: Upper ends of the bands of lengths.
BANDS = (23, 31, 47, 63, 127, 1 << 30)

# The encodings' alphabets, tried in this order.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)

LETTERS = ENCODINGS[5][1]
#: Letters that the prior counts for.
PRIOR_LETTERS = 1000
# Letters of prose in Latin script, of a thousand.
PRIOR = {
    "a": 82, "b": 15, "c": 28, "d": 43, "e": 127, "f": 22, "g": 20, "h": 61, "i": 70, "j": 2, "k": 8, "l": 40, "m": 24,
    "n": 67, "o": 75, "p": 19, "q": 1, "r": 60, "s": 63, "t": 91, "u": 28, "v": 10, "w": 24, "x": 2, "y": 20, "z": 1,
}


def tail(z: Column) -> Column:
    """P(Z > z) of the normal law, to 1e-7 relative in the bulk; falls to 0 far out."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = F.exp(-x * x / 2) * poly / math.sqrt(2 * math.pi)
    return F.when(z >= 0, near).otherwise(1 - near)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, kind, start, end, token): every match of the four patterns, in code points.

    kind is an index of KINDS. key is a hash of the row, which repeated rows share.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def one(kind: int, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.when(F.size(found) > 0, F.transform(F.split("text", pattern, -1), lambda g: F.length(g))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.lit(kind).alias("kind"), found.alias("found"), gaps.alias("gaps"))

    each = d.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.explode(F.array(*[one(i, p) for i, p in enumerate((ASSIGN, ACCESS, HEX, RANDOM))])).alias("m"))
    rows = each.filter("size(m.found) > 0").select(
        "doc_id", "key", "m.kind", F.posexplode(F.arrays_zip(F.col("m.found").alias("token"), F.col("m.gaps").alias("gap"))).alias("i", "x")
    )
    rows = rows.filter("x.token IS NOT NULL").select("doc_id", "key", "kind", "i", F.col("x.gap").cast("long").alias("gap"), F.col("x.token").alias("token")).distinct()
    before = Window.partitionBy("doc_id", "key", "kind").orderBy("i")
    n = F.length("token").cast("long")
    placed = rows.withColumn("end", F.sum(F.col("gap") + n).over(before))
    placed = placed.select("doc_id", "key", "kind", (F.col("end") - n).alias("start"), "end", "token")
    long_enough = (
        F.when(F.col("kind") == 0, F.length(F.regexp_extract("token", ASSIGN, 2)) >= 12).when(F.col("kind") == 1, F.length("token") >= 18).otherwise(F.lit(True))
    )
    return placed.filter(long_enough)


def battery(tokens: DataFrame) -> DataFrame:
    """(token, ...) -> with body, encoding, size, n, p_uniform, p_runs, p_serial, p_random."""
    body = F.regexp_replace("token", "=+$", "")
    enc, size, alphabet = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, letters in reversed(ENCODINGS):
        fits = F.length(F.translate(F.col("body"), letters, "")) == 0
        enc, size, alphabet = F.when(fits, name).otherwise(enc), F.when(fits, len(letters)).otherwise(size), F.when(fits, letters).otherwise(alphabet)
    t = tokens.withColumn("body", body).withColumns({"encoding": enc, "size": size, "alphabet": alphabet}).filter("encoding IS NOT NULL AND length(body) > 3")
    t = t.withColumn("n", F.length("body").cast("double")).withColumn("chars", F.split("body", ""))
    t = t.withColumn("x", F.expr("transform(chars, c -> cast(instr(alphabet, c) - 1 as double))"))
    squares = F.expr("aggregate(array_distinct(chars), 0D, (a, c) -> a + pow(length(body) - length(replace(body, c, '')), 2))")
    df = F.col("size") - 1
    chi = F.col("squares") * F.col("size") / F.col("n") - F.col("n")
    # Wilson and Hilferty's cube root.
    z = (F.cbrt(chi / df) - (1 - F.lit(2.0) / (df * 9))) / F.sqrt(F.lit(2.0) / (df * 9))
    t = t.withColumn("squares", squares).withColumn("p_uniform", tail(z))
    t = t.withColumns({
        "high": F.expr("transform(x, v -> v >= size / 2D)"),
        "mean": F.expr("aggregate(x, 0D, (a, v) -> a + v) / n"),
    })
    t = t.withColumns({
        "n1": F.expr("cast(size(filter(high, h -> h)) as double)"),
        "runs": F.expr("1D + aggregate(sequence(1, size(high) - 1), 0, (a, i) -> a + if(high[i] <> high[i - 1], 1, 0))"),
        "var": F.expr("aggregate(x, 0D, (a, v) -> a + (v - mean) * (v - mean))"),
        "cov": F.expr("aggregate(sequence(1, size(x) - 1), 0D, (a, i) -> a + (x[i] - mean) * (x[i - 1] - mean))"),
    })
    n, n1, n2 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    mu = 1 + 2 * n1 * n2 / n
    sd2 = (mu - 1) * (mu - 2) / (n - 1)
    both = lambda z: F.least(F.lit(1.0), 2 * tail(F.abs(z)))
    t = t.withColumn("p_runs", F.when((n1 == 0) | (n2 == 0) | (sd2 <= 0), F.lit(0.0)).otherwise(both((F.col("runs") - mu) / F.sqrt(F.greatest(sd2, F.lit(1e-9))))))
    t = t.withColumn("p_serial", F.when(F.col("var") <= 0, F.lit(0.0)).otherwise(both((F.col("cov") / F.greatest(F.col("var"), F.lit(1e-9)) + 1 / n) * F.sqrt(n))))
    h = -(F.log(F.greatest("p_uniform", F.lit(1e-300))) + F.log(F.greatest("p_runs", F.lit(1e-300))) + F.log(F.greatest("p_serial", F.lit(1e-300))))
    # Fisher: -2 sum ln p is chi-squared with 6 degrees; its tail is exp(-h) (1 + h + h^2 / 2).
    t = t.withColumn("h", h).withColumn("p_random", F.exp(-F.col("h")) * (1 + F.col("h") + F.col("h") * F.col("h") / 2))
    return t.drop("squares", "high", "mean", "n1", "runs", "var", "cov", "h", "x", "alphabet")


def letter_counts(texts: Column) -> list[Column]:
    """For each letter, in how many places of the texts it is: sums."""
    return [F.coalesce(F.sum(F.length(texts) - F.length(F.replace(texts, F.lit(c)))), F.lit(0)).alias(f"c{i}") for i, c in enumerate(LETTERS)]


def shares(seen: dict[str, int]) -> dict[str, float]:
    """How often each character of the tokens' alphabet stands in text, of these numbers of letters and the prior's."""
    every, weight = ENCODINGS[-1][1], PRIOR_LETTERS / sum(PRIOR.values())
    seen = {c: max(0, seen.get(c, 0)) + weight * PRIOR[c.lower()] * (0.05 if c.isupper() else 0.95) for c in LETTERS}
    total = sum(seen.values())
    return {c: 0.95 * seen.get(c, 0) / total + 0.05 / len(every) for c in every}


def letter_shares(docs: DataFrame, tokens: DataFrame) -> dict[str, float]:
    """`shares` of the letters of all texts that are not in tokens; two rows of sums reach the driver."""
    own = docs.select(*letter_counts(text_or_empty())).first()
    inside = tokens.select(*letter_counts(F.col("token"))).first()
    return shares({c: own[i] - inside[i] for i, c in enumerate(LETTERS)})


def word_p(tested: DataFrame, share: dict[str, float]) -> DataFrame:
    """Adds p_word: how likely text with these shares of characters is to look as unlike text as the token does, for its length."""
    logs = F.create_map(*[F.lit(v) for c in share for v in (c, -math.log(share[c]))])
    m1 = sum(p * -math.log(p) for p in share.values())
    m2 = sum(p * math.log(p) ** 2 for p in share.values())
    t = tested.withColumn("_logs", logs).withColumn("_l", F.expr("aggregate(chars, 0D, (a, c) -> a + coalesce(element_at(_logs, c), 0D))"))
    return t.withColumn("p_word", tail((F.col("_l") - F.col("n") * m1) / F.sqrt(F.col("n") * max(m2 - m1 * m1, 1e-9)))).drop("_logs", "_l")


def step_up(counts: list[tuple[int, int]], rate: float) -> int | None:
    """Benjamini-Hochberg on a grid: (bin, number), bins in tenths of -log10 p, each at its largest p-value; the least bin
    that is discovered, None if none is."""
    m, k, least = sum(n for _, n in counts), 0, None
    for at, n in sorted(counts, reverse=True):
        k += n
        if 10 ** (-at / 10) * m / k <= rate:
            least = at
    return least


def discoveries(tokens: DataFrame, rate: float = RATE, share: dict[str, float] | None = None) -> DataFrame:
    """(token) -> the tokens that are random and no words, at the false-discovery rate in each band of lengths."""
    tested = materialize(battery(tokens.select("token").distinct()), "battery")
    band = F.lit(len(BANDS) - 1)
    for i in reversed(range(len(BANDS))):
        band = F.when(F.col("n") <= BANDS[i], i).otherwise(band)
    binned = lambda p: F.least(F.lit(400), F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * 10)).cast("int")
    scored = word_p(tested, share or shares({})).withColumns({"band": band, "word": binned("p_word"), "uneven": binned("p_random")})
    tests = F.array(*[F.struct(F.lit(t).alias("test"), F.col(t).alias("bin")) for t in ("word", "uneven")])
    grid = scored.select("band", F.explode(tests).alias("t")).groupBy("band", "t.test", "t.bin").count().collect()  # 2 x 6 x 401 rows at most
    floor = {t: {b: step_up([(r["bin"], r["count"]) for r in grid if (r["band"], r["test"]) == (b, t)], rate) for b in {r["band"] for r in grid}} for t in ("word", "uneven")}
    never = 401
    least = lambda t: F.get(F.array(*[F.lit(x if (x := floor[t].get(b)) is not None else never) for b in range(len(BANDS))]), F.col("band"))
    return scored.filter((F.col("word") >= least("word")) & (F.col("uneven") < least("uneven"))).select("token")


def _without_overlaps(spans: DataFrame) -> DataFrame:
    """The spans without random ones that overlap one of the named patterns, by a sweep from either end of a text."""
    own = Window.partitionBy("doc_id", "key")
    named = lambda c: F.when(F.col("kind") < 3, F.col(c))
    before = own.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = own.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    swept = spans.withColumns({"_until": F.max(named("end")).over(before), "_from": F.min(named("start")).over(behind)})
    clear = (F.coalesce("_until", "start") <= F.col("start")) & (F.coalesce("_from", "end") >= F.col("end"))
    return swept.filter((F.col("kind") < 3) | clear).drop("_until", "_from")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; one row per row.

    Spans are kind:start:end by start, then kind, comma-joined, in code points. A random token that overlaps a span of
    the named patterns is not reported again. Null text counts as empty: no spans. Repeated rows and null doc_ids come
    back as they are. An empty table gives an empty table; other columns are ignored.
    """
    found = materialize(matches(docs), "matches")
    base = found.filter("kind < 3")
    tokens = found.filter("kind = 3")
    random = tokens.join(discoveries(tokens, rate, letter_shares(docs, tokens)), "token").select("doc_id", "key", "kind", "start", "end")
    spans = _without_overlaps(base.select("doc_id", "key", "kind", "start", "end").union(random))
    grouped = spans.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    grouped = grouped.select("doc_id", "key", F.col("s").alias("all"), F.filter("s", lambda x: x["kind"] < 3).alias("b"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    told = grouped.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), *[count(k) for k in range(4)], text("b").alias("_base"), text("all").alias("spans"))
    told = materialize(told, "secrets")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()).alias("key"))
    both = own.join(told, own["doc_id"].eqNullSafe(told["_id"]) & (own["key"] == told["_key"]), "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS]
    return both.select("doc_id", *counts, F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
