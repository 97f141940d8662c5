"""Document fingerprints: SimHash over weighted terms, and permuted block tables over the fingerprints.

Terms are the word shingles of a text (five words); a term's weight is the number of times it occurs. Each occurrence
votes with two 64-bit hashes; the sign of a bit's votes is the fingerprint's bit, 128 in all. The votes of four bits
share one long as 16-bit lanes, so the 128 counters of a group are 32 sums inside generated code. All of it is DataFrame
functions.

`near_links` finds all fingerprints within a Hamming radius: the 128 bits are dealt into blocks, and for each choice of
``blocks - radius`` of them a table keyed by those blocks brings together all pairs that agree there; as a pair within
the radius leaves at least so many blocks whole, none is missed. A pair counts only in the first table where it agrees.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import text_or_empty

#: Seeds of the two halves.
SEEDS = (17, 29)
#: A group's terms, so that its 16-bit lanes can't overflow.
LANE_TERMS = 32767
#: Groups of neighbouring doc_ids for the next-document window, a power of two: as many as hold about `GROUP_ROWS` rows.
GROUP_ROWS, GROUPS = 4096, (1024, 65536)
#: Equal rows that stand as one row at most.
COPIES = 4096
WIDTH = 5


def simhash(texts: DataFrame, keys: list[str], text: str, width: int = WIDTH) -> DataFrame:
    """(keys, text) -> (keys, fp0, fp1), a row for each distinct key; without words the zero. Keys must tell texts apart."""
    split = texts.select(*keys, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"))
    filled = F.when(F.size("_w") > 0, F.concat("_w", F.expr(f"array_repeat('', {width} - size(_w))"))).otherwise(F.array().cast("array<string>"))
    hashed = split.select(*keys, F.transform(filled, lambda w: F.xxhash64(w)).alias("_h"))
    slices = [F.expr(f"slice(_h, {i + 1}, greatest(size(_h) - {width - 1}, 0))").alias(f"t{i}") for i in range(width)]
    rows = hashed.select(*keys, F.posexplode_outer(F.arrays_zip(*slices)).alias("_at", "_t"))
    fields = [F.col(f"_t.t{i}") for i in range(width)]
    votes = rows.select(*keys, F.expr(f"_at div {LANE_TERMS}").alias("_part"), *[F.when(F.col("_at").isNotNull(), F.xxhash64(F.lit(s), *fields)).alias(f"_h{i}") for i, s in enumerate(SEEDS)])
    lane = F.lit(0x0001000100010001)
    part = votes.groupBy(*keys, "_part").agg(
        F.count("_h0").alias("_n"), *[F.sum(F.shiftrightunsigned(F.col(f"_h{i}"), b).bitwiseAND(lane)).alias(f"_l{i}_{b}") for i in range(2) for b in range(16)]
    )
    # Wider lanes for the sums over parts: lanes 0 and 2, then 1 and 3.
    wide = F.lit(0x0000FFFF0000FFFF)
    half = lambda i, b, odd: F.shiftrightunsigned(F.col(f"_l{i}_{b}"), 16 * odd).bitwiseAND(wide)
    whole = part.groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(half(i, b, o)).alias(f"_s{i}_{b}_{o}") for i in range(2) for b in range(16) for o in (0, 1)])

    def bit(i: int, at: int) -> Column:
        lane_no, b = divmod(at, 16)
        v = F.shiftrightunsigned(F.col(f"_s{i}_{b}_{lane_no % 2}"), 32 * (lane_no // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(F.coalesce(v * 2 > F.col("_n"), F.lit(False)).cast("long"), at)

    word = lambda i: reduce(Column.bitwiseOR, [bit(i, at) for at in range(64)])
    return whole.select(*keys, word(0).alias("fp0"), word(1).alias("fp1"))


def hex128(a: str, b: str) -> Column:
    part = lambda c: F.lpad(F.lower(F.hex(F.coalesce(F.col(c), F.lit(0).cast("long")))), 16, "0")
    return F.concat(part(a), part(b))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(d: Column) -> Column:
    """The cosine that a distance of 128-bit fingerprints stands for; 0 for a right angle or more."""
    return F.greatest(F.lit(0.0), F.when(d == 0, F.lit(1.0)).otherwise(F.cos(d * F.lit(3.141592653589793 / 128))))


def _longs(xs: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(" ".join(map(str, xs))), " ").cast("array<bigint>") if xs else F.array().cast("array<bigint>")


def _bucket(h: Column, bits: Column) -> Column:
    """The place of a hash among 2^bits equal ranges, in the order of the hashes; 0 for no bits."""
    return F.when(bits > 0, F.call_function("shiftright", h, 64 - bits) + F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1)).otherwise(0)


def _bits(n: float) -> int:
    """Bits for n ranges at least."""
    return max(0, math.ceil(n) - 1).bit_length()


def with_next(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (grp, rn, tail, doc_id, text, next_text, copies): each row with the next one's text.

    The order is descending doc_id, nulls last, then the text's hash, then text; after the last row comes the first. No global
    sort: doc_ids are dealt by quantiles into `groups` ranges; rows without doc_id, and those of a doc_id that fills several
    ranges, by their hash, and equal ones of them are counted first and stand as a row with the number of its `copies`. A range
    also gets the first row of the next as its tail, so that one window over the ranges sees every neighbour. Tail rows have
    tail = true. Runs three small jobs when called: only the quantiles and the first place of each range, numbers in
    proportion to `groups`, pass through the driver.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows, known = d.agg(F.count("*"), F.count("doc_id")).first()
    if groups is None:
        groups = GROUPS[0]
        while groups < GROUPS[1] and groups * GROUP_ROWS < rows:
            groups *= 2
    if not rows:
        return d.select(F.lit(0).alias("grp"), F.lit(0).alias("rn"), F.lit(False).alias("tail"), "doc_id", "text", F.col("text").alias("next_text"), F.lit(1).alias("copies"))
    probs = [i / groups for i in range(1, groups)]
    found = d.agg(F.percentile_approx("doc_id", probs, 20 * groups)).first()[0] or []
    times = Counter(map(int, found))
    bounds = sorted(times)
    # Ranges go down, as the order does: that above the last bound is the first. Of each, the rows of its least doc_id come
    # last, and are dealt by bits of the hash if that doc_id is hot; nulls are the last range.
    bits = [0] + [_bits(times[b]) if times[b] > 1 else 0 for b in bounds] + [_bits(groups * (rows - known) / rows)]
    start, at = [0] * len(bits), 0
    for i in [*range(len(bounds), -1, -1), len(bits) - 1]:
        start[i], at = at, at + 1 + (1 << bits[i])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = _longs(bounds + [(1 << 63) - 1] * (2 * steps[0] - len(bounds) if steps else 0))
    # Binary search: how many bounds are at most the doc_id.
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(F.get(table, a + s - 1) <= F.col("doc_id"), a + s).otherwise(a)) if steps else F.lit(0)
    below = F.least(below, F.lit(len(bounds)))  # the greatest long is at the filling, too
    dealt_by_hash = any(bits) or known < rows
    at = d.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(bits) - 1).otherwise(below).alias("r"))
    if dealt_by_hash:
        at = at.withColumn("b", F.get(_longs(bits), F.col("r")).cast("int"))
        at = at.withColumn("split", F.col("doc_id").isNull() | F.coalesce((F.col("b") > 0) & (F.get(table, F.col("r") - 1) == F.col("doc_id")), F.lit(False)))
    else:
        at = at.withColumns({"b": F.lit(0), "split": F.lit(False)})
    h = F.xxhash64("text")
    place = F.get(_longs(start), F.col("r")) + F.when(F.col("split"), 1 + _bucket(h, F.col("b"))).otherwise(0)
    grouped = at.select("doc_id", "text", "split", place.cast("int").alias("grp"))
    # What tells a range's first row: its doc_id (negated without overflow), or its hash where the rows are dealt by it.
    first = F.when(F.col("split"), F.when(F.lit(dealt_by_hash), h)).otherwise(F.bitwise_not("doc_id")) if dealt_by_hash else F.bitwise_not("doc_id")
    heads = {r["grp"]: r["head"] for r in grouped.groupBy("grp").agg(F.min(first).alias("head")).collect()}
    order = sorted(heads)
    size = order[-1] + 1
    before = {g: order[i - 1] for i, g in enumerate(order)}
    goes = F.get(_longs([before.get(g, 0) for g in range(size)]), F.col("grp")).cast("int")
    is_head = first == F.get(_longs([heads.get(g, 0) for g in range(size)]), F.col("grp"))
    tails = grouped.filter(is_head).groupBy(goes.alias("grp")).agg(F.min(F.struct("doc_id", h.alias("h"), "text")).alias("x"))
    tails = tails.select("grp", F.lit(True).alias("tail"), "x.doc_id", "x.text", F.lit(0).alias("part"), F.lit(1).alias("copies"))
    own = ["grp", F.lit(False).alias("tail"), "doc_id", "text"]
    dealt = grouped.filter(~F.col("split")).select(*own, F.lit(0).alias("part"), F.lit(1).alias("copies"))
    if dealt_by_hash:
        counted = grouped.filter("split").groupBy("grp", "doc_id", "text").agg((F.count("*") - 1).alias("more"))
        # All copies but one, in rows of at most `COPIES`, come before that one, whose next row is another text.
        many = F.transform(F.sequence(F.lit(0), F.expr(f"cast((more + {COPIES - 1}) div {COPIES} AS INT)")), lambda i: F.struct(i.alias("part"), F.least(F.lit(COPIES), F.col("more") - i.cast("long") * COPIES).cast("int").alias("copies")))
        one = F.array(F.struct(F.lit(1 << 30).alias("part"), F.lit(1).alias("copies")))
        parts = F.concat(F.filter(many, lambda x: x["copies"] > 0), one)
        dealt = dealt.union(counted.select(*own, F.explode(parts).alias("p")).select("grp", "tail", "doc_id", "text", "p.part", "p.copies"))
    dealt = dealt.union(tails)
    w = Window.partitionBy("grp").orderBy("tail", F.desc_nulls_last("doc_id"), h, "text", "part")
    return dealt.select("grp", F.row_number().over(w).alias("rn"), "tail", "doc_id", "text", F.lead("text").over(w).alias("next_text"), "copies")


def document_fingerprints(docs: DataFrame, width: int = WIDTH, groups: int | None = None) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's. Likenesses are the cosines that the fingerprints' distances stand for. Null text counts as
    empty; a text without words has fingerprint zero. One row per row, repeated rows and null doc_ids (last in the
    order, as `with_next` has it) included; a single row is its own next one. An empty table gives an empty table. Other columns are ignored.
    """
    rows = with_next(docs, groups).select(
        "grp", "rn", "tail", "copies", "doc_id", F.length("text").cast("long").alias("n_chars"), "text",
        F.expr("concat(left(text, length(text) - cast(length(text) div 2 as int)), left(next_text, cast(length(text) div 2 as int)))").alias("edited"),
    )
    both = rows.select(
        "grp", "rn", "tail", "copies", "doc_id", "n_chars", F.when(~F.col("tail"), F.sha2("edited", 256)).alias("edited_sha256"),
        F.explode(F.when(F.col("tail"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(
            F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))).alias("x"),
    )
    keys = ["grp", "rn", "tail", "copies", "doc_id", "n_chars", "edited_sha256", "kind"]
    flat = both.select(*keys[:-1], "x.kind", F.col("x.t").alias("t"))
    fps = simhash(flat, keys, "t", width)
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}")
    one = fps.groupBy(*keys[:-1]).agg(side(0, "fp0"), side(0, "fp1"), side(1, "fp0"), side(1, "fp1"))
    w = Window.partitionBy("grp").orderBy("rn")
    seen = one.withColumns({"n0": F.lead("fp0_0").over(w), "n1": F.lead("fp1_0").over(w)}).filter(~F.col("tail"))
    repeated = F.when(F.col("copies") > 1, F.array_repeat(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(1)))
    return seen.withColumn("_", F.explode(repeated)).select(
        "doc_id", "n_chars", "edited_sha256", hex128("fp0_0", "fp1_0").alias("fingerprint"), hex128("fp0_1", "fp1_1").alias("edited_fingerprint"),
        likeness(distance(*[F.col(c) for c in ("fp0_0", "fp1_0", "fp0_1", "fp1_1")])).alias("near_edited"),
        likeness(distance(*[F.col(c) for c in ("fp0_0", "fp1_0", "n0", "n1")])).alias("near_next"),
        F.col("fp0_0").alias("fp0"), F.col("fp1_0").alias("fp1"),
    )


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """Masks of each block in the two halves."""
    if blocks % 2 or 64 % (blocks // 2):
        raise ValueError("blocks must be even and divide 128")
    size = 128 // blocks
    mask = lambda b: (((1 << size) - 1) << (b * size)) & ((1 << 64) - 1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(mask(b)), 0) for b in range(blocks // 2)] + [(0, signed(mask(b))) for b in range(blocks // 2)]


def near_links(fps: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """(fp0, fp1) -> pairs (a0, a1, b0, b1), a < b, of different fingerprints at Hamming distance 1..radius, each once."""
    masks = _blocks(blocks)
    own = fps.select("fp0", "fp1").distinct()
    same = lambda b, x0, x1: (x0.bitwiseAND(F.lit(masks[b][0])) == 0) & (x1.bitwiseAND(F.lit(masks[b][1])) == 0)
    tables = list(combinations(range(blocks), blocks - radius))

    def key(t: tuple[int, ...]) -> Column:
        m0 = reduce(int.__or__, [masks[b][0] for b in t])
        m1 = reduce(int.__or__, [masks[b][1] for b in t])
        return F.struct(F.lit(tables.index(t)).alias("t"), F.col("fp0").bitwiseAND(F.lit(m0)).alias("k0"), F.col("fp1").bitwiseAND(F.lit(m1)).alias("k1"))

    rows = own.select("fp0", "fp1", F.explode(F.array(*map(key, tables))).alias("k")).select("fp0", "fp1", "k.t", "k.k0", "k.k1")
    a, b = rows.select("t", "k0", "k1", F.col("fp0").alias("a0"), F.col("fp1").alias("a1")), rows.select("t", "k0", "k1", F.col("fp0").alias("b0"), F.col("fp1").alias("b1"))
    x0, x1 = F.col("a0").bitwiseXOR(F.col("b0")), F.col("a1").bitwiseXOR(F.col("b1"))
    near = ((F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))) & (F.bit_count(x0) + F.bit_count(x1) <= radius)
    # Its first table: that of the first agreeing blocks.
    agree = F.filter(F.array(*[F.when(same(i, x0, x1), F.lit(i)) for i in range(blocks)]), lambda i: i.isNotNull())
    first = F.slice(agree, 1, blocks - radius)
    table_of = F.array_position(F.array(*[F.array(*map(F.lit, t)) for t in tables]), first) - 1
    # Spark sizes the exploded rows as if there were one a fingerprint, and would broadcast what is `len(tables)` times as large.
    met = a.join(b.hint("merge"), (a["t"] == b["t"]) & (a["k0"] == b["k0"]) & (a["k1"] == b["k1"]) & near)
    return met.filter(table_of == a["t"]).select("a0", "a1", "b0", "b1")


def fingerprints_with_links(docs: DataFrame, radius: int = 6, blocks: int = 8, width: int = WIDTH, groups: int | None = None) -> DataFrame:
    """`document_fingerprints` with class_id, the smallest doc_id of equal fingerprint, and n_links, how many other
    fingerprints lie within the radius."""
    own = materialize(document_fingerprints(docs, width, groups), "fingerprints")
    pairs = near_links(own, radius, blocks)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a0").alias("fp0"), F.col("a1").alias("fp1")), F.struct(F.col("b0").alias("fp0"), F.col("b1").alias("fp1")))).alias("e"))
    links = ends.select("e.fp0", "e.fp1").groupBy("fp0", "fp1").agg(F.count("*").alias("n_links"))
    classes = own.groupBy("fp0", "fp1").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(classes.join(links, ["fp0", "fp1"], "left").select("fp0", "fp1", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    return own.join(classes, ["fp0", "fp1"]).drop("fp0", "fp1")
