"""Fuzzy line deduplication by MinHash, all in DataFrame functions.

A line's features are all its shingles of twelve characters; a shorter line is one shingle. Equal lines are one line with
many places. Each line's MinHash signature is taken inside
one aggregation (position j keeps the least of ``hash xor c_j``); bands of it are hashed to keys, and lines that share a
key are candidates, verified by the exact Jaccard similarity of their sets. Large buckets are compared with a few of
their lines first, so a bucket of m alike lines costs a few m pairs; of the pairs left, parity sketches, whose differing
bits never exceed the sets' differing members, rule out nearly all that are unlike and none that is alike. Components of
the links are found by distributed union-find, and of each component's places only the first, by doc_id and line number, is kept.

Lines are named by the XXH64 of their text. Texts travel once, for the candidate lines that verification needs, which a
bitmap of fixed size picks out before the exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.runtime import materialize as _written
from .common import text_or_empty

SIMILARITY = 0.8
#: Nine minima stand in a square of three by three; a band is one of the twelve lines through three of them that the
#: affine plane over the numbers modulo 3 has: rows, columns and both ways of diagonals. Two lines share one minimum at
#: most, and any five minima hold a whole line, so that nine minima do what twenty-one did in seven bands of their own:
#: a pair of similarity 0.8 shares a band with probability 0.990, one of 0.85 with 0.997.
MINIMA = 9
BANDS = tuple(
    [tuple(3 * r + c for c in range(3)) for r in range(3)] + [tuple(3 * r + (k + m * r) % 3 for r in range(3)) for m in range(3) for k in range(3)]
)
#: Characters of a shingle; shingles that a row of the signatures' aggregation carries.
SHINGLE, STEP = 12, 8
#: A line of nothing else is blank.
BLANK = " \t\n\x0b\f\r"
#: The bitmap of lines that take part in verification: so many parts of 32,768 bits (4 KB).
BITMAP_PARTS = 256
_BITS = 32768
#: Buckets that compare all their pairs, and lines unlike the leader of a larger one that its lines meet.
SMALL, PROBES = 8, 12
#: Lines of a large bucket, about, that one part of a comparison holds.
PART = 512
#: Words of 64 bits in the sketch that rules pairs out: eight let most pairs of 700 shingles or more pass. A power of two.
SKETCH = 16
#: Slack of comparisons of similarities.
_EPS = 1e-9


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """A written table; nearly all of its bytes are hashes."""
    return _written(df, tag, "uncompressed")


def characters(line: Column) -> Column:
    """The line in four bytes a code point, so that a shingle is found at its place without walking there."""
    return F.encode(line, "UTF-32")


def shingle_at(chars: Column, p: Column) -> Column:
    """The hash of the shingle that starts at the p-th, from 1, of such bytes."""
    return F.xxhash64(F.substring(chars, p, F.lit(4 * SHINGLE)))


def shingle(chars: Column, i: Column) -> Column:
    """The hash of the i-th shingle, from 0, of such bytes."""
    return shingle_at(chars, i * 4 + 1)


def last_start(chars: Column) -> Column:
    """Where the last shingle starts, from 0; a line of fewer characters than a shingle is one."""
    return F.greatest(F.lit(0), F.shiftright(F.length(chars), 2) - SHINGLE)


def shingles(line: Column) -> Column:
    """The hashes of all the line's shingles, repeats included."""
    # The outer array binds the bytes to a name: a plain expression would be evaluated anew for each shingle.
    # Its steps are bytes, as functions of arrays are interpreted and each operation in them is paid for.
    of = lambda e: F.transform(F.sequence(F.lit(1), last_start(e) * 4 + 1, F.lit(4)), lambda p: shingle_at(e, p))
    return F.get(F.transform(F.array(characters(line)), of), F.lit(0))


def _constant(j: int) -> int:
    """The j-th signature's constant: five bits of its own, so that the constants are spread out, then random ones."""
    x = (j * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    x ^= x >> 32
    x = (j * 13 % 32) << 59 | x >> 5
    return x - (1 << 64) if x >> 63 else x


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, line_no, line), without blank lines and rows that have no doc_id."""
    lines = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    return lines.filter(F.ltrim(F.col("line"), F.lit(BLANK)) != "")


def signatures(docs: DataFrame) -> DataFrame:
    """(key, bands, n, first) of the distinct lines: band keys, number of places and least doc_id.

    Equal lines meet in the aggregation itself, by their key; the text stays home. A row carries the hashes of `STEP`
    neighbouring shingles (the last one again where they end), so that the aggregation is asked less often. Here a shingle
    is twelve units of two bytes, half as long to hash: a character, or half of one beyond the first 65,536. All of them
    count, and the similarity that decides stays that of characters.
    """
    cut = places(docs).select(F.xxhash64("line").alias("key"), "doc_id", F.encode("line", "UTF-16BE").alias("_e"))
    cut = cut.withColumn("_last", F.greatest(F.lit(0), F.shiftright(F.length("_e"), 1) - SHINGLE))
    each = cut.select("key", "doc_id", "_e", "_last", F.explode(F.sequence(F.lit(0), F.col("_last"), F.lit(STEP))).alias("_i"))
    names = [f"_h{k}" for k in range(STEP)]
    at = [F.least(F.col("_i") + k, F.col("_last")) * 2 + 1 for k in range(STEP)]
    hashed = each.select("key", "doc_id", "_i", *[F.xxhash64(F.substring("_e", p, F.lit(2 * SHINGLE))).alias(h) for p, h in zip(at, names)])
    mins = [F.min(F.least(*[F.col(h).bitwiseXOR(F.lit(_constant(j))) for h in names])).alias(f"_m{j}") for j in range(MINIMA)]
    mins = hashed.groupBy("key").agg(F.sum(F.when(F.col("_i") == 0, 1).otherwise(0)).alias("n"), F.min("doc_id").alias("first"), *mins)
    keys = [F.xxhash64(F.lit(b), *[F.col(f"_m{j}") for j in line]) for b, line in enumerate(BANDS)]
    return mins.select("key", F.array(*keys).alias("bands"), "n", "first")


def through_bitmap(rows: DataFrame, col: str, need: DataFrame) -> DataFrame:
    """The rows whose long `col` is one of `need`'s, and few others: a bitmap of fixed size keeps the rest from an exchange."""
    at = F.pmod(F.xxhash64(col, F.lit(7)), F.lit(BITMAP_PARTS * _BITS))
    bitmap = need.select(at.alias("_at")).groupBy((F.col("_at") / _BITS).cast("int").alias("_part")).agg(F.bitmap_construct_agg(F.col("_at") % _BITS).alias("_bits"))
    # Bytes become numbers once in the bitmap, not once a row.
    number = lambda i: F.conv(F.hex(F.substring("_bits", i, F.lit(1))), 16, 10).cast("smallint")
    bitmap = bitmap.select("_part", F.transform(F.sequence(F.lit(1), F.lit(_BITS // 8)), number).alias("_bytes"))
    placed = rows.withColumn("_at", at).withColumn("_bit", F.col("_at").bitwiseAND(F.lit(_BITS - 1)).cast("int"))
    picked = placed.join(F.broadcast(bitmap), (F.col("_at") / _BITS).cast("int") == F.col("_part"))
    return picked.filter(F.getbit(F.get("_bytes", F.shiftright("_bit", 3)), F.col("_bit").bitwiseAND(F.lit(7))) == 1).select(*rows.columns)


def needed(lines: DataFrame, need: DataFrame) -> DataFrame:
    """lines(key, line) -> the distinct ones that `need`(key) names."""
    return through_bitmap(lines, "key", need).dropDuplicates(["key"]).join(need, "key", "left_semi")


def line_texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(key) -> (key, s): the texts of the needed lines; their sets, eight times as large, are made where they are compared."""
    return needed(places(docs).select(F.xxhash64("line").alias("key"), "line"), need).select("key", F.col("line").alias("s"))


def _verified(pairs: DataFrame, sets: DataFrame, of: Callable[[Column], Column], similarity: float) -> DataFrame:
    """pairs(a, b, ...) -> those whose sets have the exact Jaccard similarity, for sets(key, s, n) with their sizes n.

    `of` makes the members of an s, repeats included, as an intersection holds each once.
    """
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa"), F.col("n").alias("_na")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb"), F.col("n").alias("_nb")), "b")
    sized = both.select(*pairs.columns, "_na", "_nb", F.size(F.array_intersect(of(F.col("sa")), of(F.col("sb")))).alias("_n"))
    return sized.filter(F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n")) >= similarity - _EPS).select(*pairs.columns)


def odd_sketches(sets: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """(key, s) -> (key, n, o0, o1, ...): a set's size and, in `SKETCH` words of 64 bits, the parity of its members at each bit.

    Two sketches differ in at most as many bits as the sets have members that only one of them has. An empty set has no
    sketch. A row carries `STEP` members, so that the aggregation is asked less often.
    """
    sized = sets.select("key", F.array_distinct(of(F.col("s"))).alias("_a")).select("key", "_a", F.size("_a").alias("_n"))
    each = sized.select("key", "_a", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(STEP))).alias("_i"))
    names = [f"_h{k}" for k in range(STEP)]
    hashed = each.select("key", "_n", *[F.when(F.col("_i") + k < F.col("_n"), F.xxhash64(F.get("_a", F.col("_i") + k))).alias(h) for k, h in enumerate(names)])

    def word(i: int) -> Column:
        """The bits that a row's members set in the i-th word."""
        here = [F.col(h).bitwiseAND(F.lit(SKETCH - 1 << 6)) == i << 6 for h in names]
        bits = [F.when(at, F.expr(f"shiftleft(1L, cast({h} & 63 AS int))")).otherwise(F.lit(0).cast("long")) for at, h in zip(here, names)]
        return reduce(Column.bitwiseXOR, bits)

    return hashed.groupBy("key").agg(F.max("_n").alias("n"), *[F.bit_xor(word(i)).alias(f"o{i}") for i in range(SKETCH)]).filter("n > 0")


def _named(d: DataFrame, p: str) -> DataFrame:
    return d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns])


def _apart() -> Column:
    """In how many bits the sketches of a row's lines f and x differ."""
    bits = [F.bit_count(F.col(f"f_o{i}").bitwiseXOR(F.col(f"x_o{i}"))) for i in range(SKETCH)]
    return sum(bits[1:], bits[0])


def _near(similarity: float) -> Column:
    """Whether the sketches of a row's lines f and x allow the similarity."""
    return _apart() <= (F.col("f_n") + F.col("x_n")) * ((1 - similarity) / (1 + similarity)) + _EPS


def _ends(f: str = "key") -> list[Column]:
    return [F.least(f"f_{f}", f"x_{f}"), F.greatest(f"f_{f}", f"x_{f}")]


def _not_ruled_out(f: DataFrame, x: DataFrame, similarity: float, apart: bool = False, probing: bool = False) -> DataFrame:
    """Pairs (a, b) of a line of `f` and one of `x` in a bucket whose sketches allow the similarity.

    With `apart`, of lines of different components only, once for all buckets that they share, by their `bands`, with the
    components (ca, cb) and the sketches' differing bits d. With
    `probing`, of the lines of `x` that are not `apart` just the closest for each line of `f` in each bucket. A bucket's
    rows of `x` are dealt into parts of about `PART` lines, and its rows of `f` go to each part.
    """
    parts = F.expr(f"cast(size div {PART} as int)")
    left = _named(f.withColumn("part", F.explode(F.sequence(F.lit(0), parts))), "f")
    right = _named(x.withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), parts + 1).cast("int")), "x")
    other = F.col("f_c") != F.col("x_c") if apart else F.col("f_key") != F.col("x_key")
    met = (F.col("f_band") == F.col("x_band")) & (F.col("f_part") == F.col("x_part")) & other & _near(similarity)
    if apart:
        met = met & (F.get(F.array_intersect("f_bands", "x_bands"), F.lit(0)) == F.col("f_band"))
    both = left.join(right, met)
    ends = [c.alias(n) for c, n in zip(_ends(), "ab")]
    if probing:
        near = both.filter("NOT x_apart").groupBy("f_band", "f_key").agg(F.min_by("x_key", F.struct(_apart(), F.col("x_key"))).alias("x_key"))
        return both.filter("x_apart").select(*ends).union(near.select(*ends)).distinct()
    if apart:
        return both.select(*ends, *[c.alias(n) for c, n in zip(_ends("c"), ("ca", "cb"))], _apart().alias("d")).distinct()
    return both.select(*ends).distinct()


def buckets(sigs: DataFrame) -> DataFrame:
    """(key, bands) -> (band, key, size, lead) of the bands of two lines or more: their number and least key, a hash itself.

    Sizes are counted in an aggregation with partial sums, so that no bucket lands in one task whole.
    """
    banded = sigs.select("key", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("lead")).filter("size > 1")
    sizes = materialize(sizes, "sizes")
    return through_bitmap(banded, "band", sizes).join(sizes, "band").select("band", "key", "size", "lead")


def line_components(docs: DataFrame, sigs: DataFrame, similarity: float = SIMILARITY, sets_of=line_texts, of: Callable[[Column], Column] = shingles) -> DataFrame:
    """(node, component): the components of all candidate pairs of line keys that are alike; lines without a link are left out.

    Buckets of at most `SMALL` lines compare all their pairs. A larger bucket compares its lines with one of them, its
    leader. Where any are unlike it, `PROBES` of these meet the others and the closest of the rest, and in the end each
    line outside the leader's component meets the bucket's lines of other components. Of all these pairs, those that
    parity sketches allow are verified, between two components the closest first. No pair that a component needs is lost. `sets_of` gives an s of the lines,
    or texts, that keys name, and `of` makes its members of it, repeats allowed.
    """
    shared = materialize(buckets(sigs), "buckets")
    sets = _written(sets_of(docs, shared.select("key").distinct()), "sets")
    sketches = materialize(odd_sketches(sets, of), "sketches")
    sets = _written(sets.join(sketches.select("key", "n"), "key"), "sets")
    # Pairs of small buckets are named once before they meet their sketches, which are wide.
    few = shared.filter(f"size <= {SMALL}").select("band", "key")
    met = _named(few, "f").join(_named(few, "x"), (F.col("f_band") == F.col("x_band")) & (F.col("f_key") < F.col("x_key"))).select("f_key", "x_key").distinct()
    met = met.join(_named(sketches, "f"), "f_key").join(_named(sketches, "x"), "x_key").filter(_near(similarity))
    many = materialize(shared.filter(f"size > {SMALL}").join(sketches, "key"), "sketched")
    led = materialize(_not_ruled_out(many.filter("key = lead"), many, similarity), "led")
    tested = materialize(_verified(met.select(F.col("f_key").alias("a"), F.col("x_key").alias("b")).union(led).distinct(), sets, of, similarity), "verified")
    # The leader has the least key of its bucket, so its pairs are (lead, key).
    left = materialize(many.filter("key <> lead").join(tested, (F.col("lead") == F.col("a")) & (F.col("key") == F.col("b")), "left_anti").select("band", "key"), "unlike")
    links = lambda d: d.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if not left.limit(1).count():
        return connected_components(links(tested))

    undecided = materialize(many.join(left.select("band").distinct(), "band", "left_semi"), "undecided")
    some = left.groupBy("band").agg(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(r))) for r in range(PROBES)]).alias("_p"))
    probes = materialize(some.select("band", F.explode(F.array_distinct("_p")).alias("key")), "probes")
    # A probe meets the lines that are unlike the leader, and of those that are linked to it the one with the closest
    # sketch in each bucket: one link is enough to join them, and what it misses is found below.
    marked = undecided.join(left.withColumn("apart", F.lit(True)), ["band", "key"], "left")
    asked = _not_ruled_out(probes.join(undecided, ["band", "key"]), marked.withColumn("apart", F.coalesce("apart", F.lit(False))), similarity, probing=True)
    asked = materialize(asked.join(tested, ["a", "b"], "left_anti"), "probed")
    # Written, as the components read their links in both directions.
    asked = materialize(_verified(asked, sets, of, similarity), "verified")
    named = connected_components(links(tested).union(links(asked)))

    own = named.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    heads = undecided.filter("key = lead").join(own, F.col("lead") == F.col("_n"), "left").select("band", F.coalesce("_c", "lead").alias("_head"))
    labelled = undecided.join(own, F.col("key") == F.col("_n"), "left").withColumn("c", F.coalesce("_c", "key")).drop("_n", "_c", "lead")
    labelled = labelled.join(sigs.select("key", "bands"), "key")  # so that a pair is met once, in its first bucket
    labelled = materialize(labelled.join(heads, "band"), "labelled")
    more = materialize(_not_ruled_out(labelled.filter("c <> _head").drop("_head"), labelled.drop("_head"), similarity, apart=True), "rest")
    # Of the pairs between two components the closest comes first; the others matter only if it is no link.
    closest = more.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b", "ca", "cb")
    found = materialize(_verified(closest, sets, of, similarity).select("ca", "cb"), "joined")
    others = materialize(more.join(found, ["ca", "cb"], "left_anti").join(closest, ["a", "b"], "left_anti").select("a", "b", "ca", "cb"), "others")
    if others.limit(1).count():
        found = found.union(materialize(_verified(others, sets, of, similarity).select("ca", "cb").distinct(), "joined"))
    found = found.select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    if not found.limit(1).count():
        return named
    # A component is named by its least line: components join, and so do lines that had no link.
    wider = connected_components(found)
    up = wider.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    again = named.join(up, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    return again.union(wider.join(named, "node", "left_anti").select("node", "component"))


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, dropped): the numbers, from 0, of the lines to drop, for each doc_id that loses any."""
    sigs = materialize(signatures(docs), "signatures")
    named = line_components(docs, sigs, similarity)
    # Lines of one place without a link are their class's only place.
    often = sigs.select("key", "n", "first").join(named.select(F.col("node").alias("key"), "component"), "key", "left").filter("n > 1 OR component IS NOT NULL")
    often = materialize(often.select("key", F.coalesce("component", "key").alias("class"), "n", "first"), "often")
    many = often.groupBy("class").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1").select("class", "first")
    repeated = materialize(often.select("key", "class").join(many, "class"), "repeated")
    own = places(docs).select("doc_id", "line_no", F.xxhash64("line").alias("key"))
    again = materialize(own.join(repeated, "key").select("class", "doc_id", "line_no", "first"), "again")
    # Of the first document's places the first line stays.
    line = again.filter("doc_id = first").groupBy("class").agg(F.min("line_no").alias("first_line"))
    line = materialize(line, "kept")
    out = again.join(line, "class").filter("doc_id <> first OR line_no <> first_line")
    return out.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def line_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_lines, n_kept, dropped), one row per row.

    Lines are what newlines part. dropped: the numbers from 0 of the dropped lines, comma-joined. Blank lines take no
    part and stay. Null text counts as empty: one blank line. Rows of equal doc_id share their decisions; a row without
    doc_id takes no part and keeps its lines. An empty table gives an empty table; other columns are ignored.
    """
    dropped = materialize(dropped_lines(docs, similarity), "dropped")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines"))
    both = own.join(dropped, "doc_id", "left")
    lost = F.when(F.col("dropped").isNotNull(), F.size("dropped")).otherwise(0)
    return both.select("doc_id", "n_lines", (F.col("n_lines") - lost).alias("n_kept"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their dropped lines; documents that lose all their non-blank lines go. The columns of `docs`."""
    dropped = materialize(dropped_lines(docs, similarity), "dropped").select(F.col("doc_id").alias("_id"), F.col("dropped").alias("_dropped"))
    lines = F.split(text_or_empty(), "\n")
    both = docs.join(dropped, docs["doc_id"] == dropped["_id"], "left").withColumn("_lines", lines)
    keep = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped")), lambda i: F.get(F.col("_lines"), i))
    text = F.when(F.col("_id").isNull(), docs["text"]).otherwise(F.array_join(keep, "\n"))
    cut = both.withColumn("_text", text).filter(F.col("_id").isNull() | F.col("_text").rlike(r"\S"))
    return cut.select(*[F.col("_text").alias("text") if c == "text" else docs[c] for c in docs.columns])
