"""Exact similarity join of texts on their word shingles, by prefix filters under several orders of the shingles.

Two sets of Jaccard similarity t or more share a member among the first ``n - ceil(t n) + 1`` of each, whatever the order of
all members is, as long as it is one order for all sets (n: the set's own size). So each of several orders is a filter that
loses no pair, and candidates must pass them all:

* The first order puts rare shingles first: those with a hash below `SHARE` of the range, by the number of rows they are in,
  then the others by hash. Only shingles that could be in a prefix under it are counted and sent. A text whose prefix has
  no shingle of another row has no partner and is done.
* Shingles of a prefix name buckets; a bucket of few texts gives all its pairs, a large one the pairs with its leader,
  later those of texts that were not linked to the leader's class. Buckets of equal texts are one bucket.
* Candidates then must share a member of their prefixes under `ORDERS` more orders, multiplications of the hash, and
  what is left is verified on the whole sets. Between two classes one pair is verified first; the others only if it is no
  link. No pair that a class needs is left out.

Shingles are known by a 64-bit hash of their words. Equal texts are one text with many rows, and are cut once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.runtime import discard, materialize, scratch
from .common import batch, map_arrow, text_or_empty
from .line_dedup import needed

WIDTH, PERCENT = 5, 80
#: Share of the hashes' range whose shingles are counted for the first order.
SHARE = 0.3
_LIMIT = int(SHARE * 2**64)
#: Orders beside the first; each multiplies the hash by an odd number.
ORDERS = 2
_ODD = [xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(ORDERS)]
#: Texts of a bucket that gives all its pairs; rows that one part of a larger one's comparison holds, about.
SMALL, PART = 6, 512
#: Texts of a large bucket, and as many outside the leader's class, that those outside it meet before they meet all.
PROBES = 6
#: The bitmap of shared shingles: `BITMAP_SPACE` bits for each at least, in parts of 32,768 bits (4 KB): 4 MB at least, 64 MB at most.
BITMAP_PARTS, BITMAP_MOST, BITMAP_SPACE, _BITS = 1024, 16384, 8, 32768
#: Of a text's large buckets so many, the first by hash, tell which of two texts' common buckets is their first.
HEADS = 16
#: Words of 64 bits of a set's parity sketch.
SKETCH = 8
_SKETCH_MIX = np.uint64(xxhash.xxh64_intdigest("sketch") | 1)
_WORD_MIX = np.uint64(xxhash.xxh64_intdigest("word") | 1)
#: Eight bytes of which so many count; bytes of a word that is hashed with others, eight at a time.
_COUNT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


def _mix(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The hash `h` with 64 bits more; of equal hashes, another part gives another one."""
    h = (h ^ part) * _WORD_MIX
    return h ^ (h >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's bytes and their number."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.zeros(ends[-1] - ends[0] + 8, np.uint8)
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from each byte on
    start, size = ends[:-1] - ends[0], np.diff(ends)
    h = _mix(_mix(size.astype(np.uint64), _WORD_MIX), eight[start] & _COUNT[np.minimum(size, 8)])
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        h[at] = _mix(h[at], eight[start[at] + done] & _COUNT[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]])
    return h


def _mixed(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place of `first` on."""
    h = np.full(len(first), np.uint64(xxhash.xxh64_intdigest(f"width {width}")))
    for i in range(width):
        h = _mix(h, words[first + i])
    h *= _WORD_MIX
    h ^= h >> np.uint64(29)
    return h


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending; a text without words has none, one of fewer words is one shingle."""
    if not len(texts):
        return []
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    ends, flat = words.offsets.to_numpy(), words.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    hashes = _word_hashes(flat)[some]
    n = np.bincount(row[some], minlength=len(texts))
    at = np.cumsum(n) - n
    count = np.where(n < width, np.minimum(n, 1), n - width + 1)
    end = np.cumsum(count)
    start = end - count
    # A shingle's first word: its text's, and as many on as it is in its text.
    first = np.repeat(at - start, count) + np.arange(end[-1])
    of = np.repeat(n, count)
    out = np.zeros(len(first), np.uint64)
    for k in range(1, width + 1):
        here = of == k if k < width else of >= width
        out[here] = _mixed(hashes, first[here], k)
    sets = []
    for a, b in zip(start.tolist(), end.tolist()):
        s = np.sort(out[a:b])
        sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if b - a > 1 else s)
    return sets


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    return shingle_sets(pa.array([text or ""], pa.string()), width)[0]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the members at each bit: two sketches differ in at most as many bits as the sets in members."""
    at = (s * _SKETCH_MIX) >> np.uint64(64 - 9)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64)


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def first_members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, n, first): for each different text the shingles that may be in a prefix under the first order."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(b.column(1), width)
        firsts = [s[: max(int(np.searchsorted(s, np.uint64(_LIMIT))), prefix_length(len(s), percent)) if len(s) else 0].view(np.int64) for s in sets]
        return batch(["key", "n", "first"], b.column(0), pa.array(list(map(len, sets)), pa.int64()), _lists(firsts, np.int64))

    texts = docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text")).dropDuplicates(["key"])
    return map_arrow(texts, fn, "key long, n long, first array<long>")


def _bitmap_parts(shared: DataFrame) -> int:
    """Parts, a power of two, of a bitmap that holds `shared`; where it stays the same however many there are, most bits are set at last."""
    return min(BITMAP_MOST, max(BITMAP_PARTS, 1 << (shared.count() * BITMAP_SPACE // _BITS).bit_length()))


def _shared_only(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, n, m, h) of the first members h that `shared`(h) may have, by a bitmap; m: their number with the others."""
    most = _bitmap_parts(shared)
    last = most * _BITS - 1  # a hash's last bits are its place
    at = F.col("h").bitwiseAND(F.lit(last))
    parts = shared.select(at.alias("at")).groupBy((F.col("at") / _BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % _BITS).alias("bits"))
    bitmap = np.zeros(most * _BITS // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most BITMAP_MOST rows of 4 KB
        bitmap[r.part * _BITS // 8 : (r.part + 1) * _BITS // 8] = np.frombuffer(r.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(3)  # a batch is cut by bytes, so its places in the bitmap are few megabytes
        ends = lists.offsets.to_numpy()
        h = lists.flatten().to_numpy()
        p = h & last
        hit = np.flatnonzero(sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1)
        row = np.searchsorted(ends - ends[0], hit, side="right") - 1
        return batch(["key", "n", "m", "h"], *[pa.array(b.column(i).to_numpy()[row]) for i in range(3)], pa.array(h[hit]))

    return map_arrow(rows.select("key", "n", F.size("first").cast("long"), "first"), fn, "key long, n long, m long, h long")


def _sizes_fit(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """first_members -> (h, key, n): the prefixes under the first order, without shingles of one row only."""
    counts = rows.select(F.explode("first").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    counts = materialize(counts, "shared", "uncompressed")
    own = _shared_only(rows, counts).join(counts, "h")
    late = (F.col("h") < 0) | (F.col("h") >= _LIMIT)
    by = F.struct(late.alias("late"), "c", "h")
    each = own.groupBy("key", "n", "m").agg(F.sort_array(F.collect_list(by)).alias("r"))  # a text's own shingles
    alone = F.col("m") - F.size("r")  # these come first, and meet no one
    length = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    kept = F.slice("r", F.lit(1), F.greatest(F.lit(0), length - alone).cast("int"))
    return each.select("key", "n", F.explode(F.transform(kept, lambda x: x["h"])).alias("h"))


def buckets(prefix: DataFrame) -> DataFrame:
    """(h, key, n, size, lead): the texts that have h in their prefix; of buckets of the same texts one is kept."""
    marks = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in range(2)]
    whole = prefix.groupBy("h").agg(F.count("*").alias("size"), F.min("key").alias("lead"), *marks).filter("size > 1")
    whole = whole.groupBy("size", "lead", "x0", "x1").agg(F.min("h").alias("h")).select("h", "size", "lead")
    return prefix.join(materialize(whole, "bucket-sizes", "uncompressed"), "h")


def sets(docs: DataFrame, need: DataFrame, width: int, percent: int) -> DataFrame:
    """(key) -> (key, s, sketch, orders): the needed texts' sets, and their prefixes' hashes under the further orders, cut to 32 bits.

    Cut hashes may agree where whole ones do not, never the other way round.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = shingle_sets(b.column(1), width)
        orders = []
        for odd in _ODD:
            mixed = [s * np.uint64(odd) for s in got]
            cut = [np.sort(m)[: prefix_length(len(m), percent)] >> np.uint64(32) for m in mixed]
            orders.append(_lists([c.astype(np.uint32).view(np.int32) for c in cut], np.int32))
        names = ["key", "s", "sketch", *[f"o{i}" for i in range(ORDERS)]]
        return batch(names, b.column(0), _lists([s.view(np.int64) for s in got], np.int64), _lists([sketch(s) for s in got], np.int64), *orders)

    texts = docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("line"))
    return map_arrow(needed(texts, need), fn, "key long, s array<long>, sketch array<long>, " + ", ".join(f"o{i} array<int>" for i in range(ORDERS)))


def _with(pairs: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    for p in "ab":
        pairs = pairs.join(members.select(F.col("key").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in columns]), p)
    return pairs


def passing(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs that share a prefix member under each of the further orders."""
    names = [f"o{i}" for i in range(ORDERS)]
    both = _with(pairs, members, names)
    return both.filter(reduce(Column.__and__, [F.arrays_overlap(f"{c}_a", f"{c}_b") for c in names])).select(*pairs.columns)


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b, ...) -> those that pass the other orders and whose sets are as similar as asked."""
    both = _with(passing(pairs, members), members, ["s"])
    sized = both.select(*pairs.columns, F.size("s_a").alias("_a"), F.size("s_b").alias("_b"), F.size(F.array_intersect("s_a", "s_b")).alias("_n"))
    return sized.filter(100 * F.col("_n") >= percent * (F.col("_a") + F.col("_b") - F.col("_n"))).select(*pairs.columns)


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _between(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """pairs(a, b) of different classes, with them: (a, b, ca, cb), ca the smaller."""
    for p in "ab":
        pairs = pairs.join(named.select(F.col("node").alias(p), F.col("component").alias(f"c{p}")), p, "left").withColumn(f"c{p}", F.coalesce(f"c{p}", p))
    return pairs.filter("ca <> cb").select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))


def _link_rest(pairs: DataFrame, named: DataFrame, links: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links so far and their classes, once the pairs between classes are decided: one of each two classes first."""
    rest = materialize(_between(pairs, named), "rest", "uncompressed")
    if not rest.limit(1).count():
        return links, named
    one = rest.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p")).select("p.a", "p.b", "ca", "cb")
    found = materialize(verified(one, members, percent), "between", "uncompressed")
    links = links.union(found.select("a", "b"))
    others = rest.join(one.select("a", "b"), ["a", "b"], "left_anti").join(found.select("ca", "cb"), ["ca", "cb"], "left_anti")
    others = materialize(others.select("a", "b"), "others", "uncompressed")
    if others.limit(1).count():
        others = _between(others, connected_components(_edges(links))).select("a", "b")
        links = links.union(materialize(verified(others, members, percent), "last", "uncompressed"))
    return links, connected_components(_edges(links))


def classes(docs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the texts, by key, that are linked to another text."""
    held = materialize(buckets(materialize(prefixes(rows, percent), "prefixes", "uncompressed")), "buckets", "uncompressed")
    few, many = held.filter(f"size <= {SMALL}"), held.filter(f"size > {SMALL}")
    left, right = (few.select("h", F.col("key").alias(p), F.col("n").alias(f"n{p}")) for p in "ab")
    met = left.join(right, "h").filter(F.col("a") < F.col("b"))
    leads = many.filter("key = lead").select("h", F.col("key").alias("a"), F.col("n").alias("na"))
    led = many.filter("key <> lead").select("h", F.col("key").alias("b"), F.col("n").alias("nb")).join(leads, "h")
    cols = ["a", "b", "na", "nb"]
    pairs = met.select(*cols).union(led.select(*cols)).filter(_sizes_fit(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs", "uncompressed")
    members = materialize(sets(docs, held.select("key").distinct(), width, percent), "sets", "uncompressed")
    # A partner for each text first: most classes are whole with these.
    best = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(verified(best, members, percent), "links", "uncompressed")
    named = connected_components(_edges(links))
    links, named = _link_rest(pairs.join(best, ["a", "b"], "left_anti"), named, links, members, percent)

    # In large buckets, texts outside the leader's class meet a few texts of the bucket, then all of other classes.
    for last in (False, True):
        labelled = _labelled(many, named)
        apart = labelled.filter("c <> head")
        if not apart.limit(1).count():
            return named
        wide = labelled.join(apart.select("h").distinct(), "h", "left_semi").join(members.select("key", "sketch"), "key")
        wide = materialize(wide, "undecided", "uncompressed")
        more = materialize(_met(wide, percent, last).join(pairs, ["a", "b"], "left_anti"), "more", "uncompressed")
        pairs = pairs.union(more)
        links, named = _link_rest(more, named, links, members, percent)
    return named


def _labelled(many: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of large buckets with c, a text's class, and head, its leader's."""
    own = named.select(F.col("node").alias("key"), F.col("component").alias("c"))
    labelled = many.join(own, "key", "left").withColumn("c", F.coalesce("c", "key"))
    heads = labelled.filter("key = lead").select("h", F.col("c").alias("head"))
    return materialize(labelled.join(heads, "h"), "labelled", "uncompressed")


def _met(wide: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b): texts outside the leader's class and texts of other classes in their bucket whose sketches allow a link.

    whole: all of these, but for buckets after the first that both texts have among their `HEADS`, as pairs of near texts share
    many; else `PROBES` of the bucket and of those outside.
    """
    held = wide
    if whole:
        held = wide.join(wide.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("h")), 1, HEADS).alias("hs")), "key")
    else:
        some = lambda d, seed: d.groupBy("h").agg(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(seed + r))) for r in range(PROBES)]).alias("p"))
        probes = some(wide, 100).union(some(wide.filter("c <> head"), 200)).select("h", F.explode("p").alias("key")).distinct()
        held = wide.join(materialize(probes, "probes", "uncompressed"), ["h", "key"], "left_semi")
    parts = F.expr(f"cast(size div {PART} as int)") if whole else F.lit(0)
    dealt = F.pmod(F.xxhash64("key", F.lit(3)), parts + 1).cast("int") if whole else F.lit(0)
    named = lambda d, p: d.select("h", "part", *[F.col(c).alias(f"{p}_{c}") for c in ("key", "c", "n", "sketch", *(["hs"] if whole else []))])
    x = named(held.withColumn("part", dealt), "x")
    own = (held if whole else wide).filter("c <> head")
    f = named(own.withColumn("part", F.explode(F.sequence(F.lit(0), parts))), "f")
    bits = reduce(Column.__add__, [F.bit_count(F.get("f_sketch", F.lit(i)).bitwiseXOR(F.get("x_sketch", F.lit(i)))) for i in range(SKETCH)])
    near = (100 + percent) * bits <= (100 - percent) * (F.col("f_n") + F.col("x_n"))
    ok = (F.col("f_c") != F.col("x_c")) & _sizes_fit(F.col("f_n"), F.col("x_n"), percent) & near
    if whole:
        ok = ok & (F.coalesce(F.get(F.array_intersect("f_hs", "x_hs"), F.lit(0)), F.col("h")) >= F.col("h"))
    # Rows that repeat a text's sketch are small when written, and Spark would broadcast them by that size.
    return f.join(x.hint("merge"), ["h", "part"]).filter(ok).select(F.least("f_key", "x_key").alias("a"), F.greatest("f_key", "x_key").alias("b")).distinct()


def join_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), a row a row.

    Texts link when 100 * intersection >= percent * union of their sets of shingles of `width` lower-case words (fewer
    words: the whole sequence). component_id: the smallest doc_id reachable by links; null if no row there has one. A text
    that is null or has no word is linked with nothing. Other columns are ignored. An empty table gives an empty table.
    Stages are written to the shared folder while the query is being built.
    """
    with scratch() as own:
        told = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("key")), "rows")
        rows = materialize(first_members(docs, width, percent), "first-members", "uncompressed")
        sizes = materialize(rows.select("key", "n"), "sizes")
        named = classes(docs, rows.filter("n > 0"), width, percent)
        named = materialize(named, "classes", "uncompressed")
    discard(docs.sparkSession, [own[1], *own[3:-1]])  # all but `told`, `sizes` and `named`
    texts = told.groupBy("key").agg(F.min("doc_id").alias("least")).join(sizes, "key")
    of = texts.join(named.withColumnRenamed("node", "key"), "key", "left").select("key", "n", "least", F.coalesce("component", "key").alias("class"))
    least = of.groupBy("class").agg(F.min("least").alias("component_id"))
    of = of.join(least, "class").select("key", "n", "component_id")
    both = told.join(of, "key")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT k, unnest(list_distinct(list_transform(range(greatest(1, len(w) - {WIDTH - 1})), lambda i: array_to_string(w[i + 1:i + {WIDTH}], ' ')))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM shared JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT k AS x, k AS y FROM n UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x),
least_ AS (SELECT r.x AS k, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.k = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id FROM d LEFT JOIN n USING (k) LEFT JOIN least_ USING (k)
"""
