"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint from the XXH64 of its word shingles. Two fingerprints are linked when they differ
in at most `radius` bits. The search never compares all pairs:

* Distances of random 64-bit fingerprints to any pivot lie close together, so pivots alone would leave nearly all pairs
  of a large table. Block tables come first: the bits are dealt into `blocks` groups, of which at least
  ``blocks - radius`` agree whole in a linked pair, and for each choice of that many groups a table keyed by their bits
  brings such a pair together. No linked pair is missed.
* Within a key, each fingerprint's Hamming distances to `PIVOTS` reference fingerprints, taken once, bound a pair's
  distance from below: a pair whose largest coordinate difference exceeds the radius is discarded, and the survivors
  are verified on the fingerprints.

A key's rows arrive sorted in one stream. Runs of at most `RUN` rows are solved there and give a spanning forest, at
most one edge a row. Longer runs are cut into pieces, and each pair of pieces becomes a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.runtime import materialize
from .common import batch, map_arrow, text_or_empty

PIVOTS = 32
#: Longest run of one key that a single task solves.
RUN = 2048
#: Runs up to this length are compared column by column for the whole batch at once.
SHORT = 8


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle of a text, as rows of eight bytes; a text of fewer words is one shingle, of none has no row."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[width - 1 :].tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)])
    return np.frombuffer(raw, np.uint8).reshape(n, 8)


def simhash64(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text: a bit is set if it is set in over half of the shingle hashes. No words: zero."""
    hashes = shingle_hashes(text, width, seed)
    n = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        votes += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp), fp as a signed long. Null text counts as empty."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((simhash64(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        return batch(["doc_id", "fp"], b.column(0), pa.array(fp.view(np.int64)))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), fn, "doc_id long, fp long")


def pivots(n: int = PIVOTS, seed: int = 1) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {seed} {i}") for i in range(n)], np.uint64)


def block_keys(fp: np.ndarray, radius: int, blocks: int) -> Iterator[np.ndarray]:
    """For each table, the key of each fingerprint: table number above the bits of its blocks."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [(fp >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1) for a, b in zip(edges, edges[1:])]
    widths = np.diff(edges)
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = np.full(len(fp), t, np.uint64)
        for c in chosen:
            key = (key << np.uint64(widths[c])) | parts[c]
        yield key.view(np.int64)


class _Forest:
    """Union-find over positions 0..n-1; the root is the least position."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.p[max(a, b)] = min(a, b)


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with Hamming distance of a[i] and b[j] at most the radius, by their pivot tables."""
    refs = pivots()
    da = np.bitwise_count(a[:, None] ^ refs[None, :]).astype(np.int8)
    db = np.bitwise_count(b[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(db[:, 0], kind="stable")
    first = db[order, 0]
    out_i, out_j = [], []
    for i in range(len(a)):
        lo, hi = np.searchsorted(first, [int(da[i, 0]) - radius, int(da[i, 0]) + radius + 1])
        js = order[lo:hi]
        for k in range(1, PIVOTS, 8):  # coordinates in groups, as most pairs fall in the first
            if not len(js):
                break
            js = js[(np.abs(db[js, k : k + 8] - da[i, k : k + 8]) <= radius).all(axis=1)]
        js = js[np.bitwise_count(b[js] ^ a[i]) <= radius]
        out_i.append(np.full(len(js), i))
        out_j.append(js)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def _forest_edges(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = _Forest(len(fp))
    for x, y in zip(i.tolist(), j.tolist()):
        f.join(x, y)
    root = np.array([f.find(x) for x in range(len(fp))], int)
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _solve(keys: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges within whole runs of equal keys (sorted)."""
    out = []
    cut = np.flatnonzero(np.diff(keys)) + 1
    start = np.concatenate(([0], cut))
    size = np.diff(np.concatenate((start, [len(keys)])))
    length = np.repeat(size, size)
    for k in range(1, SHORT):  # short runs: all pairs at distance k in the stream, at once
        at = np.flatnonzero((length[:-k] <= SHORT) & (keys[:-k] == keys[k:])) if len(keys) > k else np.zeros(0, int)
        if not len(at):
            break
        a, b = fp[at], fp[at + k]
        ok = np.ones(len(at), bool)
        for p in pivots():
            ok[ok] = np.abs(np.bitwise_count(a[ok] ^ p).astype(np.int8) - np.bitwise_count(b[ok] ^ p).astype(np.int8)) <= radius
        ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= radius
        out.append((b[ok], a[ok]))
    for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist()):
        run = fp[s : s + n]
        i, j = linked(run, run, radius)
        out.append(_forest_edges(run, i[i < j], j[i < j]))
    return out


_EDGES = "src long, dst long, key long, piece long"


def _edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    if not len(a):
        return None
    b = np.concatenate([p[1] for p in pairs])
    none = pa.nulls(len(a), pa.int64())
    return batch(["src", "dst", "key", "piece"], pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none)


def _link_stream(radius: int, run: int):
    """Sorted (key, fp) -> edges; the rows of a run longer than `run` come out as (fp, null, key, piece)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, long_key, seen = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0

        def hot(k: int, f: np.ndarray, seen: int) -> pa.RecordBatch:
            n = len(f)
            return batch(["src", "dst", "key", "piece"], pa.array(f.view(np.int64)), pa.nulls(n, pa.int64()), np.full(n, k), (seen + np.arange(n)) // run)

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            fps = np.concatenate((fps, b.column(1).to_numpy().view(np.uint64)))
            if long_key is not None:  # the run that began before goes on
                n = int(np.searchsorted(keys, long_key, "right"))
                if n:
                    yield hot(long_key, fps[:n], seen)
                    seen += n
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                long_key = None
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[:last])) + 1, [last])) if last else np.zeros(1, int)
            big = np.flatnonzero(np.diff(cuts) > run)
            keep = np.ones(last, bool)
            for g in big:
                keep[cuts[g] : cuts[g + 1]] = False
                yield hot(int(keys[cuts[g]]), fps[cuts[g] : cuts[g + 1]], 0)
            if keep.any() and (out := _edge_batch(_solve(keys[:last][keep], fps[:last][keep], radius))) is not None:
                yield out
            keys, fps = keys[last:], fps[last:]
            if len(keys) > run:
                long_key, seen = int(keys[0]), len(keys)
                yield hot(long_key, fps, 0)
                keys, fps = keys[:0], fps[:0]
        if len(keys) and (out := _edge_batch(_solve(keys, fps, radius))) is not None:
            yield out

    return fn


def _piece_pairs(radius: int):
    """Rows (key, i, j, side, fp) of one pair of pieces, sorted together -> edges between and within them."""

    def solve(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        a = np.concatenate([f for s, f in rows if s == 0] or [np.zeros(0, np.uint64)])
        b = np.concatenate([f for s, f in rows if s == 1] or [np.zeros(0, np.uint64)])
        both = np.concatenate((a, b))
        i, j = linked(a, b, radius) if len(b) else linked(a, a, radius)
        return _edge_batch([_forest_edges(both, i, j + len(a) if len(b) else j)])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            k, i, j, side = (b.column(c).to_numpy() for c in range(4))
            fp = b.column(4).to_numpy().view(np.uint64)
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(k)]):
                if s == e:
                    continue
                group = (k[s], i[s], j[s])
                if now is not None and group != now:
                    if (out := solve(rows)) is not None:
                        yield out
                    rows = []
                now = group
                rows.append((int(side[s]), fp[s:e]))
        if rows and (out := solve(rows)) is not None:
            yield out

    return fn


def fingerprint_links(fps: DataFrame, radius: int = 4, blocks: int = 7, run: int = RUN) -> DataFrame:
    """(fp) -> edges(src, dst) that join all fingerprints whose Hamming distance is at most the radius.

    The edges are a spanning forest of each key's links, not all pairs; their components are those of all links.
    """
    if not 0 <= radius < blocks <= 16:
        raise ValueError("radius must be less than blocks, and blocks 16 at most")

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch | None:
        fp = b.column(0).to_numpy().view(np.uint64)
        if not len(fp):
            return None
        keys = list(block_keys(fp, radius, blocks))
        return batch(["key", "fp"], np.concatenate(keys), np.tile(fp.view(np.int64), len(keys)))

    rows = map_arrow(fps.select("fp").distinct(), keyed, "key long, fp long")
    found = materialize(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_stream(radius, run), _EDGES), "links")
    edges = found.filter("key IS NULL").select("src", "dst")
    hot = found.filter("key IS NOT NULL").select("key", "piece", F.col("src").alias("fp"))
    if hot.limit(1).count():
        pieces = hot.groupBy("key").agg((F.max("piece") + 1).alias("pieces"))
        paired = hot.join(pieces, "key").select("key", "piece", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("other"))
        dealt = paired.select(
            "key", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), (F.col("piece") > F.col("other")).cast("int").alias("side"), "fp"
        ).repartition("key", "i", "j")
        edges = edges.union(dealt.sortWithinPartitions("key", "i", "j", "side").mapInArrow(_piece_pairs(radius), _EDGES).select("src", "dst"))
    return edges


def near_duplicates(docs: DataFrame, radius: int = 4, blocks: int = 7, width: int = 4) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id), one row per row of `docs`.

    component_id is the smallest doc_id that links reach, links being between fingerprints that differ in at most
    `radius` bits. Null text counts as empty; a text without words has fingerprint zero and is linked like any other.
    Repeated rows come back repeated. A null doc_id comes back as null; a component of such rows alone has a null id.
    An empty table gives an empty table. Columns beyond doc_id and text are ignored.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    comp = connected_components(fingerprint_links(fps, radius, blocks))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(least.join(comp, least["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "classes")
    roots = materialize(classes.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = materialize(classes.join(roots, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, blocks: int = 7, width: int = 4) -> DataFrame:
    """Keeps exactly one row of each component; the columns of `docs`.

    It is the row with the smallest doc_id, nulls last, then the least hash of the text, then any of equal rows. Texts
    alone decide: rows of equal doc_id and unlike texts are rows of different components and both stay.
    """
    own = docs.withColumn("_key", F.xxhash64(text_or_empty()))
    fps = materialize(_keyed_fingerprints(docs, width), "keyed")
    comp = connected_components(fingerprint_links(fps, radius, blocks))
    classes = fps.join(comp, fps["fp"] == comp["node"], "left").select("key", "first", F.coalesce("component", "fp").alias("class"))
    kept = classes.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("k"))
    # Null doc_ids are dealt by the hash, so that the join is on plain keys and no group of equal texts lands in one task.
    kept = kept.select(F.coalesce("k.first", "k.key").alias("_at"), F.col("k.key").alias("_key"), F.col("k.none").alias("_none"))
    own = own.withColumn("_none", F.col("doc_id").isNull()).withColumn("_at", F.coalesce(F.col("doc_id").cast("long"), F.col("_key")))
    return own.join(kept, ["_at", "_key", "_none"], "left_semi").dropDuplicates(["_at", "_key", "_none"]).select(*docs.columns)


def text_links(docs: DataFrame, radius: int = 4, blocks: int = 7, width: int = 4) -> DataFrame:
    """(src, dst): each distinct text, by its hash, with the least one of its component of fingerprints."""
    fps = materialize(_keyed_fingerprints(docs, width), "keyed")
    comp = connected_components(fingerprint_links(fps, radius, blocks))
    named = fps.join(comp, fps["fp"] == comp["node"], "left").select("key", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("key").alias("least"))
    return named.join(least, "class").select(F.col("key").alias("src"), F.col("least").alias("dst")).filter("src <> dst")


def _keyed_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(key, first, fp) of the distinct texts, by their hash: least doc_id and fingerprint."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((simhash64(t, width) for t in b.column(2).to_pylist()), np.uint64, b.num_rows)
        return batch(["key", "first", "fp"], b.column(0), b.column(1), pa.array(fp.view(np.int64)))

    own = docs.select(F.xxhash64(text_or_empty()).alias("key"), F.col("doc_id").cast("long").alias("first"), text_or_empty().alias("text"))
    return map_arrow(own, fn, "key long, first long, fp long").groupBy("key", "fp").agg(F.min("first").alias("first"))
