"""Best-fit packing of token sequences by bin completion.

Documents are tokenised, ended by an end id, and cut into pieces of at most `capacity` ids only if they are longer. A
sequence is then a bin, and all that matters of a piece is its length: the counts of the lengths 1..capacity, a table
of bounded size, are all that the driver sees. On them runs bin completion: take the largest length left, enumerate the
undominated fillings of the room beside it, apply one as often as the counts allow, and go on; branches whose waste
exceeds what the incumbent leaves are pruned. Best-fit decreasing gives the first incumbent, and the search stops at the
lower bound or after `nodes` steps; without that limit it ends with the least number of bins. The plan is then dealt out: the k-th piece of a length finds its bin and offset by
binary search in the plan's intervals.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import batch, map_arrow, text_or_empty

CAPACITY, END = 1024, 2
#: Steps of the search at most, by default: nodes visited and items tried in their fillings. None: until it is proved.
NODES = 500_000
#: Fillings that a node tries first, by a look at pairs and triples; the enumeration of all of them follows.
FIRST = 3
#: Pieces of one length that a bucket of their numbering is to hold, about.
BUCKET_ROWS = 20_000

#: Characters on which both libraries' word patterns surely agree; other texts go to `tokenizers`.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧]")
_LONG_RUN = re.compile(r"\S{2000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as `tokenizers` gives them for the JSON file (add_special_tokens=False), as uint32.

    If the same vocabulary lies beside it as ranks, the faster library of that format encodes the texts on which both
    are sure to agree: no special token's string, plain characters only, no very long run without white space.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = re.sub(r"\.json$", ".tiktoken", path)
        if ranks != path and os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or _PLAIN.search(text) or _LONG_RUN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full pieces behind a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, ids, out = encoder(path), b.column(0).to_pylist(), []
        for doc, text in zip(ids, b.column(1).to_pylist()):
            raw = np.append(enc(text), np.uint32(end)).astype("<u4").tobytes()
            out += [(doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
        cols = list(zip(*out)) or [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return batch(["doc_id", "piece", "start", "length", "ids_crc32"], *[pa.array(c, t) for c, t in zip(cols, types)])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), fn, "doc_id long, piece int, start long, length long, ids_crc32 long")


Filling = tuple[int, ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: all lengths together, and for each t the lengths over capacity - t, those over half,
    and what of the rest the latter can't take."""
    total = int((np.arange(len(counts)) * counts).sum())
    best = -(-total // capacity)
    n = np.concatenate((np.cumsum(counts[::-1])[::-1], [0]))  # of length i or more
    s = np.concatenate((np.cumsum((np.arange(len(counts)) * counts)[::-1])[::-1], [0]))
    for t in range(1, capacity // 2 + 1):
        big, mid = int(n[capacity - t + 1]), int(n[capacity // 2 + 1] - n[capacity - t + 1])
        room = mid * capacity - int(s[capacity // 2 + 1] - s[capacity - t + 1])
        rest = int(s[t] - s[capacity // 2 + 1])
        best = max(best, big + mid + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the counts: (lengths, times)."""
    open_bins: dict[int, list[list]] = {}
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_bins if r >= length):
            if not left:
                break
            each = room // length
            for group in open_bins.pop(room):
                pattern, times = group
                full = min(times, left // each)
                if full:
                    open_bins.setdefault(room - each * length, []).append([pattern + (length,) * each, full])
                    left -= full * each
                    times -= full
                if times and left:
                    open_bins.setdefault(room - left * length, []).append([pattern + (length,) * left, 1])
                    left, times = 0, times - 1
                if times:
                    open_bins.setdefault(room, []).append([pattern, times])
        if left:
            each = capacity // length
            if left // each:
                open_bins.setdefault(capacity - each * length, []).append([(length,) * each, left // each])
            if left % each:
                open_bins.setdefault(capacity - left % each * length, []).append([(length,) * (left % each), 1])
    return [(tuple(p), t) for groups in open_bins.values() for p, t in groups]


def _dominates(a: Filling, b: Filling) -> bool:
    """Whether the items of b can be dealt into those of a."""
    if not b:
        return True
    x, rest = b[0], b[1:]
    return any(_dominates(a[:i] + ((v - x,) if v > x else ()) + a[i + 1 :], rest) for i, v in enumerate(a) if v >= x)


def fillings(counts: np.ndarray, room: int, most: int = FIRST) -> list[Filling]:
    """Some full undominated fillings of the room by lengths left (up to three large items, small ones then), fullest first."""
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0]
    if not len(have):
        return [()]
    below = np.zeros(room + 1, int)  # the largest length left that is at most x
    below[have] = have
    below = np.maximum.accumulate(below)
    found: set[Filling] = {(int(below[room]),)}
    if not counts[room]:
        b = have[have * 2 >= below[room]] if len(have) > 256 else have
        c = below[np.minimum(room - b, b)]
        same = (c == b) & (counts[b] < 2)
        c = np.where(same, below[np.maximum(np.minimum(room - b, b - 1), 0)], c)
        sums = b + c
        for i in np.argsort(-sums, kind="stable")[: 2 * most]:
            if c[i]:
                found.add((int(b[i]), int(c[i])))
        if sums.max(initial=0) < room:
            for x in have[::-1][:24].tolist():
                r = room - x
                if r <= 0:
                    continue
                b2 = have[have <= min(x, r)]
                if not len(b2):
                    continue
                c2 = below[np.minimum(r - b2, b2)]
                i = int(np.argmax(b2 + c2))
                three = tuple(sorted((x, int(b2[i]), int(c2[i])), reverse=True))
                if three[2] and all(counts[v] >= three.count(v) for v in three):
                    found.add(three)
    out = []
    for f in found:
        left = room - sum(f)
        while left > 0 and below[left]:
            x = int(below[left])
            while x and counts[x] <= f.count(x):
                x = int(below[x - 1])
            if not x:
                break
            f = tuple(sorted((*f, x), reverse=True))
            left -= x
        out.append(f)
    out = sorted(set(out), key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))
    kept: list[Filling] = []
    for f in out:
        if len(f) > 6 or not any(len(g) <= 4 and _dominates(g, f) for g in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept


def _dominated(counts: np.ndarray, f: Filling, left: int) -> bool:
    """Whether one more item could stand in place of some of the filling's: alone a larger one, or one for several.

    All subsets of up to ten items are tried, of longer fillings the single items and pairs; what is not found dominated
    is tried in vain at worst.
    """
    spare = lambda y: y < len(counts) and counts[y] > f.count(y)
    sizes = range(1, len(f) + 1) if len(f) <= 10 else (1, 2)
    for n in sizes:
        for s in {sum(c) for c in combinations(f, n)}:
            if any(spare(y) for y in range(s + (n == 1), s + left + 1)):
                return True
    return any(spare(y) for y in range(1, left + 1))


def completions(counts: np.ndarray, room: int, waste: Callable[[], int], step: Callable[[], bool]) -> Iterator[Filling]:
    """All undominated fillings of the room by lengths left, those of least waste first, as long as a step is granted.

    `waste` tells how much may be left at most, asked again as the search goes on. The counts may be changed while the
    enumeration rests if they are restored before it goes on.
    """
    have = np.flatnonzero(counts[: room + 1])
    have = have[have > 0].tolist()
    number = counts[: room + 1].tolist()
    below = np.cumsum(np.arange(room + 1) * counts[: room + 1]).tolist()  # what all items up to a length fill

    def exact(left: int, at: int) -> Iterator[Filling]:
        """Fillings that sum up to `left`, of lengths have[:at]."""
        if not left:
            yield ()
            return
        for i in range(bisect_right(have, left, 0, at) - 1, -1, -1):
            x = have[i]
            if below[x] < left or not step():
                return
            for m in range(min(number[x], left // x), 0, -1):
                for rest in exact(left - m * x, i):
                    yield (x,) * m + rest

    w = 0
    while w <= min(room, waste()):
        for f in exact(room - w, len(have)):
            if not _dominated(counts, f, w):
                yield f
        if not step():
            return
        w += 1


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[Filling, int]]:
    """Packs counts[length] items of each length 1..capacity: [(lengths of a bin, times)].

    The best-fit plan is the incumbent. A node completes the bin of the largest length left by each undominated filling,
    as often as the counts allow and then once; a branch ends where its waste leaves no plan of fewer bins. The search
    stops at the lower bound, when all branches have ended, or after `nodes` steps; None sets no limit.
    """
    counts = np.asarray(counts, np.int64).copy()
    counts = np.concatenate((counts, np.zeros(max(0, capacity + 1 - len(counts)), np.int64)))
    total = int((np.arange(len(counts)) * counts).sum())
    incumbent = best_fit(counts, capacity)
    best, least = sum(t for _, t in incumbent), lower_bound(counts, capacity)
    path: list[tuple[Filling, int]] = []
    levels: list[Iterator[tuple[Filling, int]]] = []
    waste = seen = 0

    def step() -> bool:
        nonlocal seen
        seen += 1
        return nodes is None or seen <= nodes

    def options() -> Iterator[tuple[Filling, int]]:
        top = int(np.flatnonzero(counts)[-1])
        own = counts.copy()
        own[top] -= 1
        first = fillings(own, capacity - top)
        for f in chain(first, (f for f in completions(own, capacity - top, lambda: (best - 1) * capacity - total - waste, step) if f not in first)):
            f = (top, *f)
            times = min(int(counts[x]) // f.count(x) for x in set(f))
            yield f, times
            if times > 1:
                yield f, 1

    def apply(f: Filling, times: int) -> None:
        nonlocal waste
        for x in f:
            counts[x] -= times
        waste += (capacity - sum(f)) * times

    if counts.any() and best > least:
        levels.append(options())
    while levels and best > least and (nodes is None or seen <= nodes):
        if len(path) == len(levels):  # back from below
            f, times = path.pop()
            apply(f, -times)
        f, times = next(levels[-1], ((), 0))
        if not times:
            levels.pop()
            continue
        # It can't end with fewer bins than the incumbent.
        if waste + (capacity - sum(f)) * times > (best - 1) * capacity - total:
            continue
        step()
        apply(f, times)
        path.append((f, times))
        if counts.any():
            levels.append(options())
        elif sum(t for _, t in path) < best:
            best, incumbent = sum(t for _, t in path), list(path)
    return [(f, t) for f, t in incumbent if t]


def plan_intervals(plan: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """{length: (first ordinal, first bin, items a bin, offset in the bin) of each interval of ordinals}."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    bins = 0
    for f, times in plan:
        at = 0
        for x in sorted(set(f), reverse=True):
            m = f.count(x)
            rows.setdefault(x, []).append((used.get(x, 0), bins, m, at))
            used[x] = used.get(x, 0) + m * times
            at += m * x
        bins += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, nodes: int | None = NODES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    Null text counts as empty: one piece, the end id. Repeated rows and null doc_ids are packed like any other. An empty
    table gives an empty table; other columns are ignored. Only the counts of the lengths pass through the driver.
    """
    own = materialize(pieces(docs, tokenizer, capacity, end), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in own.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    # A length has as many buckets as its pieces need, so that none of them grows with the table.
    buckets = F.get(F.array(*[F.lit(-(-int(n) // BUCKET_ROWS) or 1) for n in counts]), F.col("length").cast("int"))
    bucketed = own.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets).cast("int"))
    sums = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    intervals = plan_intervals(bin_completion(counts, capacity, nodes))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = bucketed.join(base, ["length", "_bucket"]).select(*own.columns, (F.col("_base") + F.row_number().over(within) - 1).alias("_k"))

    names = [*own.columns, "sequence_id", "offset"]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        length, k = b.column(3).to_numpy(), b.column(5).to_numpy()
        seq, off = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            first, bins, m, o = intervals[x]
            i = np.searchsorted(first, k[at], "right") - 1
            seq[at] = bins[i] + (k[at] - first[i]) // m[i]
            off[at] = o[i] + (k[at] - first[i]) % m[i] * x
        return batch(names, *[b.column(i) for i in range(5)], seq, off)

    return map_arrow(numbered, fn, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
