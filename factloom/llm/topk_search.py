"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

The queries are taken in blocks of bounded size; each block visits all rows once. Within a chunk of candidates each
dimension is a list sorted by value. A round reads every list to the next depth, from its top for a positive query
component and from its bottom for a negative one. What has been read of a candidate, with the list's current frontier
for what has not, bounds its score from above; with the list's far end, from below. Candidates whose upper bound is under
the bar, the k-th best score of earlier chunks or else the k-th best lower bound, cannot qualify and leave. A query whose
outsiders are ruled out stops reading: only the scores of the few that are left are resolved, and the best k join those
of the earlier chunks. Bounds are float64, exact for integers to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import batch

#: Depths to which the rounds read the lists, before they are read whole.
DEPTHS = (0.5, 0.6, 0.7, 0.8, 0.9)
#: Candidates of a chunk, and of the first one; cells of a matrix of bounds; pairs whose
#: scores are resolved at once. They bound memory and change no result.
CHUNK, FIRST, CELLS, PAIRS = 2048, 256, 1 << 21, 20_000
#: A block of queries holds at most this many numbers; it is what is sent to each task.
QUERY_NUMBERS = 2_000_000
_SAFE = float(1 << 53)
_LONG = (1 << 63) - 1


def quantize(vectors: list, scale: float = 256.0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows that take part, by dimension: {dimension: floor(scale * x)}, and a mask over the rows."""
    ok = np.zeros(len(vectors), bool)
    rows: dict[int, list] = {}
    where: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        a = np.floor(np.asarray(v, np.float64) * scale)
        if not np.isfinite(a).all():
            continue
        ok[i] = True
        rows.setdefault(len(v), []).append(a)
        where.setdefault(len(v), []).append(i)
    return ok, {d: (np.array(where[d]), np.array(r).reshape(len(r), d)) for d, r in rows.items()}


def _quantize_column(col: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The same for an Arrow list column, without Python rows where all lengths agree and nothing is null."""
    flat = col.flatten()
    n = len(col)
    if n and not col.null_count and not flat.null_count and len(flat) % n == 0:
        lengths = np.diff(col.offsets.to_numpy())
        if (lengths == lengths[0]).all() and lengths[0]:
            a = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) * scale)
            good = np.flatnonzero(np.isfinite(a).all(axis=1))
            return {a.shape[1]: (good, a[good])} if len(good) else {}
    return quantize(col.to_pylist(), scale)[1]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products; beyond 2^53 by Python's integers, held to the range of a long."""
    reach = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if reach < _SAFE:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(q, x)], np.int64)


class NoRandomAccess:
    """The best k of all candidates seen so far, for the queries of one dimension.

    `settled[i]` counts the (query, chunk) pairs that ended after round i, the last entry those whose lists were read
    whole; `resolved` of `met` (query, candidate) pairs had their scores resolved, the others were ruled out by bounds.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.full = np.zeros(len(ids), int)
        self.settled = np.zeros(len(DEPTHS) + 1, int)
        self.met = self.resolved = 0
        self.chunk = FIRST

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Candidates in chunks, each twice as long as the one before: the first ones set the bar for the others."""
        at = 0
        while at < len(ids):
            n = self.chunk
            self.chunk = min(CHUNK, 2 * n)
            self._chunk(ids[at : at + n], x[at : at + n])
            at += n

    def _chunk(self, ids: np.ndarray, x: np.ndarray) -> None:
        n, d = x.shape
        self.met += n * len(self.ids)
        big = (np.abs(self.q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, d) >= _SAFE
        order = np.argsort(x, axis=0, kind="stable")
        lists = np.take_along_axis(x, order, axis=0)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
        step = max(1, CELLS // n)
        for at in range(0, len(self.ids), step):
            rows = np.arange(at, min(at + step, len(self.ids)))
            if big or not d:  # no bounds in float64, or no lists
                self.settled[-1] += len(rows)
                self._resolve(np.repeat(rows, n), np.tile(np.arange(n), len(rows)), ids, x)
            else:
                self._rounds(rows, ids, x, lists, rank)

    def _rounds(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, rank: np.ndarray) -> None:
        n = len(ids)
        alive = self.ids[rows][:, None] != ids[None, :]
        bar = self._bar(rows)
        few = max(n // 16, 2 * self.k)
        for i, depth in enumerate(DEPTHS):
            m = max(1, int(n * depth))
            if m >= n:
                break
            # m entries of each list have been read, from its top for a query's positive numbers, else from its bottom.
            seen_top, seen_low = rank >= n - m, rank < m
            alive &= self._bound(rows, alive, x, seen_top, seen_low, lists[n - m], lists[m - 1]) >= bar[:, None]
            unset = np.flatnonzero(bar == -np.inf)
            if len(unset) and n > self.k:  # the k-th best lower bound: what has not been read is at its list's far end
                mask = np.ones((len(unset), n), bool)
                lower = self._bound(rows[unset], mask, x, seen_top, seen_low, lists[0], lists[-1])
                lower[self.ids[rows[unset]][:, None] == ids[None, :]] = -np.inf
                bar[unset] = np.partition(lower, n - self.k, axis=1)[:, n - self.k]
                alive[unset] &= self._bound(rows[unset], alive[unset], x, seen_top, seen_low, lists[n - m], lists[m - 1]) >= bar[unset][:, None]
            done = alive.sum(axis=1) <= few
            if done.any():
                self.settled[i] += int(done.sum())
                at, c = np.nonzero(alive[done])
                self._resolve(rows[done][at], c, ids, x)
                rows, alive, bar = rows[~done], alive[~done], bar[~done]
            if not len(rows):
                return
        self.settled[-1] += len(rows)
        at, c = np.nonzero(alive)
        self._resolve(rows[at], c, ids, x)

    def _bound(self, rows, alive, x, seen_top, seen_low, top, low) -> np.ndarray:
        """Bounds of the alive pairs' scores, -inf for others: what has not been read counts as `top`, or as `low` where
        the query's number is negative. One product for all pairs while many are alive, else pair by pair."""
        q = self.q[rows]
        at, c = np.nonzero(alive)
        if len(at) * 16 > alive.size:
            return np.where(alive, np.maximum(q, 0) @ np.where(seen_top, x, top).T + np.minimum(q, 0) @ np.where(seen_low, x, low).T, -np.inf)
        out = np.full(alive.shape, -np.inf)
        for a in range(0, len(at), PAIRS):
            i, j = at[a : a + PAIRS], c[a : a + PAIRS]
            v = np.where(q[i] >= 0, np.where(seen_top[j], x[j], top), np.where(seen_low[j], x[j], low))
            out[i, j] = np.einsum("ij,ij->i", q[i], v)
        return out

    def _bar(self, rows: np.ndarray) -> np.ndarray:
        return np.where(self.full[rows] >= self.k, self.score[rows, -1].astype(np.float64), -np.inf)

    def _resolve(self, rows: np.ndarray, cand: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        keep = self.ids[rows] != ids[cand]
        rows, cand = rows[keep], cand[keep]
        if not len(rows):
            return
        self.resolved += len(rows)
        score = np.concatenate([exact_scores(self.q[rows[a : a + PAIRS]], x[cand[a : a + PAIRS]]) for a in range(0, len(rows), PAIRS)])
        touched = np.unique(rows)
        old = np.repeat(touched, self.k), self.score[touched].ravel(), self.vec[touched].ravel(), (np.arange(self.k)[None, :] < self.full[touched][:, None]).ravel()
        r = np.concatenate((old[0][old[3]], rows))
        s = np.concatenate((old[1][old[3]], score))
        v = np.concatenate((old[2][old[3]], ids[cand]))
        # Descending score without negation, which the smallest long has not.
        o = np.lexsort((v, ~s, r))
        r, s, v = r[o], s[o], v[o]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate((first, [len(r)]))))
        best = place < self.k
        self.score[r[best], place[best]] = s[best]
        self.vec[r[best], place[best]] = v[best]
        self.full[touched] = np.minimum(self.k, np.diff(np.concatenate((first, [len(r)]))))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = np.arange(self.k)[None, :] < self.full[:, None]
        return np.repeat(self.ids, self.full), self.vec[has], self.score[has]


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, scale: float):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {d: NoRandomAccess(i, q, k) for d, (i, q) in queries.items()}
        for b in batches:
            ids = b.column(0).to_numpy()
            for d, (at, x) in _quantize_column(b.column(1), scale).items():
                if d in state:
                    state[d].add(ids[at], x)
        for s in state.values():
            q, v, score = s.rows()
            if len(q):
                yield batch(["query_id", "vec_id", "score"], q, v, score)

    return fn


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query's k highest integer inner products.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but those of the query's own id.
    Ties go to the smaller vec_id. Vectors that are null, or hold a null or non-finite component, or whose vec_id is
    null take no part; vectors of another length than the query's are no candidates; empty vectors score zero. Of rows
    that repeat a query's vec_id the one with the least vector is asked. Repeated candidates each have their place. An empty table gives an empty
    table. A score beyond the range of a long is held to it. The queries pass through the driver in blocks of
    `QUERY_NUMBERS` numbers, one block at a time.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = v.filter((F.col("vec_id") % every == 0) & valid)
    stats = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Blocks by a hash of the id: each is about half of what is allowed, whatever the ids are.
    numbers = stats["n"] * max(1, stats["d"])
    blocks = 1 if numbers <= QUERY_NUMBERS else -(-numbers * 2 // QUERY_NUMBERS)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def block(i: int) -> DataFrame:
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow()
        queries = {}
        if part.num_rows:
            ids = part.column("vec_id").combine_chunks().to_numpy()
            queries = {d: (ids[at], q) for d, (at, q) in quantize(part.column("embedding").to_pylist(), scale)[1].items()}
        held = spark.sparkContext.broadcast(queries)

        def fn(batches):
            return _search(held.value, k, scale)(batches)

        found = v.mapInArrow(fn, "query_id long, vec_id long, score long")
        best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return best
        best = materialize(best, "top-k")  # one block's queries at a time are on the driver and the executors
        held.destroy()
        return best

    return reduce(DataFrame.union, [block(i) for i in range(blocks)])
