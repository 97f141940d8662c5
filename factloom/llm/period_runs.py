"""Runs of periodic words, found by block matching.

A run is a stretch of words that is equal to itself `period` words on, at least three periods and `LEAST` words long, with
its smallest period, and as long as it can be. Let L be its length and q its period: the first L - q >= 2q words recur at
distance q. For blocks of B words with B <= q < 2B (of 8 words for all q < 16) that stretch is at least 2B - 1 words long and
so holds a block that starts at a multiple of B. So:

* Aligned blocks of each power of two go into a pyahocorasick automaton of integer sequences, the words' numbers.
* One search of the document gives all places where they occur. An occurrence at a distance of B to 2B - 1 behind the
  block (1 to 15 for blocks of 8) is a seed of that period.
* A seed is extended exactly in both directions; of equal stretches the smallest period counts.

Blocks whose first four words do not recur at a distance of that range cannot have an occurrence there and are left out of
the automaton; most documents have no other blocks. A document is solved where it is read: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC32_SQL, batch, map_arrow, text_or_empty

#: Words, and periods, that a run has at least.
LEAST, TIMES = 24, 3
#: Words of the smallest blocks; words at a block's start that must recur.
BLOCK, START = 8, 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbers(ws: list) -> np.ndarray:
    """Equal words have equal numbers, from 0 in order of first occurrence."""
    of: dict = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in ws), np.int64, len(ws))


def possible_blocks(x: np.ndarray) -> list[tuple[int, int]]:
    """(start, words) of the aligned blocks whose first words recur at a distance that their size looks for."""
    n = len(x)
    if n < LEAST:
        return []
    m = n - START + 1
    g = sum((x[i : i + m].astype(np.uint64) * _MIX[i] for i in range(1, START)), x[:m].astype(np.uint64) * _MIX[0])
    order = np.argsort(g, kind="stable")
    sorted_g = g[order]
    new = np.concatenate(([True], sorted_g[1:] != sorted_g[:-1]))
    if new.all():
        return []
    rank_sorted = np.cumsum(new) - 1
    rank = np.empty(m, np.int64)
    rank[order] = rank_sorted
    places = rank_sorted * n + order  # ascending: a start's places stand together and in order
    starts, sizes = [], []
    b = BLOCK
    while TIMES * b <= n or b == BLOCK:
        s = np.arange(0, n - b + 1, b)
        starts.append(s)
        sizes.append(np.full(len(s), b))
        b *= 2
    s, b = np.concatenate(starts), np.concatenate(sizes)
    nearest = np.where(b == BLOCK, 1, b)
    first = np.searchsorted(places, rank[s] * n + s + nearest)
    found = places[np.minimum(first, m - 1)]
    ok = (first < m) & (found // n == rank[s]) & (found % n < s + 2 * b)
    return list(zip(s[ok].tolist(), b[ok].tolist()))


def _matching(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j > i on, in the direction of `step`, are equal one by one."""
    most = len(x) - j if step > 0 else i + 1
    done, size = 0, 32
    while done < most:
        k = min(size, most - done)
        if step > 0:
            differ = x[i + done : i + done + k] != x[j + done : j + done + k]
        else:
            differ = (x[i - done - k + 1 : i - done + 1] != x[j - done - k + 1 : j - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + k, size * 2
    return most


def runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    blocks = possible_blocks(x)
    if not blocks:
        return []
    keys: dict[tuple[int, ...], list[int]] = {}  # a block's words: where it stands
    for s, b in blocks:
        keys.setdefault(tuple(x[s : s + b].tolist()), []).append(s)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for k, at in keys.items():
        automaton.add_word(k, (len(k), at[0], set(at)))
    automaton.make_automaton()
    covered: dict[int, int] = {}  # period: where the stretch that was last extended with it ends
    stretches: dict[tuple[int, int], int] = {}  # (start, length): smallest period
    for end, (b, first, at) in automaton.iter(tuple(x.tolist())):
        o = end - b + 1
        near, far = (1, 2 * b - 1) if b == BLOCK else (b, 2 * b - 1)
        if o - near < first:
            continue
        for s in range((o - near) // b * b, max(first, o - far) - 1, -b):
            if s not in at:
                continue
            p = o - s
            if covered.get(p, -1) > s:
                continue
            right = s + _matching(x, s, o, 1)
            left = s - (_matching(x, s - 1, o - 1, -1) if s else 0)
            covered[p] = right
            length = right + p - left
            if length >= max(LEAST, TIMES * p):
                key = (left, length)
                stretches[key] = min(p, stretches.get(key, p))
    return sorted(((s, n, p) for (s, n), p in stretches.items()), key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, or among each of their runs' first `period` words."""
    edges = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        edges[s + p] += 1
        edges[s + length] -= 1
    return np.cumsum(edges[:-1]) == 0


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties: the smallest start, then the smallest period."""
    out = None
    for r in found:
        if out is None or r[1] * out[2] > out[1] * r[2]:
            out = r
    return out


def planted(doc_id: int | None, ws: list) -> list:
    """The words, with a periodic tail for a tenth of the ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(ws)
    if h % 10 or not n:
        return ws
    g = h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return ws[:a] + (ws[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(doc_id: int | None, text: str | None) -> tuple:
    ws = planted(doc_id, words(text))
    found = runs(numbers(ws))
    top = best(found)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = [ws[i] for i in np.flatnonzero(kept(len(ws), found)).tolist()] if found else ws
    own = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(found), *own, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> a row a row: number of runs after planting, the best run, digests of runs and kept words.

    Null text counts as empty and has no words; a null doc_id gets nothing planted; rows of equal doc_id are rows of
    their own. Without a run the four columns of the best one are null. Other columns are ignored.
    """

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [digests(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return batch([c.split()[0] for c in _SCHEMA.split(", ")], b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), fn, _SCHEMA)


def find_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, start, length, period), a row a run of the text as it is, and no row without one."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in runs(numbers(words(t)))]
        columns = list(zip(*rows)) if rows else [()] * 4
        return batch(["doc_id", "start", "length", "period"], *[pa.array(c, pa.int64()) for c in columns])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), fn, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """The documents with each run cut to its first period, words joined by a blank; a text without runs stays as it is. The columns of `docs`."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            ws = words(t)
            found = runs(numbers(ws)) if t else []
            out.append(b" ".join([ws[i] for i in np.flatnonzero(kept(len(ws), found)).tolist()]).decode("utf-8", "surrogatepass") if found else t)
        return pa.array(out, pa.string())

    return docs.withColumn("text", cut(F.col("text")))


#: Every pair of equal words no more than a third of the document apart, put together to stretches.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32_SQL.format('doc_id')} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted FROM d),
f AS (SELECT *, g % greatest(n, 1) AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
x AS (SELECT k, doc_id, n, unnest(CASE WHEN planted THEN w[1:a] || list_transform(range(n - a), lambda i: w[a + 1 + i % p]) ELSE w END) AS word, unnest(range(n)) AS i FROM p),
same AS (SELECT a.k, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.k = b.k AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
stretches AS (SELECT k, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS part FROM same)
  GROUP BY k, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT k, s, length, min(q) AS q FROM stretches GROUP BY k, s, length),
told AS (SELECT k, count(*) AS n_runs, arg_min({{'s': s, 'l': length, 'q': q}}, (-length::DOUBLE / q, s, q)) AS best, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + length)) AS i FROM runs),
left_ AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, (1000 * best.l // best.q) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (k) LEFT JOIN left_ USING (k)
"""
