"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral, scaled to the
source's target, is the source's cumulative demand for words. A source's documents stand in a fixed random order (the
MD5 of their doc_id) and take up its demand one after another, the whole source again once it is used up; a document's
training position is the time at which the inverted cumulative demand reaches it. Documents are range-sorted by it.

The running word counts are prefix sums in two levels: sums of (source, bucket of the order), their prefix, and one
window for each (source, bucket), so a source that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import WORD

#: Weights by a source's rank, repeating.
WEIGHTS = (5, 2, 1)
#: Words shared out, against all words; most copies of a source.
SHARE, COPIES = 1.5, 2
#: Schedule of each weight's sources: (time, rate), so that heavy sources come early and light ones late.
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))}
#: Rows that a bucket of a source's order is to hold, about.
BUCKET_ROWS = 20_000
#: Sources whose targets are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words; null: 0. Counts the starts of words, without making them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> dict[str | None, tuple[int, int, float]]:
    """{source: (weight, size, target)}. Sources by code point, null last; a target stops at `copies` times its size,
    the excess is shared again by weight until none is above."""
    rank = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(rank)}
    left, open_weight = share * sum(n for _, n in sizes), sum(weight.values())
    out, open_sources = {}, sorted(sizes, key=lambda x: x[1] / weight[x[0]])
    while open_sources and (left * weight[open_sources[0][0]]) / open_weight >= copies * open_sources[0][1]:
        s, n = open_sources.pop(0)
        out[s] = (weight[s], n, float(copies * n))
        left, open_weight = left - copies * n, open_weight - weight[s]
    for s, n in open_sources:
        out[s] = (weight[s], n, (left * weight[s]) / open_weight)
    return out


def segments(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """The normalised integral of a schedule: (share before, share after, start, length, rates' ratio end/start - 1)."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, out, before = sum(area), [], 0.0
    for (a, b), x in zip(zip(knots, knots[1:]), area):
        out.append((before / total, (before + x) / total, a[0], b[0] - a[0], a[1], b[1]))
        before += x
    return out


def invert(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the share `u` (0..1) of a schedule's integral is reached."""
    out = F.lit(float(knots[-1][0]))
    for lo, hi, start, length, r0, r1 in reversed(segments(knots)):
        if hi <= lo:
            continue
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u - lo) / (hi - lo))) * ((r0 + r1) / 2)  # r0 x + (r1 - r0) x^2 / 2
        x = part / r0 if r0 == r1 else (F.sqrt(F.lit(float(r0 * r0)) + part * (2.0 * (r1 - r0))) - r0) / (r1 - r0)
        out = F.when(u <= hi, F.lit(float(start)) + x * length).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, schedules: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, size, source, source_size, target, taken, position, positions.

    One row per row. taken: the words that the mix takes from the document, repeats counted; a source's taken words are
    its target rounded, the document at the border being taken in part. position: the time of its first copy, null if
    it is not taken; positions: those of all copies taken. Null text has size 0; documents of size 0 take nothing. Null
    sources are one source, the last. Equal rows share a place in the order in either way. A null doc_id is ordered as
    an empty one. An empty table gives an empty table; other columns are ignored. Only one row for each source passes
    through the driver, in jobs while the query is being built. `keep`: columns of `docs` that stay as they are.
    """
    schedules = schedules or SCHEDULES
    sized = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"), *keep)
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    goal = targets([(r["source"], r["size"]) for r in stats], weights, share, copies)
    rows = [(s, *goal[s]) for s in goal]
    info = docs.sparkSession.createDataFrame(rows, "_source string, _weight int, source_size long, target double")
    most = max((r["n"] for r in stats), default=0)
    digits = 1
    while 16**digits * BUCKET_ROWS < most * 4 and digits < 6:
        digits += 1
    digits = max(2, digits)
    bucketed = sized.withColumn("_bucket", F.substring("_key", 1, digits))
    sums = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    info = F.broadcast(info) if len(rows) <= BROADCAST_SOURCES else info
    base = base.join(info, base["_s"].eqNullSafe(info["_source"])).drop("_source")
    joined = bucketed.join(base, bucketed["source"].eqNullSafe(base["_s"]) & (bucketed["_bucket"] == base["_b"])).drop("_s", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("_at", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal_words = F.floor(F.col("target") + 0.5)
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), goal_words - F.col("_at") - F.col("source_size") * c)) for c in range(copies)]

    def when(c: int) -> Column:
        u = (F.col("_at") + F.col("source_size") * c) / F.col("target")
        out = F.lit(None).cast("double")
        for w in sorted(set(weights)):
            out = F.when(F.col("_weight") == w, invert(u, schedules[w])).otherwise(out)
        return F.when(takes[c] > 0, out)

    placed = placed.withColumns({f"_p{c}": when(c) for c in range(copies)} | {"taken": sum(takes[1:], takes[0]).cast("long")})
    return placed.select(
        "doc_id", "size", "source", "source_size", "target", "taken", F.col("_p0").alias("position"), F.array_compact(F.array(*[F.col(f"_p{c}") for c in range(copies)])).alias("positions"), *keep
    )


def positioned(docs: DataFrame, **options) -> DataFrame:
    """The rows of `mix` range-sorted by the position of their first copy; rows that are not taken come last."""
    mixed = materialize(mix(docs, **options), "mixed")  # a range sort samples its input first
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, a row for each copy, range-sorted by training position; the columns of `docs`.

    A document at a source's border is kept whole. Decisions name rows, by their files and places there, so that rows
    of equal or null doc_id each keep their own. `docs` that do not stand in files as they are, are written first.
    """
    docs = docs if _is_scan(docs) else materialize(docs, "unmixed")
    placed = docs.withColumns({"_mix_file": F.col("_metadata.file_path"), "_mix_place": F.col("_metadata.row_index")})
    taken = mix(placed, keep=("_mix_file", "_mix_place"), **options).filter("taken > 0").select("_mix_file", "_mix_place", F.explode("positions").alias("_position"))
    both = placed.join(taken, ["_mix_file", "_mix_place"])
    return both.repartitionByRange("_position", "_mix_file", "_mix_place").sortWithinPartitions("_position", "_mix_file", "_mix_place").select(*docs.columns)


def _is_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of files, so that each has a file and a place in it."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns and bool(docs.inputFiles())


#: The same in DuckDB's SQL, the three schedules' inverted integrals written out: 1.5 to 0.5; 1; 0.5 to 0.75 to 2.
ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS r FROM w),
c AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - 2 * coalesce(sum(source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS room,
  (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_weight FROM o),
e AS (SELECT *, (room * weight) / open_weight >= 2 * source_size AS full_up FROM c),
f AS (SELECT coalesce(min(r) FILTER (WHERE NOT full_up), 1 + max(r)) AS r FROM e),
t AS (SELECT source, source_size, weight, CASE WHEN e.r < f.r THEN (2 * source_size)::DOUBLE ELSE ((SELECT room FROM e JOIN f USING (r)) * weight) / (SELECT open_weight FROM e JOIN f USING (r)) END AS target FROM e, f),
p AS (SELECT d.doc_id, d.size, t.weight, t.source_size, t.target, floor(t.target + 0.5) AS goal,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, greatest(0, least(size, goal - at_word)) AS take_1, greatest(0, least(size, goal - at_word - source_size)) AS take_2,
  at_word::DOUBLE / target AS u_1, (at_word + source_size)::DOUBLE / target AS u_2 FROM p),
h AS (SELECT *,
  CASE weight WHEN 5 THEN 1.5e0 - sqrt(2.25e0 - 2e0 * u_1) WHEN 2 THEN u_1
    ELSE CASE WHEN u_1 <= 0.3125e0 THEN (sqrt(0.25e0 + u_1 / 0.3125e0 * 0.625e0 * 0.5e0) - 0.5e0) / 0.25e0 * 0.5e0
      ELSE 0.5e0 + (sqrt(0.5625e0 + (u_1 - 0.3125e0) / 0.6875e0 * 1.375e0 * 2.5e0) - 0.75e0) / 1.25e0 * 0.5e0 END END AS p_1,
  CASE weight WHEN 5 THEN 1.5e0 - sqrt(2.25e0 - 2e0 * u_2) WHEN 2 THEN u_2
    ELSE CASE WHEN u_2 <= 0.3125e0 THEN (sqrt(0.25e0 + u_2 / 0.3125e0 * 0.625e0 * 0.5e0) - 0.5e0) / 0.25e0 * 0.5e0
      ELSE 0.5e0 + (sqrt(0.5625e0 + (u_2 - 0.3125e0) / 0.6875e0 * 1.375e0 * 2.5e0) - 0.75e0) / 1.25e0 * 0.5e0 END END AS p_2
  FROM (SELECT * EXCLUDE (u_1, u_2), CASE WHEN take_1 > 0 THEN u_1 END AS u_1, CASE WHEN take_2 > 0 THEN u_2 END AS u_2 FROM g))
SELECT doc_id, size, source_size, target, (take_1 + take_2)::BIGINT AS taken, p_1 AS position, p_2 AS repeat_position FROM h
"""
