"""Entity quality, resolution and feedback."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.runtime import materialize
from ..sources.files import IMAGES, suffix
from . import graph, relational, updates, vector

#: The range of user scores.
LEAST, MOST = 0.0, 2.0


def _traits(names: DataFrame) -> DataFrame:
    """What the long rules say of a name, as columns. A filter on flags would ask them once more, so they stand below a join."""
    c = F.col("name")
    rules = {"score": text.gibberish_of(c), "_numeric": text.numeric_dominant(c), "_code": text.code_like(c), "_date": text.date_like(c)}
    return names.withColumns(rules)


def flags(name: Column, degree: Column, sources: Column, ocr: Column, images: Column, word: Column | None = None) -> Column:
    """QA-01: what is suspicious about an entity with its `_traits`, as an array. `word`: whether its Chinese parts make words, if
    that is known."""
    n = F.length(name)
    tests = (
        ("too_short", n <= 1),
        ("too_long", n > 15),
        ("gibberish", F.col("score") >= 0.3),
        ("not_a_word", F.lit(False) if word is None else name.rlike(text.CJK_NAME) & ~word),
        ("isolated", degree == 0),
        ("ocr_only", (ocr > 0) & (ocr == sources)),
        ("image_source", (sources > 0) & (images == sources)),
        ("numeric_dominant", F.col("_numeric")),
        ("looks_like_code", F.col("_code")),
        ("looks_like_date", F.col("_date")),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(f)) for f, t in tests]))


def check(entities: DataFrame, segment: Callable[[str], list[str]] | None = None) -> DataFrame:
    """QA-01: entities(name, degree, sources, ocr, images) with flags, score and verdict: suspect with two flags or more.
    `segment` cuts Chinese names into words; without it all of them pass."""
    word = text.word_check(segment)(F.col("name")) if segment else None
    own = [F.col(c) for c in ("name", "degree", "sources", "ocr", "images")]
    known = entities if "score" in entities.columns else _traits(entities)
    out = known.withColumn("flags", flags(*own, word)).drop("_numeric", "_code", "_date")
    return out.withColumn("suspect", F.size("flags") >= 2)


def scan(entities: DataFrame) -> DataFrame:
    """QA-02, TOPK-07: suspects only, most flags first."""
    return check(entities).filter("suspect").orderBy(F.desc(F.size("flags")), F.desc("score"), "name")


def flag_stats(checked: DataFrame) -> DataFrame:
    """AGG-09."""
    return relational.count_by(checked.select(F.explode("flags").alias("flag")), "flag")


def entity_table(facts: DataFrame, files: DataFrame) -> DataFrame:
    """QA-03: name, degree, and the numbers of its files, of those read by OCR and of images among them, with its traits."""
    live = graph.live_facts(facts)
    deg = graph.degrees(live.filter("NOT literal").select(F.col("subject").alias("src"), F.col("object").alias("dst")).distinct())
    named = live.select("file_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
    known = files.select(F.col("id").alias("file_id"), F.col("error_msg").ilike("%OCR%").alias("o"), suffix(F.col("path")).isin(*IMAGES).alias("i"))
    src = named.join(known, "file_id").groupBy("name").agg(F.count("*").alias("sources"), F.count_if("o").alias("ocr"), F.count_if("i").alias("images"))
    return _traits(graph.nodes_of(live)).join(deg, "name", "left").join(src, "name", "left").fillna(0, ["degree", "sources", "ocr", "images"])


def suspect_proposals(facts: DataFrame, files: DataFrame, proposals: DataFrame) -> DataFrame:
    """QA-03, FLT-17: suspects with no suspect proposal of any status; confidence is 1 less the score."""
    found = relational.not_proposed(check(entity_table(facts, files)).filter("suspect"), proposals)
    return found.select(F.col("name").alias("entity_a"), F.round(1 - F.col("score"), 4).alias("confidence"), F.to_json(F.struct("flags")).alias("llm_response"), F.lit("proposed").alias("status"), F.lit("suspect").alias("proposal_type"))


#: Names that meet all others at a time: as many at first, four times as many from block to block, and blocks before tiles
#: take the rest. The last block's vectors are what is sent to each task.
HEADS, BLOCKS = 64, 4


def _met(names: DataFrame, heads: list, least: float) -> DataFrame:
    """(entity_a, entity_b, similarity) of each head with the names behind it: their vectors' cosine, for vectors of one length."""
    groups: dict[int, list] = {}
    for h in heads:
        groups.setdefault(len(h["embedding"]), []).append(h)
    tables = {n: ([h["name"] for h in g], _unit(np.array([h["embedding"] for h in g], np.float64).reshape(len(g), n))) for n, g in groups.items()}
    sent = names.sparkSession.sparkContext.broadcast(tables)

    def product(batches):
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            own, column = batch.column(0).to_pylist(), batch.column(1)
            starts = column.offsets.to_numpy()
            values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(starts)
            of = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
            out = ([], [], [])
            for n, rows in of.items():
                if n not in sent.value:
                    continue
                firsts, table = sent.value[n]
                cosine = _unit(values[starts[rows][:, None] + np.arange(n)].astype(np.float64)) @ table.T
                for i, j in zip(*np.nonzero(cosine >= least)):
                    if firsts[j].encode() < own[rows[i]].encode():
                        for made, value in zip(out, (firsts[j], own[rows[i]], float(cosine[i, j]))):
                            made.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["entity_a", "entity_b", "similarity"])

    return names.mapInArrow(product, "entity_a string, entity_b string, similarity double")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0)


def merge_candidates(entities: DataFrame, similarity: float = 0.8, string_least: float = 0.4, most: int | None = 100) -> DataFrame:
    """ER-01, JOIN-11, SET-07, TOPK-08: entities(name, embedding) -> (entity_a, entity_b, similarity), the most similar first.

    The first `most` pairs by name are the feature's own cap, so names are taken in their order, a block of them against
    all behind, and no more than are needed to reach it: mostly one block, and then the work grows with the names, not with
    their pairs. Without a cap, and behind `BLOCKS` blocks, pairs come tile by tile. Strings are compared last.
    """
    own = entities.filter(~text.numeric_dominant(F.col("name")) & ~text.code_like(F.col("name")) & (text.gibberish(F.col("name")) < 0.5))
    # Names are written without their vectors, which may be made anew for each block: mostly there is one.
    names = materialize(own.select("name").distinct(), "names")
    named = lambda d: entities.join(d.select("name"), "name", "left_semi").select("name", "embedding")
    like = text.string_similarity(F.col("entity_a"), F.col("entity_b")) >= string_least
    found, n, last, size = [], 0, None, HEADS
    for _ in range(BLOCKS if most else 0):
        rest = names if last is None else names.filter(F.col("name") > last)
        first = [r["name"] for r in rest.orderBy("name").limit(size).collect()]
        if not first:
            break
        heads = entities.filter(F.col("name").isin(first)).select("name", "embedding").dropDuplicates(["name"]).collect()
        heads = [h for h in heads if h["embedding"] is not None]
        met = _met(named(rest), heads, similarity).filter(like).groupBy("entity_a", "entity_b").agg(F.max("similarity").alias("similarity"))
        met = materialize(met.orderBy("entity_a", "entity_b").limit(most - n), "met")
        found.append(met)
        n, last, size = n + met.count(), first[-1], 4 * size
        if n >= most:
            break
    else:
        rest = named(names if last is None else names.filter(F.col("name") > last)).dropDuplicates(["name"])
        rest = materialize(rest.withColumn("fact_id", F.xxhash64("name")), "named").filter("embedding IS NOT NULL")
        pairs = vector.similar_pairs(rest, similarity, strict=False)
        of = lambda p: rest.select(F.col("fact_id").alias(p), F.col("name").alias(f"n{p}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("na", "nb").alias("entity_a"), F.greatest("na", "nb").alias("entity_b"), F.col("cosine").alias("similarity"))
        found.append(both.filter(like))
    out = reduce(DataFrame.union, found) if found else names.select(F.col("name").alias("entity_a"), F.col("name").alias("entity_b"), F.lit(0.0).alias("similarity")).limit(0)
    if most:
        out = out.orderBy("entity_a", "entity_b").limit(most)
    return out.orderBy(F.desc("similarity"), "entity_a", "entity_b")


def triage(pairs: DataFrame, auto: float = 0.85, judge: Callable[[list[tuple[str, str]]], list[bool]] | None = None) -> DataFrame:
    """ER-02: sure pairs are approved; the rest go to the judge in one batch (pairs are capped), a failure proposes them."""
    named = pairs.withColumn("canonical", text.canonical_name(F.col("entity_a"), F.col("entity_b")))
    sure = named.filter(F.col("similarity") >= auto).withColumn("status", F.lit("auto_approved"))
    open_pairs = named.filter(F.col("similarity") < auto)
    if judge is None:
        return sure.union(open_pairs.withColumn("status", F.lit("proposed")))
    rows = open_pairs.orderBy("entity_a", "entity_b").collect()
    try:
        said = judge([(r["entity_a"], r["entity_b"]) for r in rows])
        status = ["approved" if s else "rejected" for s in said]
    except Exception:  # noqa: BLE001  a judge may fail in any way
        status = ["proposed"] * len(rows)
    told = pairs.sparkSession.createDataFrame([(*r, s) for r, s in zip(rows, status)], sure.schema) if rows else sure.limit(0)
    return sure.union(told)


def in_order(merges: list[tuple[str, str]]) -> dict[str, str]:
    """What each name is called after renames (old, new) one after another; names that keep theirs are left out."""
    now: dict[str, str] = {}
    called: dict[str, set[str]] = {}  # name: those that have come to be called so
    for old, new in merges:
        if old == new:
            continue
        group = called.pop(old, set()) | (set() if old in now else {old})
        now |= dict.fromkeys(group, new)
        called.setdefault(new, set()).update(group)
    return {a: b for a, b in now.items() if a != b}


def apply_merges(facts: DataFrame, triaged: DataFrame) -> DataFrame:
    """ER-03: facts of any status after the auto-approved merges, one after another, the most similar first: the other name of a
    pair becomes the canonical one. As many merges reach the driver as there are candidates, which are capped."""
    rows = triaged.filter("status = 'auto_approved'").orderBy(F.desc("similarity"), "entity_a", "entity_b").collect()
    names = in_order([(r["entity_b"] if r["canonical"] == r["entity_a"] else r["entity_a"], r["canonical"]) for r in rows])
    return updates.map_names(facts, names)


def allocate(cited: DataFrame, total: float, mode: str = "relevance", by: str | None = None, order: str = "fact_id") -> DataFrame:
    """FB-01, WIN-04: cited(fact_id, similarity_score) with its delta: equal shares, or proportional ones rounded to 4
    places, the last row by `order` taking the rest. A missing score counts as 1. `by`: the answer that cites the rows;
    without it all of them are one answer's, which is a short list."""
    part = Window.partitionBy(by or F.lit(0))
    every, before = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), part.orderBy(order, "fact_id")
    n = F.count("*").over(every)
    if mode == "uniform":
        return cited.withColumn("delta", F.lit(float(total)) / n)
    signal = F.coalesce("similarity_score", F.lit(1.0))
    s = F.sum(signal).over(every)
    share = F.floor(abs(total) * signal / F.when(s == 0, F.lit(1.0)).otherwise(s) * 10000 + 0.5) / 10000  # halves go up
    given = cited.withColumns({"_share": share, "_n": n, "_i": F.row_number().over(before)})
    used = F.coalesce(F.sum("_share").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sign = 1.0 if total > 0 else -1.0
    return given.withColumn("delta", sign * F.when(F.col("_i") == F.col("_n"), abs(total) - used).otherwise(F.col("_share"))).drop("_share", "_n", "_i")


def _composed(batches):
    """Sorted votes (fact_id, at, delta) -> for each fact's stretch of a batch the function that its votes make together:
    a score s becomes least(high, greatest(low, s + add)). Votes are such functions, and so is one after another."""
    for batch in batches:
        ids, at, deltas = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, int)
        out = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            votes, low, high = deltas[a:b].tolist(), LEAST, MOST  # from any score, the first vote leads between these
            for d in votes[1:]:
                low, high = min(MOST, max(LEAST, low + d)), min(MOST, max(LEAST, high + d))
            out.append((sum(votes), low, high))
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(ids[starts], pa.int64()), pa.array(at[starts], pa.int64()), *[pa.array(c, pa.float64()) for c in columns]], names=["fact_id", "at", "add", "low", "high"])


def fold_votes(votes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """FB-02, STM-03: votes(fact_id, seq, delta) folded in order, held to 0..2 after each; votes without a fact or a delta are left out.

    Votes are dealt by ranges of fact and order, so that a fact of very many votes is split; each batch of sorted votes
    becomes a function a fact, and only these meet, in order, and are applied to the score.
    """
    by = ["fact_id", "seq", "delta"]
    own = votes.select(F.col("fact_id").cast("long"), "seq", F.col("delta").cast("double")).dropna(subset=["fact_id", "delta"])
    dealt = own.repartitionByRange(*by).sortWithinPartitions(*by).select("fact_id", F.monotonically_increasing_id().alias("at"), "delta")
    parts = dealt.mapInArrow(_composed, "fact_id long, at long, add double, low double, high double")
    each, s0 = parts.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("at", "add", "low", "high"))).alias("v")), F.lit(1.0)
    if start is not None:
        each, s0 = each.join(start.select("fact_id", F.col("user_score").alias("_s")), "fact_id", "left"), F.coalesce("_s", F.lit(1.0))
    return each.select("fact_id", F.aggregate("v", s0, lambda s, f: F.least(f["high"], F.greatest(f["low"], s + f["add"]))).alias("user_score"))


def apply_feedback(facts: DataFrame, cited: DataFrame, kind: str, delta: float = 0.1) -> DataFrame:
    """FB-02: one vote, split over the cited facts."""
    if kind not in ("positive", "negative"):
        raise ValueError("feedback is positive or negative")
    given = allocate(cited, delta if kind == "positive" else -delta).select(F.col("fact_id").alias("id"), "delta")
    return facts.join(given, "id", "left").withColumn("user_score", F.when(F.col("delta").isNull(), F.col("user_score")).otherwise(updates.clamp(F.col("user_score"), F.col("delta")))).drop("delta")
