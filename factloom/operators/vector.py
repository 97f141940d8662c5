"""Vectors: exact search, similarity, near-duplicate facts, embedding."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.runtime import materialize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def search(vectors: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    """VEC-01, TOPK-01: the k highest inner products; each task keeps its own k (TakeOrderedAndProject)."""
    same = vectors.filter(F.size("embedding") == len(query))
    q = F.array(*[F.lit(float(x)) for x in query])
    return same.select("fact_id", dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "fact_id").limit(k)


def of_dimension(vectors: DataFrame, dimension: int) -> DataFrame:
    """VEC-02."""
    return vectors.filter(F.size("embedding") == dimension)


def without(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """VEC-03."""
    return vectors.join(ids.select("fact_id").distinct(), "fact_id", "left_anti")


#: Vectors of a tile of the pair matrix.
TILE = 512


def search_for(vectors: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """VEC-01 for the one row (embedding) of `query`, in one job: the row is crossed in, a single row on one side."""
    one = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))
    met = vectors.crossJoin(one).filter(F.size("embedding") == F.size("_q"))
    return met.select("fact_id", dot(F.col("embedding"), F.col("_q")).alias("score")).orderBy(F.desc("score"), "fact_id").limit(k)


def similar_pairs(vectors: DataFrame, threshold: float, block: str | None = None, strict: bool = True) -> DataFrame:
    """VEC-04, JOIN-12: (a, b, cosine), a < b, above a cosine (or at it, if not `strict`), within a batch key if there is
    one, of vectors of one length.

    The rows of a block are dealt into tiles of about `TILE` rows, and each pair of tiles is one task's matrix product, so
    no task holds more than two tiles, however large a block is.
    """
    own = vectors.select("fact_id", (F.col(block) if block else F.lit(0)).alias("_b"), "embedding").filter("embedding IS NOT NULL AND fact_id IS NOT NULL")
    own = own.withColumn("_d", F.size("embedding"))
    tiles = own.groupBy("_b", "_d").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_t"))
    dealt = own.join(tiles, ["_b", "_d"]).withColumn("_i", F.pmod(F.xxhash64("fact_id"), F.col("_t")).cast("int"))
    sent = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    sent = sent.select("_b", "_d", F.least("_i", "_j").alias("_x"), F.greatest("_i", "_j").alias("_y"), (F.col("_i") > F.col("_j")).alias("_right"), "fact_id", "embedding")

    def product(g: pd.DataFrame) -> pd.DataFrame:
        v = np.array(g["embedding"].tolist(), np.float64).reshape(len(g), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v, ids = np.divide(v, n, out=v, where=n > 0), g["fact_id"].to_numpy()
        one = g["_x"].iloc[0] == g["_y"].iloc[0]
        left = np.ones(len(g), bool) if one else ~g["_right"].to_numpy(bool)
        right = left if one else ~left
        cos = v[left] @ v[right].T
        hit = (cos > threshold if strict else cos >= threshold) & ((ids[left][:, None] < ids[right][None, :]) if one else (ids[left][:, None] != ids[right][None, :]))
        i, j = np.nonzero(hit)
        p, q = ids[left][i], ids[right][j]
        return pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "cosine": cos[i, j]})

    return sent.groupBy("_b", "_d", "_x", "_y").applyInPandas(product, "a long, b long, cosine double")


#: Links of a component that one task decides.
PART = 20_000


def greedy(links: list[tuple], confidence: dict) -> set:
    """VEC-05 by its rule: links (a, b), a < b -> the facts that go. In order, a fact that still stands drops each later one that
    is near, still stands and is no more confident; the first more confident one drops it instead, and ends its turn."""
    near: dict = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    gone: set = set()
    for a in sorted(near):
        if a in gone:
            continue
        for b in sorted(near[a]):
            if b in gone:
                continue
            if confidence[b] > confidence[a]:
                gone.add(a)
                break
            gone.add(b)
    return gone


def _decided(links: DataFrame, by: str) -> DataFrame:
    """(fact_id) of the facts that go: one sequential run of the rule for each `by`."""

    def decide(g: pd.DataFrame) -> pd.DataFrame:
        confidence = dict(zip(g["a"], g["ca"])) | dict(zip(g["b"], g["cb"]))
        return pd.DataFrame({"fact_id": sorted(greedy(list(zip(g["a"], g["b"])), confidence))}, dtype="int64")

    return links.groupBy(by).applyInPandas(decide, "fact_id long")


def _without_ends(links: DataFrame, ids: DataFrame) -> DataFrame:
    for end in "ab":
        links = links.join(ids.select(F.col("fact_id").alias(end)), end, "left_anti")
    return links


def _round(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids that go, ids whose turn is over): the turns of all facts that are first among those up to two links away.

    No two of these have a neighbour in common, and nothing before them is open, so their turns are the rule's.
    """
    both = links.select("a", "b", "ca", "cb").union(links.select("b", "a", "cb", "ca"))
    first = both.groupBy("a").agg(F.min("b").alias("_b")).select("a", F.least("a", "_b").alias("m"))
    around = both.join(first.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m")).filter("a <= m").select("a")
    turn = both.join(around, "a").groupBy("a").agg(F.min(F.when(F.col("cb") > F.col("ca"), F.col("b"))).alias("stop"))
    turn = materialize(turn, "turns")
    dropped = both.join(turn, "a").filter(F.col("stop").isNull() | (F.col("b") < F.col("stop"))).select(F.col("b").alias("fact_id"))
    gone = dropped.union(turn.filter("stop IS NOT NULL").select(F.col("a").alias("fact_id"))).distinct()
    return materialize(gone, "gone"), turn.select(F.col("a").alias("fact_id"))


def dropped_facts(links: DataFrame) -> DataFrame:
    """VEC-05: links (a, b, ca, cb), a < b, of near facts with their confidences -> (fact_id) of those that go by the rule `greedy`.

    Decisions interact along links only. Components of at most `PART` links are decided by one task each. Of larger ones, the
    links of the first facts, about `PART` of them, go to one task a round, as their turns depend on nothing later; then
    all facts that are first within two links have their turn at once. What is decided leaves the graph.
    """
    lost = []
    while True:
        links = materialize(links, "links")
        comp = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        named = materialize(links.join(comp.select(F.col("node").alias("a"), "component"), "a"), "named")
        sizes = materialize(named.groupBy("component").agg(F.count("*").alias("n")), "sizes")
        small = named.join(sizes.filter(F.col("n") <= PART).select("component"), "component", "left_semi")
        lost.append(materialize(_decided(small, "component"), "lost"))
        large = named.join(sizes.filter(F.col("n") > PART).select("component", "n"), "component")
        if not large.limit(1).count():
            return reduce(DataFrame.union, lost)
        large = materialize(large, "large")
        # The first facts of each large component: links by a, up to PART of them; a fact's links stay together.
        degree = large.groupBy("component", "a").agg(F.count("*").alias("d"))
        least = degree.withColumn("_i", F.row_number().over(Window.partitionBy("component").orderBy("a"))).filter(F.col("_i") <= PART)
        upto = F.sum("d").over(Window.partitionBy("component").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
        head = materialize(least.withColumn("_upto", F.coalesce(upto, F.lit(0))).filter(F.col("_upto") + F.col("d") <= PART).select("component", "a"), "head")
        gone = materialize(_decided(large.join(head, ["component", "a"], "left_semi"), "component"), "lost")
        lost.append(gone)
        done = head.select(F.col("a").alias("fact_id"))
        rest = materialize(_without_ends(large.select("a", "b", "ca", "cb"), gone.union(done)), "rest")
        gone, done = _round(rest)
        lost.append(gone)
        links = _without_ends(rest, gone.union(done))


def near_dedup(facts: DataFrame, threshold: float = 0.9, block: str | None = None) -> DataFrame:
    """VEC-05: facts (fact_id, confidence, embedding) without near duplicates, by the order of their ids."""
    pairs = similar_pairs(facts, threshold, block).select("a", "b")
    for end in "ab":
        pairs = pairs.join(facts.select(F.col("fact_id").alias(end), F.col("confidence").alias(f"c{end}")), end)
    return facts.join(dropped_facts(pairs.select("a", "b", "ca", "cb")), "fact_id", "left_anti")


def embedding_text(title: Column, subject: Column, predicate: Column, obj: Column, description: Column) -> Column:
    """VEC-06."""
    return F.concat_ws("\n", title, F.concat_ws(" ", subject, predicate, obj), F.when(description != "", description))


def hash_embedder(dimension: int = 64):
    """VEC-07's default: a deterministic hashing embedder, normalised; any function texts -> vectors can stand in."""

    def rows(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).astype(np.float32)

    def embed(texts: list[str]) -> list[list[float]]:
        return rows(texts).tolist()

    embed.rows = rows  # the same without a Python number for each component
    return embed


def embed(df: DataFrame, column: str, embedder=None, batch: int = 32) -> DataFrame:
    """VEC-07, VEC-08: an embedding for each row's text, in batches."""
    fn = embedder or hash_embedder()
    fn = getattr(fn, "rows", fn)

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        rows = s.tolist()
        return pd.Series([v for i in range(0, len(rows), batch) for v in fn(rows[i : i + batch])])

    return df.withColumn("embedding", run(F.col(column)))
