"""Rank fusion, context and the question pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from . import fulltext, relational, vector

K = 60


def fuse(vec: DataFrame, fts: DataFrame, graph: DataFrame | None, scores: DataFrame, weights=(0.5, 0.3, 0.2, 0.1), limit: int | None = None) -> DataFrame:
    """RET-01, WIN-01, AGG-18, TOPK-03: vec(fact_id, score), fts(fact_id, score), graph(fact_id, distance),
    scores(fact_id, user_score) -> (fact_id, score). The lists are top-k's, so one window each is bounded by k."""
    wv, wg, wf, wu = weights
    place = lambda d: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(d["score"]), d["fact_id"]))
    parts = vec.select("fact_id", (wv * F.col("score") + (1 - wv) / (K + place(vec))).alias("part"))
    parts = parts.union(fts.select("fact_id", (wf / (K + place(fts))).alias("part")))
    if graph is not None:
        parts = parts.union(graph.filter("fact_id IS NOT NULL AND fact_id <> 0").select("fact_id", (wg / (1.0 + F.col("distance"))).alias("part")))
    total = parts.groupBy("fact_id").agg(F.sum("part").alias("total")).join(scores.select("fact_id", "user_score"), "fact_id", "left")
    user = F.when((F.col("user_score") != 1.0) & F.col("user_score").isNotNull(), wu * F.log(F.greatest("user_score", F.lit(0.01)))).otherwise(0.0)
    out = total.select("fact_id", (F.col("total") + user).alias("score")).orderBy(F.desc("score"), "fact_id")
    return out.limit(limit) if limit else out


def context(hydrated: DataFrame, most: int = 8) -> DataFrame:
    """RET-03: one block of text of the best facts: title or triple, file, evidence, and the description if there is one."""
    best = hydrated.orderBy(F.desc("score"), "fact_id").limit(most)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = F.when(blank("title") != "", F.col("title")).otherwise(F.concat_ws(" ", "subject", "predicate", "object"))
    lines = [F.format_string("[Fact %d] %s\n", "fact_id", title), F.concat(F.lit("  Source: "), blank("path"), F.lit("\n")), F.concat(F.lit("  Evidence: "), blank("evidence_span"), F.lit("\n"))]
    told = F.concat(*lines, F.when(blank("description") != "", F.concat(F.lit("  Description: "), F.col("description"), F.lit("\n"))).otherwise(""))
    ranked = best.select(F.struct((-F.col("score")).alias("s"), "fact_id", told.alias("l")).alias("x"))
    return ranked.agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").alias("context"))


def seeds(hydrated: DataFrame, most: int = 5) -> DataFrame:
    """RET-04: subjects and objects of the ranked facts, by the best fact's score, then name."""
    each = hydrated.select("score", F.explode(F.array("subject", "object")).alias("name"))
    return each.groupBy("name").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "name").limit(most)


def related(hydrated: DataFrame, most: int = 10) -> DataFrame:
    """RET-05."""
    return hydrated.select("fact_id", "subject", "predicate", "object", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "fact_id").limit(most)


def sources(hydrated: DataFrame) -> DataFrame:
    """AGG-19."""
    return hydrated.groupBy("path").agg(F.sort_array(F.collect_list("fact_id")).alias("facts"))


def boost(facts: DataFrame, topics: list[str]) -> DataFrame:
    """RET-06, SET-05: 1 + 0.05 for each preferred topic in the fact, at most 2."""
    words = F.split(F.lower(F.concat_ws(" ", "subject", "predicate", "object")), r"\s+")
    shared = F.size(F.array_intersect(words, F.array(*[F.lit(t.lower()) for t in topics]).cast("array<string>")))
    return facts.withColumn("boost", F.least(F.lit(2.0), 1.0 + 0.05 * shared))


def near_facts(edges: DataFrame, names: DataFrame) -> DataFrame:
    """GR-04 for several entities: the facts of their edges, at distance 1, for the graph's list of the fusion."""
    ends = edges.select("fact_id", F.explode(F.array("src", "dst")).alias("name"))
    return ends.join(F.broadcast(names.select("name")), "name", "left_semi").select("fact_id").distinct().withColumn("distance", F.lit(1))


def with_history(question: str, history: list[dict], most: int = 6) -> str:
    """RET-07: the last messages (role, content) before the question."""
    told = [f"{m['role']}: {m['content']}" for m in history[-most:]]
    return "\n".join([*told, question])


def ask(
    question: str, facts: DataFrame, files: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]], answer: Callable[[str, str], str] | None = None,
    top_k: int = 20, fts_k: int = 10, edges: DataFrame | None = None, history: list[dict] | None = None,
) -> dict:
    """RET-02, RET-07: the question pipeline. Vectors and full text find facts, the graph adds those around their entities
    if `edges` are given, and the fused best are the context. Only the bounded top rows reach the driver."""
    if not question.strip():
        return {"answer": "Please enter a question.", "sources": [], "related": [], "count": 0}
    vec = materialize(vector.search(vectors, embed([question])[0], 2 * top_k), "vec")
    fts = materialize(fulltext.search(facts, "id", question, fts_k).withColumnRenamed("id", "fact_id"), "fts")
    ranked = vec.select("fact_id").union(fts.select("fact_id"))

    def best(graph: DataFrame | None) -> DataFrame:
        """The fused best with their facts, written; of all facts, only those in the lists are joined."""
        ids = (ranked if graph is None else ranked.union(graph.select("fact_id"))).select(F.col("fact_id").alias("id")).distinct()
        own = materialize(facts.join(ids, "id", "left_semi"), "own")
        scores = own.select(F.col("id").alias("fact_id"), "user_score")
        return materialize(relational.hydrate(fuse(vec, fts, graph, scores, limit=30), own, files), "best")

    if edges is None:
        rows = best(None)
    else:
        around = seeds(best(None)).select("name").filter("name IS NOT NULL")
        names = [r["name"] for r in around.collect()]
        rows = best(materialize(near_facts(edges.filter(F.col("src").isin(names) | F.col("dst").isin(names)), around), "near"))
    text = context(rows).first()["context"]
    if not text:
        return {"answer": "The knowledge base does not contain information about this.", "sources": [], "related": [], "count": 0}
    found = related(rows).collect()
    said = answer(with_history(question, history or []), text) if answer else text
    return {"answer": said, "sources": [r.asDict() for r in sources(rows).collect()], "related": [r.asDict() for r in found], "count": len(found)}
