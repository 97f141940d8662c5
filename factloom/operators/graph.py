"""The entity graph: building, expanding and merging as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.runtime import materialize
from .updates import latest


def live_facts(facts: DataFrame) -> DataFrame:
    """The active facts' columns that graphs are made of, with `literal`: whether the object is one. The rows are dealt to all
    tasks before the literal rules, which are long, and written, so that these are asked once a fact, whoever reads on."""
    own = [c for c in ("id", "file_id", "subject", "predicate", "object", "confidence") if c in facts.columns]
    live = facts.filter("status = 'active'").select(*own).repartition("id" if "id" in own else "subject")
    return materialize(live.withColumn("literal", text.is_literal(F.col("object"))), "live")


def build_edges(facts: DataFrame, multi: bool = False) -> DataFrame:
    """GR-01, GR-02, WIN-03: edges of active facts whose object is no literal; the last fact of a pair wins."""
    live = live_facts(facts).filter("NOT literal")
    e = live.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", F.col("id").alias("fact_id"), "confidence")
    return e if multi else latest(e, ["src", "dst"], "fact_id")


def build_properties(facts: DataFrame) -> DataFrame:
    """GR-01, AGG-12, MAP-01: literal objects as a subject's properties."""
    live = facts.filter("status = 'active'").filter(text.is_literal(F.col("object")))
    each = live.groupBy("subject", "predicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "object"))), lambda x: x["object"]).alias("values"))
    return each.groupBy(F.col("subject").alias("name")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "values")))).alias("properties"))


def degrees(edges: DataFrame) -> DataFrame:
    """AGG-11: in and out; a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def nodes(facts: DataFrame) -> DataFrame:
    """GR-06: every subject, and objects that are no literals."""
    return nodes_of(live_facts(facts))


def nodes_of(live: DataFrame) -> DataFrame:
    """GR-06 of `live_facts`."""
    return live.select(F.col("subject").alias("name")).union(live.filter("NOT literal").select("object")).distinct()


def search_nodes(edges: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """FLT-19, TOPK-06."""
    return degrees(edges).filter(F.lower("name").contains(query.lower())).orderBy(F.desc("degree"), "name").limit(limit)


def expand(edges: DataFrame, entity: str, hops: int = 1, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """GR-03, JOIN-16, JOIN-17: nodes within so many hops either way, with global degrees, and the edges among them.

    The frontier is a join for each hop; the cap keeps the nearest nodes, then by name, so the visited set is bounded by
    `most` after each hop.
    """
    return _expand(materialize(edges, "edges"), entity, hops, most)  # each hop reads them again


def _expand(edges: DataFrame, entity: str, hops: int, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """`expand` over edges that are written."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    seen = spark.createDataFrame([(entity, 0)], "name string, depth int").join(both.select(F.col("src").alias("name")).distinct(), "name", "left_semi")
    for h in range(1, hops + 1):
        front = seen.filter(F.col("depth") == h - 1)
        near = both.join(front, both["src"] == front["name"]).select(F.col("dst").alias("name")).distinct()
        seen = seen.union(near.join(seen, "name", "left_anti").withColumn("depth", F.lit(h)))
        seen = materialize(seen.orderBy("depth", "name").limit(most), "visited")
    found = seen.join(degrees(edges), "name", "left").fillna(0, ["degree"])
    own = edges.join(seen.select(F.col("name").alias("src")), "src", "left_semi").join(seen.select(F.col("name").alias("dst")), "dst", "left_semi")
    return found, own


def neighbours(edges: DataFrame, entity: str) -> DataFrame:
    """GR-04: direct neighbours with their direction."""
    out = edges.filter(F.col("src") == entity).select(F.col("dst").alias("name"), "predicate", F.lit("out").alias("direction"))
    return out.union(edges.filter(F.col("dst") == entity).select("src", "predicate", F.lit("in")))


def merge_nodes(edges: DataFrame, old: str, new: str) -> DataFrame:
    """GR-05: edges of a node rewired to another; an edge that is there stays, self-loops made by it go."""
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c))
    moved = edges.withColumns({"_old": (F.col("src") == old) | (F.col("dst") == old), "_s": to("src"), "_d": to("dst")})
    w = Window.partitionBy("_s", "_d").orderBy("_old", "fact_id")
    kept = moved.filter(~(F.col("_old") & (F.col("_s") == F.col("_d")))).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    return kept.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "predicate", "fact_id", "confidence")


def rewired(edges: DataFrame, old: str) -> DataFrame:
    """GR-05: how many edges `merge_nodes` takes from the old node."""
    return edges.filter((F.col("src") == old) | (F.col("dst") == old)).agg(F.count("*").alias("n"))


def explore(edges: DataFrame, query: str, hops: int = 1) -> tuple[DataFrame, DataFrame] | None:
    """GR-07: the shortest of the ten best matches, expanded by 1..3 hops. Edges are built once, for both."""
    edges = materialize(edges, "edges")
    best = search_nodes(edges, query, 10).orderBy(F.length("name"), "name").first()
    return _expand(edges, best["name"], max(1, min(3, hops))) if best else None


def dot(edges: DataFrame) -> DataFrame:
    """GR-08: edges as lines of DOT."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "predicate").alias("line"))
