"""A stored graph: each edge under both of its ends, bucketed by node, so that a question reads its frontier's buckets only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from ..plans.segments import Segments, bucket
from . import graph

BUCKETS = 64
_EDGES = "node string, src string, dst string, predicate string, fact_id long, confidence int, bucket int"


class StoredGraph:
    """GR-01, GR-02, GR-03 over a folder. A change adds a segment: the edges of facts put in, the ids of facts taken out.

    All edges of all facts are kept; which of those from one node to another counts, the one of the latest fact, is decided
    where they are read, so that an older fact's edge is back when the latest fact is taken out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Segments(spark, path)

    def change(self, put: DataFrame | None = None, taken: DataFrame | None = None, literals: bool = False) -> None:
        """Puts in the edges of active facts and takes out those of the facts taken(id). `literals`: keep literal objects as nodes too."""
        at = self.files.new()
        if put is not None:
            live = graph.live_facts(put)
            live = live if literals else live.filter("NOT literal")
            own = live.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", F.col("id").alias("fact_id"), F.col("confidence").cast("int").alias("confidence"))
            ends = own.withColumn("node", F.explode(F.array_distinct(F.array("src", "dst"))))
            self.files.write(ends.withColumn("bucket", bucket("node", BUCKETS)).select(*[c.split()[0] for c in _EDGES.split(", ")]), f"{at}/edges", "node", "fact_id")
        if taken is not None:
            taken.select(F.col("id").cast("long").alias("fact_id")).write.parquet(f"{at}/taken")
        self.files.commit([*self.files.segments(), {"path": at, "put": put is not None, "taken": taken is not None}])

    def merge(self) -> None:
        """One segment of all; edges of facts that were taken out are no longer stored."""
        at = self.files.new()
        self.files.write(self._rows(None), f"{at}/edges", "node", "fact_id")
        self.files.commit([{"path": at, "put": True, "taken": False}])

    def _rows(self, nodes: list[str] | None) -> DataFrame:
        """The stored rows under some nodes, or all, without those of facts that a later change took out."""
        old = self.files.segments()
        parts = [self.spark.read.schema(_EDGES).parquet(f"{s['path']}/edges").withColumn("seg", F.lit(i)) for i, s in enumerate(old) if s["put"]]
        if not parts:
            return self.spark.createDataFrame([], _EDGES)
        rows = reduce(DataFrame.union, parts)
        if nodes is not None:
            told = self.spark.range(1).select(F.transform(F.array(*map(F.lit, nodes)), lambda n: bucket(n, BUCKETS)).alias("b")).first()["b"] if nodes else []
            rows = rows.filter(F.col("bucket").isin(sorted(set(told))) & F.col("node").isin(nodes))
        gone = [self.spark.read.schema("fact_id long").parquet(f"{s['path']}/taken").withColumn("until", F.lit(i)) for i, s in enumerate(old) if s["taken"]]
        if not gone:
            return rows.drop("seg")
        last = reduce(DataFrame.union, gone).groupBy("fact_id").agg(F.max("until").alias("until"))
        return rows.join(last, "fact_id", "left").filter(F.col("until").isNull() | (F.col("seg") >= F.col("until"))).select(*[c.split()[0] for c in _EDGES.split(", ")])

    def edges(self, nodes: list[str] | None = None) -> DataFrame:
        """(src, dst, predicate, fact_id, confidence): the edges with an end among `nodes`, or all: one each way between two nodes, the latest fact's."""
        rows = self._rows(nodes).filter("node = src") if nodes is None else self._rows(nodes)
        latest = F.max_by(F.struct("predicate", "fact_id", "confidence"), "fact_id")
        return rows.groupBy("src", "dst").agg(latest.alias("e")).select("src", "dst", "e.*")

    def expand(self, start: str, hops: int = 1, most: int = 500) -> tuple[DataFrame, DataFrame]:
        """What `graph.expand` gives on all edges: (name, depth) of the nodes around one, and the edges among them.

        Each hop reads the buckets of its frontier. At most `most` nodes are held, here too.
        """
        seen = {start: 0} if self._rows([start]).limit(1).count() else {}
        front = list(seen)
        for depth in range(1, hops + 1):
            if not front or len(seen) >= most:
                break
            near = self._rows(front).select(F.explode(F.array("src", "dst")).alias("name")).distinct()
            new = near.filter(~F.col("name").isin(list(seen))).orderBy("name").limit(most - len(seen)).collect()
            front = [r["name"] for r in new]
            seen |= dict.fromkeys(front, depth)
        own = materialize(self.edges(list(seen)), "around")
        nodes = self.spark.createDataFrame(list(seen.items()), "name string, depth int")
        nodes = nodes.join(graph.degrees(own), "name", "left").fillna(0, ["degree"])
        return nodes, own.filter(F.col("src").isin(list(seen)) & F.col("dst").isin(list(seen)))


def build(facts: DataFrame, path: str) -> StoredGraph:
    """A new stored graph of the facts in the folder `path`."""
    made = StoredGraph(facts.sparkSession, path)
    made.change(put=facts)
    return made
