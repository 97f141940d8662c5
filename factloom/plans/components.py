"""Connected components as a loop of joins: minimum labels with pointer jumping.

Nothing is collected but one counter a round. Each round reads labels that were
written to the shared folder, so both sides of each join are plain exchanges
and adaptive execution can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize, scratch


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst), any orderable type, either direction -> (node, component), the component's least node.

    Null ends, self-loops, repeated and reversed edges are allowed; a node that stands only in a self-loop is its own
    component, an edge with a null end is ignored. An empty table gives an empty table.
    """
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    both = materialize(e.union(e.select("dst", "src")).distinct(), "edges", "uncompressed")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("p")), "labels", "uncompressed")
    old: list[str] = []
    for _ in range(max_rounds):
        with scratch() as new:
            labels, changed = _round(both, labels)
        discard(edges.sparkSession, old + new[:-1])  # all but the labels that were written last
        old = new[-1:]
        if not changed:
            return labels.withColumnRenamed("p", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _round(both: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The labels after one round, and whether any has changed."""
    # Hook: the least label among a node's neighbours, then among its own.
    offers = both.join(labels, both["src"] == labels["node"]).select(F.col("dst").alias("node"), "p", F.lit(None).cast(labels.schema["p"].dataType).alias("was"))
    own = labels.select("node", "p", F.col("p").alias("was"))
    hooked = materialize(offers.union(own).groupBy("node").agg(F.min("p").alias("p"), F.max("was").alias("was")), "labels", "uncompressed")
    # Jump: a label's own label.
    up = hooked.select(F.col("node").alias("at"), F.col("p").alias("root"))
    jumped = materialize(hooked.join(up, hooked["p"] == up["at"]).select("node", F.col("root").alias("p"), "was"), "labels", "uncompressed")
    return jumped.select("node", "p"), jumped.filter("p <> was").limit(1).count()
