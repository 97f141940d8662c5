"""Merkle manifest of a table: a digest a row, a tree a group, a tree over the groups' roots, and a proof a row.

Rows of a group are numbered by a range sort, so that no group is one task. Levels are windows: within a group's parent
index, a full-frame `collect_list` in order gives the parent's preimage, which also holds each node's siblings, and the
parents are deduplicated before the next level. `LEVELS` levels share one exchange, as their parents all lie in one block
of nodes, and a block's row keeps the digests of the levels below. Proofs are read off these: a row meets its block once,
a block the block above it, and so on, so that narrow rows are shuffled a few times, whatever the height of the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import CRC32_SQL

#: Nodes of a run that become one parent.
WIDTH = 2
#: Levels that one exchange serves; a block has WIDTH ** LEVELS nodes.
LEVELS = 8
#: `monotonically_increasing_id` has the number of a partition above these bits, a row's place in it below.
_PLACE_BITS = 33
_STEP = "struct<left: string, right: string>"


def field(c: Column) -> Column:
    """A value as it enters a row's preimage: `-` if null, else its UTF-8 byte count, a colon and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with idx, their places from 0 within the group by `order`, and n, the group's number of rows.

    A range sort deals the rows out; only counts of (group, partition) meet in a window, a few rows a partition.
    """
    by = [group, *order]
    placed = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    counts = counts.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias("n"))
    both = placed.withColumn("_part", part).join(counts, [group, "_part"])
    return both.withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def climb(nodes: DataFrame, width: int, levels: int) -> DataFrame:
    """nodes(g, idx, n, digest) -> (g, block, n, digest, below): each block's root, or its top so far, and the digests below it.

    below: for each level, from the nodes up, the block's digests from left to right. A group that is down to one node
    climbs no further, and has no more levels in `below`.
    """
    at = nodes.withColumn("block", F.floor(F.col("idx") / width**levels).cast("long")).repartition("g", "block")
    at = at.withColumn("below", F.array().cast("array<array<string>>"))
    for _ in range(levels):
        at = at.withColumn("parent", F.floor(F.col("idx") / width).cast("long"))
        run = Window.partitionBy("g", "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = at.withColumn("_run", F.collect_list(F.struct("digest", "below")).over(run)).dropDuplicates(["g", "block", "parent"])
        digests = F.transform("_run", lambda x: x["digest"])
        # Levels below of the run's nodes, side by side, then the run itself.
        depth = F.size(F.get("_run", F.lit(0))["below"])
        lower = F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), lambda k: F.flatten(F.transform("_run", lambda x: F.get(x["below"], k)))))
        lower = F.coalesce(lower, F.array().cast("array<array<string>>"))
        more = F.col("n") > 1
        at = at.select(
            "g", "block", F.col("parent").alias("idx"), F.floor((F.col("n") + (width - 1)) / width).cast("long").alias("n"),
            F.when(more, F.sha2(F.array_join(digests, ""), 256)).otherwise(F.get(digests, F.lit(0))).alias("digest"),
            F.when(more, F.concat(lower, F.array(digests))).otherwise(lower).alias("below"),
        )
    return at.drop("idx")


def steps(below: Column, idx: Column, width: int, levels: int) -> Column:
    """The way up from a block's node: for each level, the digests of its run to the left and to the right."""

    def one(row: Column, k: Column) -> Column:
        own = F.floor((idx % width**levels) / F.pow(F.lit(width), k)).cast("int")
        first = own - own % width
        cut = lambda a, n: F.array_join(F.slice(row, a + 1, n), "")
        return F.struct(cut(first, own - first).alias("left"), cut(own + 1, F.lit(width - 1) - (own - first)).alias("right"))

    return F.transform(below, one)


def proofs(nodes: DataFrame, most: int, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """nodes(g, idx, n, digest, ...) -> the same rows with root, their group's, and proof: left and right siblings a level.

    most: the largest n. Other columns stay.
    """
    if most <= 1:
        return nodes.withColumns({"root": F.col("digest"), "proof": F.array().cast(f"array<{_STEP}>")})
    levels = next((k for k in range(1, levels) if width**k >= most), levels)
    blocks = materialize(climb(nodes.select("g", "idx", "n", "digest"), width, levels), "blocks")
    above = blocks.select("g", F.col("block").alias("idx"), "n", "digest", F.col("below").alias("_own"))
    above = proofs(above, -(-most // width**levels), width, levels).select("g", F.col("idx").alias("_block"), F.col("_own").alias("below"), "root", F.col("proof").alias("_above"))
    at = nodes.withColumn("_block", F.floor(F.col("idx") / width**levels).cast("long")).join(above, ["g", "_block"])
    way = F.concat(steps(F.col("below"), F.col("idx"), width, levels), F.col("_above"))
    return at.withColumn("proof", way).drop("_block", "below", "_above")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level and from left to right, in one string."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, group: str, order: str, values: list[str], carry: dict[str, Column] | None = None, width: int = WIDTH, levels: int = LEVELS) -> DataFrame:
    """One row a row: its `order` column, leaf, subroot, root, proof and the columns of `carry`, which are computed from `rows`.

    A leaf is the digest of `values`. A group's leaves ascend by `order`, nulls first, equal ones by their digests; equal
    rows are interchangeable. Subroots are ordered by group, null first. Nodes become parents `width` at a time, a last run
    may be shorter, until one is left. An empty table gives an empty table; other columns are ignored. Ranks take jobs while
    the query is being built.
    """
    own = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("_order"), row_digest(*[F.col(c) for c in values]).alias("digest"), *[c.alias(n) for n, c in (carry or {}).items()])
    own = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    placed = materialize(numbered(own, "g", ["_order", "digest", "_row"]), "numbered")
    most = placed.agg(F.max("n")).first()[0]
    if most is None:
        out = placed.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), *[F.col(n) for n in carry or {}])
        return out.withColumns({"subroot": F.lit("").cast("string"), "root": F.lit("").cast("string"), "proof": F.array().cast(f"array<{_STEP}>")})
    proven = proofs(placed, most, width, levels)
    roots = materialize(proven.filter("idx = 0").select(F.col("g").alias("_g"), F.col("root").alias("digest")), "subroots")
    upper = materialize(numbered(roots.withColumn("g", F.lit("")), "g", ["_g"]), "groups")
    upper = proofs(upper, upper.agg(F.max("n")).first()[0], width, levels).select(F.col("_g").alias("g"), F.col("root").alias("_root"), F.col("proof").alias("_upper"))
    both = proven.join(materialize(upper, "upper"), "g")  # written, so that its size is known and decides how it is joined
    return both.select(
        F.col("_order").alias(order), F.col("digest").alias("leaf"), *[F.col(n) for n in carry or {}], F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("proof", "_upper").alias("proof")
    )


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_FOLDED = "coalesce(s.l, '') || f.h || coalesce(s.r, '')"

ORACLE = f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format('n_chars')} AS leaf,
    CASE WHEN {CRC32_SQL.format('doc_id')} % 7 = 0 THEN {_LEAF.format('(n_chars + 1)')} END AS bad FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows_),
tree AS (SELECT g, 0 AS lvl, i, n, leaf AS h FROM leaves
  UNION ALL SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, lvl, i // 2, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, max(lvl) OVER () AS deepest FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, i, n, h FROM subroots UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
depth AS (SELECT g, max(lvl) AS d FROM tree GROUP BY g),
-- Each row's place on each level, through its group's tree and then the tree of the groups.
way AS (SELECT l.doc_id, l.g, l.i AS leaf_i, t.lvl, t.h AS own, CASE WHEN x.i < t.i THEN x.h END AS l, CASE WHEN x.i > t.i THEN x.h END AS r
    FROM leaves l JOIN depth d ON d.g = l.g JOIN tree t ON t.g = l.g AND t.lvl < d.d AND t.i = l.i // (1 << t.lvl)
    LEFT JOIN tree x ON x.g = t.g AND x.lvl = t.lvl AND x.i = xor(t.i, 1)
  UNION ALL SELECT l.doc_id, l.g, l.i, d.d + t.lvl, t.h, CASE WHEN x.i < t.i THEN x.h END, CASE WHEN x.i > t.i THEN x.h END
    FROM leaves l JOIN depth d ON d.g = l.g JOIN subroots s ON s.g = l.g JOIN top t ON t.n > 1 AND t.i = s.i // (1 << t.lvl)
    LEFT JOIN top x ON x.lvl = t.lvl AND x.i = xor(t.i, 1)),
proofs AS (SELECT g, leaf_i, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY lvl) AS proof FROM way GROUP BY g, leaf_i),
folds AS (SELECT g, i AS leaf_i, 0 AS lvl, coalesce(bad, leaf) AS h FROM leaves
  UNION ALL SELECT f.g, f.leaf_i, f.lvl + 1, sha256({_FOLDED}) FROM folds f JOIN way s ON s.g = f.g AND s.leaf_i = f.leaf_i AND s.lvl = f.lvl),
folded AS (SELECT g, leaf_i, max_by(h, lvl) AS h FROM folds GROUP BY g, leaf_i),
whole AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN folded f ON f.g = l.g AND f.leaf_i = l.i LEFT JOIN proofs p ON p.g = l.g AND p.leaf_i = l.i CROSS JOIN whole
"""
