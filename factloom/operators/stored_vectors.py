"""A stored table of vectors in clusters with radii: exact search reads only clusters that can hold one of the k best."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.segments import Segments

#: Clusters of a segment at most, and vectors a cluster that their centres are fitted on: the sample is 16,384 vectors at most.
CLUSTERS, SAMPLED = 1024, 16
_ROWS = "fact_id long, embedding array<float>, bucket int"
_CLUSTERS = "bucket int, dimension int, n long, radius double, centre array<double>"


class StoredVectors:
    """SNK-04, VEC-01, VEC-03 over a folder: `put` and `remove` add a segment, `merge` makes one of all, opening the folder loads it.

    A vector without an id, or with a null or non-finite component, takes no part. A put replaces what stood under its ids; rows
    that repeat an id within one put all stay. Vectors of any lengths may be together; those of a length that the fitted sample
    doesn't hold form one cluster around zero.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Segments(spark, path)
        #: What the last search read: clusters and vectors, and how many there were of its length.
        self.read = {"clusters": 0, "of_clusters": 0, "vectors": 0, "of_vectors": 0}

    def put(self, rows: DataFrame, clusters: int | None = None) -> None:
        """rows(fact_id, embedding) into about `clusters` clusters, without it the square root of their number. Reads them three times."""
        self.files.commit([*self.files.segments(), self._written(rows, clusters, True)])

    def remove(self, ids: DataFrame) -> None:
        """Takes out the vectors of ids(fact_id): they are tombstones until the next merge."""
        at = self.files.new()
        _ids(ids).write.parquet(f"{at}/gone")
        self.files.commit([*self.files.segments(), {"path": at, "rows": False, "gone": True}])

    def merge(self, clusters: int | None = None) -> None:
        """One segment, clustered anew; tombstones and what they stand for are no longer stored."""
        self.files.commit([self._written(self.rows(), clusters, False)])

    def _written(self, rows: DataFrame, clusters: int | None, replaces: bool) -> dict:
        at = self.files.new()
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        own = rows.select(F.col("fact_id").cast("long"), F.col("embedding").cast("array<float>")).filter("fact_id IS NOT NULL").filter(sound)
        wanted = max(1, min(CLUSTERS, clusters or math.ceil(math.sqrt(own.count()))))
        drawn = own.orderBy(F.xxhash64("fact_id"), "fact_id").limit(SAMPLED * wanted).select("embedding").collect()
        centres = _centres([r["embedding"] for r in drawn], wanted)
        dealt = own.mapInArrow(_dealer(centres), _ROWS + ", distance double")
        self.files.write(dealt, f"{at}/rows", "fact_id")
        # A schema that is given needs no look at the files, of which there are none for no rows.
        stored = self.spark.read.schema(_ROWS + ", distance double").parquet(f"{at}/rows")
        of = {b: (n, c) for n, (first, table) in centres.items() for b, c in enumerate(table.tolist(), first)}
        known = self.spark.createDataFrame([(b, n, c) for b, (n, c) in of.items()], "bucket int, dimension int, centre array<double>")
        told = stored.groupBy("bucket").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).join(F.broadcast(known), "bucket", "left")
        told = told.select("bucket", F.coalesce("dimension", -F.col("bucket")).alias("dimension"), "n", "radius", F.coalesce("centre", F.array().cast("array<double>")).alias("centre"))
        told.coalesce(1).write.parquet(f"{at}/clusters")
        if replaces:
            _ids(own).write.parquet(f"{at}/gone")
        return {"path": at, "rows": True, "gone": replaces}

    def rows(self, only: dict[int, list[int]] | None = None) -> DataFrame:
        """(fact_id, embedding) of what stands; of some buckets of some segments, if they are told."""
        old, parts = self.files.segments(), []
        for i, s in enumerate(old):
            if s["rows"] and (only is None or only.get(i)):
                at = f"{s['path']}/rows"
                folders = [at] if only is None else [f"{at}/bucket={b}" for b in only[i]]
                parts.append(self.spark.read.schema(_ROWS).option("basePath", at).parquet(*folders).select("fact_id", "embedding", F.lit(i).alias("seg")))
        if not parts:
            return self.spark.createDataFrame([], "fact_id long, embedding array<float>")
        found = reduce(DataFrame.union, parts)
        gone = [self.spark.read.schema("fact_id long").parquet(f"{s['path']}/gone").withColumn("until", F.lit(i)) for i, s in enumerate(old) if s["gone"] and i]
        if gone:  # a first segment takes nothing's place
            last = reduce(DataFrame.union, gone).groupBy("fact_id").agg(F.max("until").alias("until"))
            found = found.join(last, "fact_id", "left").filter(F.col("until").isNull() | (F.col("seg") >= F.col("until")))
        return found.select("fact_id", "embedding")

    def search(self, query: list[float], k: int = 20, first: int = 8) -> DataFrame:
        """(fact_id, score): the k highest inner products with vectors of the query's length, ties to the smaller id.

        By the triangle inequality no vector of a cluster is above query x centre + |query| x radius. Clusters are read from the
        highest bound on, `first` of them and then twice as many each time, until the k-th score is above what is left. The k best,
        and a line a cluster, are all that the driver holds.
        """
        q = np.array(query, np.float64)
        norm, open_ = float(np.linalg.norm(q)), []
        for i, s in enumerate(self.files.segments()):
            told = self.spark.read.schema(_CLUSTERS).parquet(f"{s['path']}/clusters").filter(F.col("dimension") == len(q)).collect() if s["rows"] else []
            for c in told:
                centre = np.array(c["centre"] or np.zeros(len(q)), np.float64)
                slack = 1e-9 * (1 + norm * (float(np.linalg.norm(centre)) + c["radius"]))  # for what rounding may take
                open_.append((float(q @ centre) + norm * c["radius"] + slack, i, c["bucket"], c["n"]))
        open_.sort(reverse=True)
        self.read = {"clusters": 0, "of_clusters": len(open_), "vectors": 0, "of_vectors": sum(c[3] for c in open_)}
        best, step = [], first
        while open_ and k > 0 and (len(best) < k or best[-1][1] <= open_[0][0]):
            now, open_ = open_[:step], open_[step:]
            step *= 2
            self.read["clusters"] += len(now)
            self.read["vectors"] += sum(c[3] for c in now)
            only: dict[int, list[int]] = {}
            for _, i, b, _ in now:
                only.setdefault(i, []).append(b)
            met = self.rows(only).mapInArrow(_scorer(q, k), "fact_id long, score double").orderBy(F.desc("score"), "fact_id").limit(k).collect()
            best = sorted([*best, *[(r["fact_id"], r["score"]) for r in met]], key=lambda r: (-r[1], r[0]))[:k]
        return self.spark.createDataFrame(best, "fact_id long, score double")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fact_id").cast("long")).filter("fact_id IS NOT NULL").distinct()


def _centres(sample: list[list[float]], clusters: int) -> dict[int, tuple[int, np.ndarray]]:
    """For each length in the sample: (its first bucket, centres), by five rounds of k-means; buckets begin at 1."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out, at = {}, 1
    for n, rows in sorted(by.items()):
        v = np.array(rows, np.float64).reshape(len(rows), n)
        if not n:
            continue
        centres = v[: max(1, clusters * len(rows) // len(sample))].copy()
        for _ in range(5):
            near = _nearest(v, centres)
            number = np.bincount(near, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, near, v)
            centres[number > 0] = total[number > 0] / number[number > 0, None]
        out[n] = (at, centres)
        at += len(centres)
    return out


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (v @ centres.T), axis=1)


def _by_length(column: pa.Array):
    """(length, row numbers, matrix) for each length of a batch's vectors."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield n, rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)


def _dealer(centres: dict[int, tuple[int, np.ndarray]]):
    def deal(batches):
        for batch in batches:
            at, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for n, rows, v in _by_length(batch.column(1)):
                if n in centres:
                    first, table = centres[n]
                    near = _nearest(v, table)
                    at[rows], far[rows] = first + near, np.linalg.norm(v - table[near], axis=1)
                else:
                    at[rows], far[rows] = -n, np.linalg.norm(v, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(far)], names=["fact_id", "embedding", "bucket", "distance"])

    return deal


def _scorer(q: np.ndarray, k: int):
    """Each task's own k best."""

    def score(batches):
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for _, rows, v in _by_length(batch.column(1)):
                ids, scores = np.concatenate([ids, own[rows]]), np.concatenate([scores, v @ q])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], names=["fact_id", "score"])

    return score


def build(vectors: DataFrame, path: str) -> StoredVectors:
    """A new stored table of vectors(fact_id, embedding) in the folder `path`."""
    made = StoredVectors(vectors.sparkSession, path)
    made.put(vectors)
    return made
