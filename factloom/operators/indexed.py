"""A stored knowledge base that index runs change, a batch of files at a time.

All that a batch of files gives (files, chunks, facts, vectors, failures) is written first and becomes visible at once, with
the paths whose earlier rows it replaces. A run that is killed leaves whole batches or nothing, and the next run takes only
what is not done: the result is that of a run that was not killed, as ids are hashes of what they name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, text
from ..plans.runtime import discard, materialize
from ..plans.segments import Segments
from . import decisions, lifecycle, relational, updates, vector
from .stored_graph import StoredGraph

#: Files that a batch's rows are dealt to, which are read in parallel.
WIDTH = 16
#: Batches of a run at most, as each costs a number of small jobs, however few its files are, and a segment that every read of a table takes in.
MOST_BATCHES = 16
_WORK = "path string, sha256 string, text string"
_TABLES = {
    "files": "path string, sha256 string, id long, status string",
    "chunks": "path string, file_id long, chunk_index int, content string, id long",
    "facts": "path string, id long, file_id long, chunk_id long, subject string, predicate string, object string, confidence int, title string, description string, evidence_span string",
    "vectors": "path string, fact_id long, embedding array<float>",
    "failed_chunks": "path string, chunk_id long, file_id long, error_class string, error_msg string",
}


class IndexedBase:
    """IX-01, IX-02, UPD-14: the tables of a folder, their runs, and the graph of their facts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files, self.graph = spark, Segments(spark, f"{path}/tables"), StoredGraph(spark, f"{path}/graph")
        self.names = decisions.Decisions(spark, f"{path}/names")

    def table(self, name: str) -> DataFrame:
        """A table's rows, without those of paths that a later batch has replaced or removed."""
        old = [s for s in self.files.segments() if s["path"]]
        rows = [self.spark.read.schema(_TABLES[name]).parquet(f"{s['path']}/{name}").withColumn("_seg", F.lit(i)) for i, s in enumerate(old) if s["rows"]]
        if not rows:
            return self.spark.createDataFrame([], _TABLES[name])
        gone = [self.spark.read.schema("path string").parquet(f"{s['path']}/gone").withColumn("_until", F.lit(i)) for i, s in enumerate(old)]
        last = reduce(DataFrame.union, gone).groupBy("path").agg(F.max("_until").alias("_until"))
        kept = reduce(DataFrame.union, rows).join(last, "path", "left").filter(F.col("_until").isNull() | (F.col("_seg") >= F.col("_until")))
        return kept.select(*[c.split()[0] for c in _TABLES[name].split(", ")])

    def facts(self) -> DataFrame:
        """The facts with their status, as the decisions on names that stand make them, of whatever run they are."""
        return self.names.resolve(self.table("facts").withColumn("status", F.lit("active")))

    def decide(self, rows: DataFrame) -> int:
        """Takes decisions on names (see `decisions.Decisions.prepared`) and brings the graph to what they make of the facts that
        they change. Returns the number of these. The graph goes first, as in a run."""
        segment = self.names.prepared(rows)
        before, after = self.names.final_names(), decisions.final_names(decisions.standing(self.names.with_segment(segment)))
        was, will = before.select("name", F.struct("final").alias("_was")), after.select("name", F.struct("final").alias("_will"))
        moved = was.join(will, "name", "full_outer").filter(~F.col("_was").eqNullSafe(F.col("_will"))).select("name")
        own = self.table("facts").withColumn("status", F.lit("active"))
        hit = own.join(moved.select(F.col("name").alias("subject")), "subject", "left_semi").select("id")
        hit = hit.union(own.join(moved.select(F.col("name").alias("object")), "object", "left_semi").select("id")).distinct()
        hit = materialize(hit, "changed")
        n = hit.count()
        if n:
            self.graph.change(put=decisions.resolve(own.join(hit, "id", "left_semi"), after), taken=hit)
        self.names.commit(segment)
        return n

    def runs(self) -> list[dict]:
        """Each run's counts and state: completed, stopped, or, if it ended without a word, crashed."""
        out: dict[int, dict] = {}
        for s in self.files.segments():
            r = out.setdefault(s["run"], {"run": s["run"], "status": "crashed", "files_changed": 0, "facts_added": 0, "facts_removed": 0})
            for c in ("files_changed", "facts_added", "facts_removed"):
                r[c] += s.get(c, 0)
            r["status"] = s.get("status") or r["status"]
        return list(out.values())

    def run(
        self, listing: DataFrame, extractor: lifecycle.Extractor = lifecycle.rule_extractor, embedder=None, batch_files: int = 10_000, max_chars: int = 24000, overlap: int = 500,
        stop: Callable[[], bool] | None = None, only: str | None = None, most_batches: int = MOST_BATCHES,
    ) -> dict:
        """listing(path, sha256, text) against the files that are done: new and changed ones are taken, vanished ones removed.

        A batch holds about `batch_files` of the files that are taken, or more if they would be over `most_batches` batches. `stop` is asked between batches. `only` names one path to index anew,
        whatever its hash, and nothing else changes then. A file whose every chunk fails is failed, and is taken again by the
        next run. Returns the run's counts.
        """
        number = 1 + max((s["run"] for s in self.files.segments()), default=0)
        known = self.table("files").filter("status = 'done'").select("path", "sha256")
        if only is None:
            changes = relational.snapshot_diff(listing.select("path", "sha256"), known)
            lost = self.table("files").select("path").join(listing.select("path"), "path", "left_anti")
            if lost.limit(1).count():
                self._commit(number, None, lost, {})
            work = listing.join(changes.filter("change IN ('added', 'modified')").select("path"), "path", "left_semi")
        else:
            work = listing.filter(F.col("path") == only)
        at, status = self.files.new(), "completed"
        for i in self._dealt(work, batch_files, at, most_batches):
            if stop and stop():
                status = "stopped"
                break
            batch = self.spark.read.schema(_WORK).parquet(f"{at}/work/batch={i}")
            old = self.spark.read.schema("id long").parquet(f"{at}/old/batch={i}") if self.files._exists(f"{at}/old/batch={i}") else None
            self._batch(number, batch, old, extractor, embedder, max_chars, overlap)
        discard(self.spark, [at])
        self.files.commit([*self.files.segments(), {"run": number, "path": None, "status": status}])
        return self.runs()[-1]

    def _dealt(self, work: DataFrame, batch_files: int, at: str, most_batches: int = MOST_BATCHES) -> list[int]:
        """Writes what a run is to do in a folder a batch, by the path's hash, and beside it the facts that stand under the same
        paths now, so that a batch reads its own rows only. Returns the batches that have a file."""
        todo = materialize(work.select("path", "sha256", "text"), "work")
        parts = max(1, min(most_batches, math.ceil(todo.count() / batch_files)))
        batch = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(parts)).cast("int").alias("batch")
        rows = todo.select("*", batch).repartition("batch", F.pmod(F.xxhash64("path", F.lit(2)), F.lit(WIDTH)))
        rows.write.partitionBy("batch").parquet(f"{at}/work")
        facts = self.table("facts").join(todo.select("path", batch), "path").select("id", "batch")
        facts.repartition("batch").write.partitionBy("batch").parquet(f"{at}/old")
        return [r["batch"] for r in todo.select(batch).distinct().orderBy("batch").collect()]

    def _batch(self, number: int, batch: DataFrame, old: DataFrame | None, extractor, embedder, max_chars: int, overlap: int) -> None:
        at, spark = self.files.new(), self.spark
        named = batch.select("path", "sha256", updates.id_of("path").alias("file_id"))
        pieces = batch.select("path", updates.id_of("path").alias("file_id"), F.posexplode(text.chunk_udf(max_chars, overlap)(F.col("text"))).alias("chunk_index", "content"))
        pieces.withColumn("id", updates.id_of("path", "chunk_index")).write.parquet(f"{at}/chunks")
        chunks = spark.read.schema(_TABLES["chunks"]).parquet(f"{at}/chunks")
        lifecycle.extract(chunks, extractor).write.parquet(f"{at}/raw")  # a model is asked once
        raw = spark.read.parquet(f"{at}/raw")
        paths = named.select("path", "file_id")
        facts = lifecycle.extracted_facts(raw).join(paths, "file_id").withColumn("id", updates.id_of("chunk_id", "subject", "predicate", "object"))
        facts.select(*[c.split()[0] for c in _TABLES["facts"].split(", ")]).write.parquet(f"{at}/facts")
        facts = spark.read.schema(_TABLES["facts"]).parquet(f"{at}/facts")
        told = facts.select("path", F.col("id").alias("fact_id"), vector.embedding_text(F.col("title"), F.col("subject"), F.col("predicate"), F.col("object"), F.col("description")).alias("t"))
        vector.embed(told, "t", embedder).select("path", "fact_id", "embedding").write.parquet(f"{at}/vectors")
        bad = raw.filter("error IS NOT NULL").join(paths, "file_id")
        bad.select("path", "chunk_id", "file_id", "error_class", text.cut(F.col("error")).alias("error_msg")).write.parquet(f"{at}/failed_chunks")
        good = raw.groupBy("file_id").agg(F.count_if(F.col("error").isNull()).alias("_good"), F.count_if(F.col("error").isNotNull()).alias("_bad"))
        state = F.when((F.col("_bad") > 0) & (F.col("_good") == 0), "failed").otherwise("done")
        named.join(good, "file_id", "left").select("path", "sha256", F.col("file_id").alias("id"), state.alias("status")).write.parquet(f"{at}/files")
        self._commit(number, at, paths.select("path"), {"files_changed": spark.read.parquet(f"{at}/files").count(), "facts_added": facts.count()}, old)

    def _commit(self, number: int, at: str | None, paths: DataFrame, counts: dict, old: DataFrame | None = None) -> None:
        """Makes a batch visible, and what stood under its paths gone: a batch is told these facts, `old`, if there are any. The
        graph goes first: to put the same facts in again changes nothing, should the run be killed in between."""
        rows, at = at is not None, at or self.files.new()
        paths.write.parquet(f"{at}/gone")
        if not rows:
            gone = self.spark.read.schema("path string").parquet(f"{at}/gone")
            old = self.table("facts").join(gone, "path", "left_semi").select("id")
        n = old.count() if old is not None else 0
        new = self.spark.read.schema(_TABLES["facts"]).parquet(f"{at}/facts").withColumn("status", F.lit("active")) if rows else None
        taken = reduce(DataFrame.union, [d for d in (old, new.select("id") if rows else None) if d is not None])
        self.graph.change(put=self.names.resolve(new) if rows else None, taken=taken)
        self.files.commit([*self.files.segments(), {"run": number, "path": at, "rows": rows, "facts_removed": n, **counts}])


def dead_letter_classes(base: IndexedBase) -> DataFrame:
    """(error_class, n, retryable): what waits for another try, by class."""
    failed = base.table("failed_chunks").groupBy("error_class").agg(F.count("*").alias("n"))
    return failed.withColumn("retryable", errors.retryable(F.col("error_class")))
