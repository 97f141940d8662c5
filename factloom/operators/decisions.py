"""Decisions on entities that last: renames and deletions kept as a log, and applied to facts whenever these are read.

Facts stay stored under the names they were indexed with. What a reader sees is what the decisions that stand make of them, one
after another in the order in which they were taken, so that facts of later index runs follow them too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from ..plans.segments import Segments

_LOG = "seq long, kind string, name string, new_name string, proposal_id long, target long"
_COLUMNS = [c.split()[0] for c in _LOG.split(", ")]
#: Kinds of decisions: the first two are on names, the next three on a proposal's status alone; the last takes back the decision `target`.
KINDS = ("rename", "delete", "approve", "ignore", "reopen", "undo")


class Decisions:
    """ER-04, ER-05, GR-05, UPD-07..09 over a folder: the log of the decisions, a segment for each `take`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Segments(spark, path)

    def log(self) -> DataFrame:
        """(seq, kind, name, new_name, proposal_id, target): all that was decided."""
        old = [self.spark.read.schema(_LOG).parquet(s["path"]) for s in self.files.segments()]
        return reduce(DataFrame.union, old) if old else self.spark.createDataFrame([], _LOG)

    def prepared(self, decisions: DataFrame) -> dict:
        """decisions(seq, kind, name, new_name, proposal_id, target) written, though they don't count before `commit`.

        Missing columns are null. Decisions are taken in the order of their seq, all of them after the earlier ones. A row of
        another kind, a rename or deletion without a name, and a rename to nothing are wrong: ValueError, and none is taken.
        """
        last = max((s["last"] for s in self.files.segments()), default=0)
        given = {c.split()[0]: c.split()[1] for c in _LOG.split(", ")}
        own = decisions.select(*[(F.col(c) if c in decisions.columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()])
        own = own.withColumns({"seq": F.col("seq") + last, "new_name": F.nullif(F.trim("new_name"), F.lit("")), "name": F.nullif("name", F.lit(""))})
        named = ~F.col("kind").isin("rename", "delete") | (F.col("name").isNotNull() & ((F.col("kind") == "delete") | F.col("new_name").isNotNull()))
        good = F.coalesce(F.col("kind").isin(*KINDS) & named & (F.col("seq") > last), F.lit(False))
        at = self.files.new()
        own.select(*_COLUMNS).write.parquet(at)
        told = self.spark.read.schema(_LOG).parquet(at).agg(F.count_if(~good).alias("bad"), F.max("seq").alias("last"), F.count_distinct("seq").alias("seqs"), F.count("*").alias("n")).first()
        if told["bad"] or told["seqs"] != told["n"]:
            raise ValueError(f"{told['bad']} decisions are wrong, {told['n'] - told['seqs']} repeat a seq")
        return {"path": at, "last": told["last"] or last}

    def commit(self, segment: dict) -> None:
        self.files.commit([*self.files.segments(), segment])

    def take(self, decisions: DataFrame) -> None:
        self.commit(self.prepared(decisions))

    def with_segment(self, segment: dict) -> DataFrame:
        """The log as it will be once the segment is committed."""
        return self.log().union(self.spark.read.schema(_LOG).parquet(segment["path"]))

    def final_names(self) -> DataFrame:
        return final_names(standing(self.log()))

    def resolve(self, facts: DataFrame) -> DataFrame:
        return resolve(facts, self.final_names()) if self.files.segments() else facts

    def proposals(self, proposals: DataFrame) -> DataFrame:
        return proposals_after(proposals, self.log())


def standing(log: DataFrame) -> DataFrame:
    """The renames and deletions that no undo has taken back; an undo may be taken back itself, by a later one."""
    undo, named = log.filter("kind = 'undo'").select("seq", "target"), log.filter("kind IN ('rename', 'delete')")
    if undo.isEmpty():
        return named
    over = log.sparkSession.createDataFrame([], "target long")
    while not undo.isEmpty():
        # An undo that nothing targets counts, and what it targets doesn't: neither is open any more.
        undo = materialize(undo, "undo")
        free = undo.join(undo.select(F.col("target").alias("seq"), F.col("seq").alias("_by")).filter("_by > seq").select("seq"), "seq", "left_anti")
        over = materialize(over.union(free.select("target")), "undone")
        undo = undo.join(free.select("seq"), "seq", "left_anti").join(free.select(F.col("target").alias("seq")), "seq", "left_anti")
    return named.join(over.filter("target IS NOT NULL").distinct().withColumnRenamed("target", "seq"), "seq", "left_anti")


def final_names(decisions: DataFrame) -> DataFrame:
    """Decisions (seq, kind, name, new_name) -> (name, final): what each decided name is called in the end, null if it is deleted.

    What is called `new_name` after a rename meets the first later decision on that name. These links form chains that go
    forward in time; pointers along them double from round to round, so that a chain of n decisions takes log n of them.
    """
    own = decisions.filter("kind = 'delete' OR name <> new_name").select("seq", "name", F.when(F.col("kind") == "rename", F.col("new_name")).alias("final"))
    leave = own.select(F.col("name").alias("at"), "seq", F.col("seq").alias("leaves"), F.lit(None).cast("long").alias("comes"))
    come = own.filter("final IS NOT NULL").select(F.col("final").alias("at"), "seq", F.lit(None).cast("long").alias("leaves"), F.col("seq").alias("comes"))
    after = Window.partitionBy("at").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nxt = leave.union(come).withColumn("next", F.min("leaves").over(after)).filter("comes IS NOT NULL").select(F.col("comes").alias("seq"), "next")
    chain = materialize(own.join(nxt, "seq", "left").select("seq", "name", "final", "next"), "chain")
    while not chain.filter("next IS NOT NULL").isEmpty():
        on = chain.select(F.col("seq").alias("next"), F.col("final").alias("_final"), F.col("next").alias("_next"), F.lit(True).alias("_on"))
        moved = chain.join(on, "next", "left")
        chain = materialize(moved.select("seq", "name", F.when(F.col("_on"), F.col("_final")).otherwise(F.col("final")).alias("final"), F.col("_next").alias("next")), "chain")
    first = chain.groupBy("name").agg(F.min_by(F.struct("final"), "seq").alias("f")).select("name", "f.final")
    return first.filter("final IS NULL OR name <> final")


def resolve(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with what `final_names` gives: active ones under their final names, and deleted if one of the two names is.

    A fact that is deleted keeps the names it was indexed with, so that it comes back whole when the decision is undone; facts
    that weren't active stay as they are.
    """
    out = facts
    for c in ("subject", "object"):
        told = names.select(F.col("name").alias(c), F.col("final").alias(f"_{c}"), F.lit(True).alias(f"_{c}_told"))
        out = out.join(told, c, "left")
    live = F.coalesce(F.col("status") == "active", F.lit(False))
    gone = live & ((F.col("_subject_told").isNotNull() & F.col("_subject").isNull()) | (F.col("_object_told").isNotNull() & F.col("_object").isNull()))
    new = {c: F.when(live & ~gone, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("subject", "object")}
    return out.withColumns(new | {"status": F.when(gone, "deleted").otherwise(F.col("status"))}).select(*facts.columns)


#: What a decision of each kind makes of the proposal that it is about.
STATUS = {"rename": "approved", "approve": "approved", "delete": "deleted", "ignore": "rejected", "reopen": "proposed"}


def proposals_after(proposals: DataFrame, log: DataFrame) -> DataFrame:
    """Proposals (id, entity_a, entity_b, confidence, status, proposal_type, ...) with their last decision's status, and an approved
    suspect for each new name of a rename that stands, so that the name isn't flagged again. An undone decision leaves its
    proposal proposed."""
    kept = standing(log).select("seq")
    valid = log.filter("proposal_id IS NOT NULL AND kind <> 'undo'").join(kept.withColumn("_stands", F.lit(True)), "seq", "left")
    undone = F.col("kind").isin("rename", "delete") & F.col("_stands").isNull()
    status = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in STATUS.items()])
    said = valid.groupBy(F.col("proposal_id").alias("id")).agg(F.max_by(F.when(undone, "proposed").otherwise(status), "seq").alias("_said"))
    out = proposals.join(said, "id", "left").withColumn("status", F.coalesce("_said", "status")).select(*proposals.columns)
    safe = log.filter("kind = 'rename' AND name <> new_name").join(kept, "seq", "left_semi").groupBy("new_name").agg(F.min_by("name", "seq").alias("_was"))
    row = {"entity_a": F.col("new_name"), "entity_b": F.lit(""), "confidence": F.lit(1.0), "status": F.lit("approved"), "proposal_type": F.lit("suspect"), "llm_response": F.to_json(F.struct(F.lit([]).cast("array<string>").alias("flags"), F.col("_was").alias("renamed_from")))}
    types = dict(proposals.dtypes)
    return out.union(safe.select(*[row.get(c, F.lit(None)).cast(types[c]).alias(c) for c in proposals.columns]))
