"""Chats that last: turns, ratings and deleted sessions as a log in folders by session, resolved when read."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from ..plans.segments import Segments, bucket

#: `at` is the row's place in the log: a turn's id; for a deletion the last id that it covers; for a rating its own order.
_LOG = "kind string, at long, id long, kb_name string, session_id string, role string, content string, sources string, related_facts string, feedback_given string, created_at timestamp"
_COLUMNS = [c.split()[0] for c in _LOG.split(", ")]
_SESSION = ["kb_name", "session_id"]
MESSAGE = [c for c in _COLUMNS if c not in ("kind", "at")]


class ChatLog:
    """CH-01, UPD-16, SNK-01 over a folder. A session's rows are in one of `buckets` folders, and its history reads that one only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.files, self.buckets = spark, Segments(spark, path), buckets

    def _bucket(self, kb="kb_name", session="session_id"):
        return bucket(F.struct(F.col(kb).alias("k"), F.col(session).alias("s")), self.buckets)

    def _add(self, rows: DataFrame, last: int, after: tuple[int, list[dict]]) -> None:
        """Writes rows as a segment and makes it count; fails if the log has changed since `after` was read."""
        at = self.files.new()
        given = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _LOG.split(", "))]
        self.files.write(rows.select(*given).withColumn("bucket", self._bucket()), at, "session_id", "at")
        self.files.commit([*after[1], {"path": at, "last": last}], after[0])

    def save(self, turns: DataFrame) -> DataFrame:
        """turns(seq, kb_name, session_id, role, content, sources, related_facts, created_at) -> (seq, id, session_id).

        Ids go on from the last one in the order of seq, which counts from 1. Without a session a turn begins one of its own.
        Missing sources and facts are "[]", other missing columns null. A seq that is null, repeated or below 1, and a null
        kb_name, make it ValueError, and nothing is saved.
        """
        before, salt = self.files.newest(), uuid.uuid4().hex
        last = max((s["last"] for s in before[1]), default=0)
        new = F.substring(F.sha2(F.concat(F.lit(salt), F.col("seq").cast("string")), 256), 1, 12)
        own = lambda c: F.col(c) if c in turns.columns else F.lit(None).cast("string")
        rows = turns.withColumns({
            "kind": F.lit("turn"), "id": F.col("seq") + last, "at": F.col("seq") + last, "session_id": F.coalesce(F.nullif(own("session_id"), F.lit("")), new),
            "sources": F.coalesce(own("sources"), F.lit("[]")), "related_facts": F.coalesce(own("related_facts"), F.lit("[]")), "feedback_given": F.lit(None).cast("string"),
        })
        told = rows.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"), F.min("seq").alias("least"), F.max("id").alias("last"), F.count("kb_name").alias("named")).first()
        if told["n"] != told["seqs"] or told["named"] != told["n"] or (told["n"] and told["least"] < 1):
            raise ValueError("a turn has no place or knowledge base of its own")
        if told["n"]:
            self._add(rows, told["last"], before)
        return rows.select("seq", "id", "session_id")

    def delete(self, sessions: DataFrame) -> int:
        """sessions(kb_name, session_id) go with the turns that they have now, whose number it returns; later turns begin anew."""
        before = self.files.newest()
        gone = materialize(self.messages().join(sessions.select(*_SESSION).distinct(), _SESSION, "left_semi").groupBy(*_SESSION).agg(F.count("*").alias("n")), "deleted")
        n = gone.agg(F.sum("n")).first()[0] or 0
        if n:
            last = max(s["last"] for s in before[1])
            self._add(gone.select(F.lit("delete").alias("kind"), F.lit(last).alias("at"), *_SESSION), last, before)
        return n

    def rate(self, ratings: DataFrame) -> None:
        """ratings(seq, id, feedback_given): the last one of a turn by seq, and any later call's, stands; null takes one back; unknown ids are nothing."""
        before = self.files.newest()
        best = ratings.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("feedback_given"), "seq").alias("x")).select("id", "x.feedback_given")
        rows = self.messages().select("id", *_SESSION).join(best, "id")
        last = max((s["last"] for s in before[1]), default=0)
        self._add(rows.withColumns({"kind": F.lit("rating"), "at": F.lit(len(before[1]))}), last, before)

    def log(self) -> DataFrame:
        old = [self.spark.read.schema(f"{_LOG}, bucket int").parquet(s["path"]) for s in self.files.segments()]
        return reduce(DataFrame.union, old) if old else self.spark.createDataFrame([], f"{_LOG}, bucket int")

    def messages(self, log: DataFrame | None = None) -> DataFrame:
        """The turns that stand, with the ratings that stand."""
        log = self.log() if log is None else log
        gone = log.filter("kind = 'delete'").groupBy(*_SESSION).agg(F.max("at").alias("_until"))
        rated = log.filter("kind = 'rating'").groupBy("id").agg(F.max_by(F.struct("feedback_given"), "at").alias("_rated"))
        turns = log.filter("kind = 'turn'").join(gone, _SESSION, "left").filter("_until IS NULL OR at > _until")
        both = turns.join(rated, "id", "left").withColumn("feedback_given", F.when(F.col("_rated").isNull(), F.col("feedback_given")).otherwise(F.col("_rated.feedback_given")))
        return both.select(*MESSAGE)

    def history(self, kb: str, session: str) -> DataFrame:
        """A session's turns by id, of one folder of each segment; sources and facts as lists of JSON texts, empty where they aren't lists."""
        at = self.spark.range(1).select(F.lit(kb).alias("kb_name"), F.lit(session).alias("session_id")).select(self._bucket()).first()[0]
        own = self.messages(self.log().filter((F.col("bucket") == at) & (F.col("kb_name") == kb) & (F.col("session_id") == session)))
        read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c)
        return own.select("id", "role", "content", read("sources"), read("related_facts"), "feedback_given", "created_at").orderBy("id")

    def sessions(self, kb: str) -> DataFrame:
        """(session_id, created_at, turns, latest) of a knowledge base, newest first; turns are the user's."""
        s = self.messages(self.log().filter(F.col("kb_name") == kb)).groupBy("session_id")
        out = s.agg(F.min("created_at").alias("created_at"), F.count_if(F.col("role") == "user").alias("turns"), F.max("created_at").alias("latest"))
        return out.orderBy(F.desc_nulls_last("latest"), "session_id")

    def merge(self) -> None:
        """One segment of what stands, in place of all."""
        before = self.files.newest()
        if before[1]:
            rows = self.messages().withColumns({"kind": F.lit("turn"), "at": F.col("id")})
            self._add(rows, max(s["last"] for s in before[1]), (before[0], []))
