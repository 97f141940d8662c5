"""Structured Streaming forms: incremental ingest, score votes, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """STM-01: new files of a folder with their hashes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return s.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), "content")


def ingest(stream: DataFrame, known: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str):
    """STM-01, STM-05: each micro-batch's added and modified files to the sink; the query can be stopped between batches."""

    def each(batch: DataFrame, _: int) -> None:
        diff = relational.snapshot_diff(batch, known())
        sink(batch.join(diff.filter("change IN ('added', 'modified')").select("path"), "path", "left_semi"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_votes(votes: DataFrame) -> DataFrame:
    """STM-03: a stream of votes (fact_id, seq, delta) -> the running score of each fact, held to 0..2 after each vote.

    A batch's votes are folded by seq. A vote that comes in a later batch than one of higher seq is late: it is folded when it
    comes, on the score as it is then, and counted: (fact_id, user_score, late). Votes are taken batch by batch of Arrow's,
    so that a fact of many votes holds their numbers only.
    """

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score, last, late = state.get if state.exists else (1.0, None, 0)
        rows = sorted((s, d) for b in batches for s, d in zip(b["seq"].tolist(), b["delta"].tolist()))
        late += sum(last is not None and s < last for s, _ in rows)
        for _, d in rows:
            score = min(2.0, max(0.0, score + d))
        last = max(rows[-1][0], last) if last is not None else rows[-1][0]
        state.update((score, last, late))
        yield pd.DataFrame({"fact_id": [key[0]], "user_score": [score], "late": [late]})

    return votes.groupBy("fact_id").applyInPandasWithState(fold, "fact_id long, user_score double, late long", "score double, last long, late long", "update", "NoTimeout")


def windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour", stream: bool = False) -> DataFrame:
    """STM-06: counts and sums of events in tumbling or sliding windows; with a watermark on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if stream else e
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", stream: bool = False) -> DataFrame:
    """STM-06: each user's sessions."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if stream else e
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
