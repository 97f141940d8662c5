"""Jobs that act when their time comes: retries with waits and retention, and scores that decay once a period.

Both keep state by key in RocksDB and set timers on event time, so that the clock is the stream's watermark: rows move it, and
so do ticks, rows of a time and no key. Before a row is taken, what was due until then happens first, so that the result
does not depend on how rows fall into batches, as long as every row is newer than the watermark, the clock of the batch before
less `late`, and than 1970. Spark drops the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions import errors
from ..operators import lifecycle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "chunk_id long, action string, at timestamp, attempt int"
SCORES = "fact_id long, user_score double, at timestamp"


def start(writer: DataStreamWriter, spark: SparkSession):
    """Starts a stream with the state store that timers need; the session's own setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def wait_ms(chunk_id: int, attempt: int, longest: int = 30, jitter: float = 0.0) -> int:
    """RS-03: milliseconds to wait after an attempt: doubling, and up to `jitter` of that more, by chunk and attempt."""
    whole = 1000 * errors.backoff(max(0, attempt), longest)
    return whole + int(whole * jitter * (crc32(f"{chunk_id}:{attempt}".encode()) / 2**32))


class _Retries(StatefulProcessor):
    """An entry a chunk: (status, attempt, due, ends); due and ends in milliseconds, due null when nothing is waited for."""

    def __init__(self, budget: int, keep_ms: int, longest: int, jitter: float):
        self.budget, self.keep_ms, self.longest, self.jitter = budget, keep_ms, longest, jitter

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "attempt int, due long, ends long, last long")

    def _happened(self, chunk: int, entry, until: int) -> tuple[list[Row], tuple | None]:
        """What an entry does until a time, and what is left of it."""
        out = []
        if entry and entry[1] is not None and entry[1] <= until:
            out.append(_action(chunk, "retry", entry[1], entry[0]))
            entry = (entry[0], None, *entry[2:])
        if entry and entry[2] <= until:
            out.append(_action(chunk, "expired", entry[2], entry[0]))
            entry = None
        return out, entry

    def _kept(self, old, new) -> None:
        """Stores an entry; its timers are those of its times."""
        times = lambda e: {t for t in e[1:3] if t is not None} if e else set()
        for t in times(old) - times(new):
            self.handle.deleteTimer(t)
        for t in times(new) - times(old):
            self.handle.registerTimer(t)
        if new:
            self.entry.update(new)
        elif old:
            self.entry.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chunk = key[0]
        if chunk is None:  # ticks
            for _ in rows:
                pass
            return
        old = tuple(self.entry.get()) if self.entry.exists() else None
        entry = old
        for r in sorted(rows, key=lambda r: (r["ms"], r["error_class"] is None, r["attempt"], r["error_class"] or "")):
            done, entry = self._happened(chunk, entry, r["ms"])
            yield from done
            if entry and r["ms"] < entry[3]:
                continue  # older than what is known of the chunk
            if r["error_class"] is None:
                if entry:
                    yield _action(chunk, "done", r["ms"], entry[0])
                entry = None
                continue
            attempt, ends = r["attempt"], r["ms"] + self.keep_ms
            if r["error_class"] in errors.RETRYABLE and attempt + 1 < self.budget:
                due = r["ms"] + wait_ms(chunk, attempt, self.longest, self.jitter)
                entry = (attempt, due, max(ends, due), r["ms"])
            else:
                yield _action(chunk, "dead", r["ms"], attempt)
                entry = (attempt, None, ends, r["ms"])
        self._kept(old, entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.entry.exists():
            return
        old, at = tuple(self.entry.get()), expiredTimerInfo.getExpiryTimeInMs()
        done, entry = self._happened(key[0], old, at)
        yield from done
        if entry:
            self.entry.update(entry)
        else:
            self.entry.clear()

    def close(self) -> None:
        pass


def _action(chunk: int, action: str, ms: int, attempt: int) -> Row:
    return Row(chunk_id=chunk, action=action, at=ms, attempt=attempt)


def _clocked(stream: DataFrame, late: str) -> DataFrame:
    """Rows with a time, which moves the watermark; the time in milliseconds too."""
    timed = stream.filter("at IS NOT NULL").withColumn("at", F.col("at").cast("timestamp"))
    return timed.withColumn("ms", F.unix_millis("at")).withWatermark("at", late)


def _times(out: DataFrame) -> DataFrame:
    return out.withColumn("at", F.timestamp_millis("at"))


def retries(events: DataFrame, budget: int = 3, keep: int = 30 * 86400, longest: int = 30, jitter: float = 0.0, late: str = "0 seconds") -> DataFrame:
    """STM-04, RS-01..03: a stream of what became of chunks (chunk_id, at, error_class, attempt) -> (chunk_id, action, at, attempt).

    A failure that can be retried is `retry` once its wait is over, unless the chunk is tried before; one that cannot, or whose
    attempt (from 0) is the budget's last, is `dead` at once; a success (error_class null) of an entry is `done`. An entry that
    nothing happens to for `keep` seconds is `expired`. Null attempts are 0; of rows of one time, failures come first, by attempt
    and class; rows older than the chunk's last change nothing. Rows without chunk are ticks of the clock, rows without time nothing.
    """
    e = _clocked(events, late).select(F.col("chunk_id").cast("long").alias("chunk_id"), "at", "ms", "error_class", F.coalesce("attempt", F.lit(0)).cast("int").alias("attempt"))
    out = e.groupBy("chunk_id").transformWithState(_Retries(budget, 1000 * keep, longest, jitter), ACTIONS.replace("timestamp", "long"), "Append", "EventTime")
    return _times(out)


class _Decay(StatefulProcessor):
    """(score, period up to which it has decayed, last vote) of a fact; facts of score 1 have no state."""

    def __init__(self, rate: float, period_ms: int, least: float):
        self.rate, self.period_ms, self.least = rate, period_ms, least

    def init(self, handle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "score double, period long")

    def _decayed(self, score: float, periods: int) -> float:
        return 1.0 + (score - 1.0) * (1.0 - self.rate) ** max(0, periods)

    def _kept(self, old, score: float, period: int) -> float:
        """Stores a score with its next timer; a score next to 1 is 1 and has neither."""
        if old and old[1] != period:
            self.handle.deleteTimer((old[1] + 1) * self.period_ms)
        if abs(score - 1.0) < self.least:
            if old:
                self.handle.deleteTimer((old[1] + 1) * self.period_ms)
                self.score.clear()
            return 1.0
        if not old or old[1] != period:
            self.handle.registerTimer((period + 1) * self.period_ms)
        self.score.update((score, period))
        return score

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # ticks
            for _ in rows:
                pass
            return
        old = tuple(self.score.get()) if self.score.exists() else None
        score, period, ms = *(old or (1.0, None)), 0
        for r in sorted(rows, key=lambda r: (r["ms"], r["seq"])):
            ms = r["ms"]
            now = ms // self.period_ms
            if period is not None:
                score = self._decayed(score, now - period)
            period = now if period is None else max(period, now)
            score = min(2.0, max(0.0, score + r["delta"]))
        yield Row(fact_id=key[0], user_score=self._kept(old, score, period), at=ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.score.exists():
            return
        score, period = tuple(self.score.get())
        due = expiredTimerInfo.getExpiryTimeInMs() // self.period_ms
        now = max(due, timerValues.getCurrentWatermarkInMs() // self.period_ms)  # all periods that have gone by, at once
        score = self._decayed(score, now - period)
        if abs(score - 1.0) < self.least:
            score = 1.0
            self.score.clear()
        else:
            self.score.update((score, now))
            self.handle.registerTimer((now + 1) * self.period_ms)
        yield Row(fact_id=key[0], user_score=score, at=now * self.period_ms)

    def close(self) -> None:
        pass


def decaying_scores(votes: DataFrame, rate: float = 0.01, period: int = 7 * 86400, least: float = 1e-6, late: str = "0 seconds") -> DataFrame:
    """STM-04, UPD-06: a stream of votes (fact_id, at, seq, delta) -> each fact's score as it changes (fact_id, user_score, at).

    Votes add, by time and then seq, and the score is held to 0..2. Whenever a period of so many seconds since 1970 ends, a score
    loses `rate` of its distance from 1; a clock that jumps over several periods applies them all in one row. Scores nearer
    to 1 than `least` are 1, and are not kept. The greatest `at` of a fact is its last row. A null delta is 0.
    """
    v = _clocked(votes, late).select(F.col("fact_id").cast("long").alias("fact_id"), "at", "ms", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("delta", F.lit(0)).cast("double").alias("delta"))
    out = v.groupBy("fact_id").transformWithState(_Decay(rate, 1000 * period, least), SCORES.replace("timestamp", "long"), "Update", "EventTime")
    return _times(out)


def retrying(events_dir: str, chunks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, extractor: lifecycle.Extractor = lifecycle.rule_extractor, **how):
    """STM-04, DLQ-01: the loop as a job: due chunks(id, file_id, content) are extracted, their facts go to the sink with the batch's
    number, and what became of them is written to `events_dir` as new rows of the stream, a folder a batch.

    A batch that is run again after a crash overwrites its own folder. Rows: chunk_id, at, error_class, attempt, in Parquet.
    A try happens at the time it was due. Runs until all rows there at the start are read; rows it writes are the next run's.
    """
    spark = chunks.sparkSession
    rows = spark.readStream.schema("chunk_id long, at timestamp, error_class string, attempt int").parquet(f"{events_dir}/*")

    def each(batch: DataFrame, number: int) -> None:
        due = lifecycle.materialize(batch.filter("action = 'retry'").select("chunk_id", "at", F.col("attempt") + 1), "due").toDF("chunk_id", "at", "attempt")
        ids = due.select(F.col("chunk_id").alias("id"))
        raw = lifecycle.materialize(lifecycle.extract(chunks.join(ids, "id", "left_semi"), extractor, attempts=1), "extracted")
        bad = raw.filter("error IS NOT NULL").groupBy("chunk_id").agg(F.min("error_class").alias("error_class"))
        sink(lifecycle.extracted_facts(raw), number)
        due.join(bad, "chunk_id", "left").select("chunk_id", "at", "error_class", "attempt").write.mode("overwrite").parquet(f"{events_dir}/tried-{number}")

    return start(retries(rows, **how).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True), spark)
