"""Timed retries, retention and decay against a loop over a manual clock."""

import datetime
import random
import uuid

from factloom.functions import errors
from factloom.operators import lifecycle
from factloom.plans import runtime
from factloom.streaming import timed
from pyspark.sql import functions as F

EVENT = "chunk_id long, at timestamp, error_class string, attempt int"
VOTE = "fact_id long, at timestamp, seq long, delta double"


def t(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)


def run(spark, at, batches, schema, build, mode, name):
    """Each list of rows as one micro-batch, in one query's checkpoint; what it gives, by batch."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{at}/in/{i:03d}")
        stream = spark.readStream.schema(schema).parquet(f"{at}/in/*")
        w = build(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{at}/out/{name}")).outputMode(mode).option("checkpointLocation", f"{at}/cp").trigger(availableNow=True)
        timed.start(w, spark).awaitTermination()
        got = spark.read.parquet(f"{at}/out/{name}").collect()
        out.append(sorted((tuple(r) for r in got), key=repr))
    return out


def brute_retries(rows, now, budget, keep):
    """Chunk by chunk, one row after another."""
    out = []
    for c in {r[0] for r in rows if r[0] is not None}:
        own = sorted((r[1].timestamp(), r[2] is None, r[3] or 0, r[2] or "") for r in rows if r[0] == c)
        state = None
        for at, ok, attempt, cls in [*own, (now, None, 0, "")]:
            if state and state[1] is not None and state[1] <= at:
                out.append((c, "retry", state[1], state[0]))
                state[1] = None
            if state and state[2] <= at:
                out.append((c, "expired", state[2], state[0]))
                state = None
            if ok is None:
                break
            if ok:
                out += [(c, "done", at, state[0])] if state else []
                state = None
            elif cls in errors.RETRYABLE and attempt + 1 < budget:
                state = [attempt, at + min(2**attempt, 30), at + keep]
            else:
                out.append((c, "dead", at, attempt))
                state = [attempt, None, at + keep]
    return sorted(out)


def test_retries_by_the_clock(spark):
    rnd, budget, keep = random.Random(5), 4, 60
    batches = []
    for b in range(3):
        own = [(rnd.randrange(12), t(1000 + 40 * b + rnd.randrange(40)), rnd.choice(["TIMEOUT", "RATE_LIMIT", "UNKNOWN", None]), rnd.choice([0, 1, 2, 3, None])) for _ in range(25)]
        batches.append([*own, (None, t(1000 + 40 * b + 39.5), None, None), (3, None, "TIMEOUT", 0)])
    batches.append([(None, t(1400.0), None, None)])
    at = f"{runtime.shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    got = run(spark, at, batches, EVENT, lambda s: timed.retries(s, budget, keep), "append", "a")
    for i, g in enumerate(got):
        rows = [r for b in batches[: i + 1] for r in b if r[1] is not None]
        now = max(r[1] for r in rows).timestamp()
        # An action of exactly the clock's time may come with the next tick.
        sure = lambda x: {a for a in x if a[2] < now}  # noqa: B023, E731
        mine = [(c, a, x.replace(tzinfo=datetime.timezone.utc).timestamp(), n) for c, a, x, n in g]
        assert len(mine) == len(set(mine)) and sure(mine) == sure(brute_retries(rows, now, budget, keep)), i
    assert {a[1] for a in got[-1]} == {"retry", "dead", "done", "expired"}
    assert spark.conf.get(timed._PROVIDER, None) != timed._ROCKSDB


def test_waits():
    assert [timed.wait_ms(1, a) for a in (0, 1, 2, 9)] == [1000, 2000, 4000, 30000]
    waits = {timed.wait_ms(c, 3, jitter=0.5) for c in range(50)}
    assert len(waits) > 40 and all(8000 <= w < 12000 for w in waits)


def test_scores_decay_once_a_period(spark):
    rnd, rate, period = random.Random(8), 0.25, 100
    batches = [[(rnd.randrange(8), t(100 * b + rnd.randrange(100)), i, rnd.choice([0.7, -0.7, 0.2, None])) for i in range(20)] + [(None, t(100 * b + 99.5), None, None)] for b in range(3)]
    batches += [[(None, t(350.0), None, None)], [(None, t(900.5), None, None)], [(None, t(1e5), None, None)]]
    at = f"{runtime.shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    got = run(spark, at, batches, VOTE, lambda s: timed.decaying_scores(s, rate, period, late="0 seconds"), "update", "a")

    for i, g in enumerate(got):
        rows = [r for b in batches[: i + 1] for r in b]
        now, want = max(r[1] for r in rows).timestamp(), {}
        for f in {r[0] for r in rows if r[0] is not None}:
            score, last = 1.0, 0
            for x, _, d in sorted((r[1].timestamp(), r[2], r[3] or 0.0) for r in rows if r[0] == f):
                for _ in range(int(x // period) - last):
                    score += (1.0 - score) * rate
                last = int(x // period)
                score = min(2.0, max(0.0, score + d))
            for _ in range(min(200, int(now // period) - last)):
                score += (1.0 - score) * rate
            want[f] = round(score, 5)
        mine = {}
        for f, s, x in sorted(g, key=lambda r: (r[0], r[2])):
            mine[f] = round(s, 5)
        assert mine == want, i


def test_failures_come_back_as_events(spark):
    """Chunk 1 works at its second try, chunk 2 never; both failed at first."""
    at = f"{runtime.shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    chunks = spark.createDataFrame([(1, 1, "Ada is old."), (2, 1, "bad"), (3, 1, "Eve is new.")], "id long, file_id long, content string")

    def ask(chunk, r):
        if chunk == "bad":
            raise TimeoutError("timed out")
        return lifecycle.rule_extractor(chunk, r)

    spark.createDataFrame([(1, t(10.0), "TIMEOUT", 0), (2, t(10.0), "TIMEOUT", 0)], EVENT).write.parquet(f"{at}/in/first")
    for i, now in enumerate((12, 20, 40, 60)):
        spark.createDataFrame([(None, t(float(now)), None, None)], EVENT).write.parquet(f"{at}/in/tick-{i}")
        timed.retrying(f"{at}/in", chunks, lambda f, n: f.write.mode("overwrite").parquet(f"{at}/facts/{n}"), f"{at}/cp", ask, budget=3, late="8 seconds").awaitTermination()
    facts = spark.read.parquet(f"{at}/facts/*").select("chunk_id", "subject", "object").collect()
    assert [tuple(f) for f in facts] == [(1, "Ada", "old")]
    tried = spark.read.parquet(f"{at}/in/tried-*").select("chunk_id", "error_class", "attempt").collect()
    assert {tuple(r) for r in tried} >= {(1, None, 1), (2, "TIMEOUT", 1)}
