"""Stored chats against a list that is changed one call after another."""

import random
import uuid

import pytest
from factloom.operators import chats
from factloom.plans import runtime
from pyspark.sql import functions as F

TURN = "seq long, kb_name string, session_id string, role string, content string, sources string, created_at timestamp"


def new(spark):
    return chats.ChatLog(spark, f"{runtime.shared_dir(spark)}/chats-{uuid.uuid4().hex}", buckets=4)


def test_a_list_of_calls(spark):
    rnd, log, rows, last = random.Random(3), new(spark), [], 0
    for step in range(3):
        turns = [(i + 1, rnd.choice("xy"), rnd.choice("abc"), rnd.choice(["user", "assistant"]), f"{step}.{i}", None, None) for i in range(8)]
        log.save(spark.createDataFrame(turns, TURN))
        rows += [[last + s, k, c, r, t, None] for s, k, c, r, t, *_ in turns]
        last += 8
        rated = [(n, rnd.randrange(1, last + 3), rnd.choice(["positive", "negative", None])) for n in range(6)]
        log.rate(spark.createDataFrame(rated, "seq long, id long, feedback_given string"))
        for _, i, f in rated:
            for r in rows:
                r[5] = f if r[0] == i else r[5]
        kb, session = rnd.choice("xy"), rnd.choice("abc")
        gone = [r for r in rows if r[1:3] == [kb, session]]
        assert log.delete(spark.createDataFrame([(kb, session), (kb, session), ("z", "a")], "kb_name string, session_id string")) == len(gone)
        rows = [r for r in rows if r not in gone]
        if step == 1:
            log.merge()
            assert len(log.files.segments()) == 1
        got = log.messages().select("id", "kb_name", "session_id", "role", "content", "feedback_given").orderBy("id").collect()
        assert [list(r) for r in got] == rows
    for session in "abc":
        got = log.history("x", session)
        assert [r.id for r in got.collect()] == [r[0] for r in rows if r[1:3] == ["x", session]]
    n = {r.session_id: r.turns for r in log.sessions("x").collect()}
    assert n == {s: sum(r[3] == "user" for r in rows if r[1:3] == ["x", s]) for s in {r[2] for r in rows if r[1] == "x"}}
    plan = log.history("x", "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_sessions_of_their_own_and_wrong_turns(spark):
    log = new(spark)
    assert log.messages().count() == 0 and log.sessions("x").count() == 0 and log.history("x", "a").count() == 0
    log.merge()
    log.save(spark.createDataFrame([], TURN))
    assert log.delete(spark.createDataFrame([("x", "a")], "kb_name string, session_id string")) == 0
    given = log.save(spark.createDataFrame([(1, "x", None, "user", "q", '["f1", {"p": 2}]', None), (2, "x", "", "user", None, "no JSON", None)], TURN)).collect()
    assert len({r.session_id for r in given}) == 2 and all(len(r.session_id) == 12 for r in given)
    stored = {r.id: r.session_id for r in log.messages().collect()}
    assert stored == {r.id: r.session_id for r in given}
    one = [log.history("x", stored[i]).first() for i in (1, 2)]
    assert one[0].sources == ["f1", '{"p":2}'] and one[1].sources == [] and one[0].related_facts == []
    for wrong in ([(1, None, "a", "user", "q", None, None)], [(1, "x", "a", "user", "q", None, None)] * 2, [(0, "x", "a", "user", "q", None, None)], [(None, "x", "a", "user", "q", None, None)]):
        with pytest.raises(ValueError):
            log.save(spark.createDataFrame(wrong, TURN))
    assert log.messages().agg(F.count("*")).first()[0] == 2
