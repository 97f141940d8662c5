"""Lasting decisions on names against a loop, and over index runs."""

import random

import pytest

from factloom.operators import decisions, graph, relational
from factloom.operators.decisions import Decisions
from factloom.operators.indexed import IndexedBase
from pyspark.sql import functions as F

_ROW = "seq long, kind string, name string, new_name string, proposal_id long, target long"


def rows(spark, *given):
    return spark.createDataFrame([(i, *g, *[None] * (5 - len(g))) for i, g in enumerate(given, 1)], _ROW)


def looped(facts, log):
    """facts {id: (subject, object, status)} after the log, a decision at a time."""
    dead = set()
    for seq, kind, *_, target in reversed(log):
        if kind == "undo" and seq not in dead:
            dead.add(target)
    now = {i: [s, o, st] for i, (s, o, st) in facts.items()}
    for seq, kind, name, new, _, _ in log:
        for f in now.values():
            if seq in dead or kind not in ("rename", "delete") or f[2] != "active" or name not in f[:2]:
                continue
            if kind == "delete":
                f[2] = "gone"
            else:
                f[:2] = [new if x == name else x for x in f[:2]]
    return {i: (*facts[i][:2], "deleted") if f[2] == "gone" else tuple(f) for i, f in now.items()}


def test_random_logs_equal_the_loop(spark, tmp_path):
    rnd = random.Random(4)
    facts = {i: (rnd.choice("abcdefg"), rnd.choice("abcdefg"), "active" if i % 9 else "deleted") for i in range(120)}
    df = spark.createDataFrame([(i, *f, "k") for i, f in facts.items()], "id long, subject string, object string, status string, final string")
    for turn in range(3):
        log = []
        for seq in range(1, 15):
            kind = rnd.choices(["rename", "delete", "undo"], [8, 1, 2 if turn else 0])[0]
            given = (None, None, None, rnd.randint(1, seq)) if kind == "undo" else (rnd.choice("abcdefg"), rnd.choice("abcdefg") if kind == "rename" else None, None, None)
            log.append((seq, kind, *given))
        log = [r for r in log if not (r[1] == "undo" and r[5] >= r[0])]
        kept = Decisions(spark, str(tmp_path / f"log{turn}"))
        kept.commit(kept.prepared(spark.createDataFrame(log, _ROW)))
        got = {r["id"]: (r["subject"], r["object"], r["status"]) for r in kept.resolve(df).collect()}
        assert got == looped(facts, log), log


def test_a_long_chain_and_wrong_rows(spark, tmp_path):
    kept = Decisions(spark, str(tmp_path / "log"))
    kept.take(rows(spark, *[("rename", f"n{i}", f"n{i + 1}") for i in range(40)]))
    kept.take(rows(spark, ("rename", "n40", " last "), ("rename", "other", "other")))
    assert {r["final"] for r in kept.final_names().collect()} == {"last"} and kept.final_names().count() == 41
    for wrong in (("rename", "a", "  "), ("delete", ""), ("rename", None, "b"), ("crown", "a"), (None, "a")):
        with pytest.raises(ValueError):
            kept.take(rows(spark, ("delete", "n1"), wrong))
    assert kept.log().count() == 42
    kept.take(rows(spark).limit(0))
    assert kept.log().count() == 42 and kept.resolve(spark.createDataFrame([(1, None, "n3", "active")], "id long, subject string, object string, status string")).first()["object"] == "last"


def test_proposals_are_settled_and_new_names_protected(spark, tmp_path):
    told = spark.createDataFrame([(i, f"e{i}", "", 0.5, "proposed", i, "suspect") for i in range(1, 6)], "id long, entity_a string, entity_b string, confidence double, status string, created_at long, proposal_type string")
    kept = Decisions(spark, str(tmp_path / "log"))
    kept.take(rows(spark, ("rename", "e1", "Anna", 1), ("delete", "e2", None, 2), ("ignore", None, None, 3), ("rename", "e4", "Bela", 4), ("ignore", None, None, 5), ("reopen", None, None, 5)))
    status = lambda: {(r["entity_a"], r["status"]) for r in kept.proposals(told).collect()}
    assert status() == {("e1", "approved"), ("e2", "deleted"), ("e3", "rejected"), ("e4", "approved"), ("e5", "proposed"), ("Anna", "approved"), ("Bela", "approved")}
    kept.take(rows(spark, ("undo", None, None, None, 4)))
    assert ("e4", "proposed") in status() and not any(a == "Bela" for a, _ in status())
    flagged = spark.createDataFrame([("Anna",), ("Bela",)], "name string")
    assert [r["name"] for r in relational.not_proposed(flagged, kept.proposals(told)).collect()] == ["Bela"]


def test_runs_keep_decisions(spark, tmp_path):
    def listing(files):
        return spark.createDataFrame(list(files.items()), "path string, text string").select("path", F.sha2("text", 256).alias("sha256"), "text")

    def seen():
        facts, edges = base.facts(), base.graph.edges()
        want = graph.build_edges(facts)
        assert sorted(map(str, edges.select("src", "dst", "fact_id").collect())) == sorted(map(str, want.select("src", "dst", "fact_id").collect()))
        return sorted((r["subject"], r["object"]) for r in facts.filter("status = 'active'").collect())

    base = IndexedBase(spark, str(tmp_path / "base"))
    files = {"/k/a.md": "Anna is a friend of Bela.", "/k/c.md": "Carl is tall."}
    base.run(listing(files))
    assert seen() == [("Anna", "a friend of Bela"), ("Carl", "tall")]
    assert base.decide(rows(spark, ("rename", "Anna", "Anne"), ("delete", "tall"))) == 2
    assert seen() == [("Anne", "a friend of Bela")]
    files |= {"/k/d.md": "Anna is old. Dora is tall.", "/k/a.md": "Anna is a singer."}
    base.run(listing(files))
    assert seen() == [("Anne", "a singer"), ("Anne", "old")]
    base.decide(rows(spark, ("undo", None, None, None, 2)))
    assert seen() == [("Anne", "a singer"), ("Anne", "old"), ("Carl", "tall"), ("Dora", "tall")]
    base.decide(rows(spark, ("undo", None, None, None, 1), ("rename", "Dora", "Theodora")))
    assert seen() == [("Anna", "a singer"), ("Anna", "old"), ("Carl", "tall"), ("Theodora", "tall")]
    assert decisions.standing(base.names.log()).count() == 1
