"""Index runs over a stored knowledge base: killed, resumed, stopped, repeated, and with changed files."""

import pytest

from factloom.operators import graph, lifecycle
from factloom.operators.indexed import IndexedBase, dead_letter_classes
from pyspark.sql import functions as F

NAMES = ["Anna", "Bela", "Carl", "Dora", "Emil", "Fred", "Gina", "Hugo"]


def listing(spark, files):
    df = spark.createDataFrame([(p, t) for p, t in files.items()], "path string, text string")
    return df.select("path", F.sha2("text", 256).alias("sha256"), "text")


def state(base):
    """All that a reader sees, as plain values."""
    facts = base.table("facts").withColumn("status", F.lit("active"))
    out = {n: sorted(map(str, base.table(n).collect())) for n in ("files", "chunks", "facts", "vectors", "failed_chunks")}
    out["edges"] = sorted(map(str, base.graph.edges().select("src", "dst", "fact_id").collect()))
    assert out["edges"] == sorted(map(str, graph.build_edges(facts).select("src", "dst", "fact_id").collect()))
    return out


FILES = {f"/k/{n.lower()}.md": f"{n} is a friend of {m}.\n\n{n} is tall." for n, m in zip(NAMES, NAMES[1:] + NAMES[:1])}


def test_killed_run_is_taken_up(spark, tmp_path):
    whole = IndexedBase(spark, str(tmp_path / "whole"))
    assert whole.run(listing(spark, FILES), batch_files=2) == {"run": 1, "status": "completed", "files_changed": 8, "facts_added": 16, "facts_removed": 0}
    want = state(whole)

    def dies(chunk, r):
        if "Hugo is tall" in chunk or "Emil is tall" in chunk:
            raise SystemExit("killed")
        return lifecycle.rule_extractor(chunk, r)

    base = IndexedBase(spark, str(tmp_path / "base"))
    with pytest.raises(Exception):  # noqa: B017  whatever the lost task is reported as
        base.run(listing(spark, FILES), dies, batch_files=2)
    part = base.table("files").count()
    assert part < 8 and state(base)["facts"] == [f for f in want["facts"] if any(repr(p)[1:-1] in f for p in {r.path for r in base.table("files").collect()})]
    again = base.run(listing(spark, FILES), batch_files=2)
    assert again["files_changed"] == 8 - part and again["status"] == "completed"
    assert state(base) == want
    assert [r["status"] for r in base.runs()] == (["crashed", "completed"] if part else ["completed"])
    assert base.run(listing(spark, FILES), batch_files=2)["files_changed"] == 0 and state(base) == want


def test_changed_vanished_failed_and_single_files(spark, tmp_path):
    base = IndexedBase(spark, str(tmp_path / "base"))

    def refuses(chunk, r):
        if "Gina" in chunk:
            raise RuntimeError("request timed out")
        return lifecycle.rule_extractor(chunk, r)

    first = base.run(listing(spark, FILES), refuses)
    assert first["files_changed"] == 8
    failed = {r.path for r in base.table("files").filter("status = 'failed'").collect()}
    assert failed == {"/k/fred.md", "/k/gina.md"} and {r.error_class for r in dead_letter_classes(base).collect()} == {"TIMEOUT"}
    now = {p: t for p, t in FILES.items() if p != "/k/anna.md"} | {"/k/bela.md": "Bela is old.", "/k/new.md": "Ida is new."}
    second = base.run(listing(spark, now))
    assert second["status"] == "completed" and second["files_changed"] == 4 and second["facts_removed"] == 4
    fresh = IndexedBase(spark, str(tmp_path / "fresh"))
    fresh.run(listing(spark, now), batch_files=3)
    assert state(base) == state(fresh)
    # One file anew: the same facts, nothing else touched.
    third = base.run(listing(spark, now), only="/k/carl.md")
    assert third["files_changed"] == 1 and third["facts_added"] == third["facts_removed"] == 2 and state(base) == state(fresh)


def test_stop_and_empty(spark, tmp_path):
    base = IndexedBase(spark, str(tmp_path / "base"))
    assert base.run(listing(spark, FILES), batch_files=2, stop=lambda: base.table("files").count() > 0)["status"] == "stopped"
    assert 0 < base.table("files").count() < 8
    assert base.run(listing(spark, FILES).limit(0))["status"] == "completed" and base.table("facts").count() == 0 and base.graph.edges().count() == 0


def test_batches_read_their_own_rows(spark, tmp_path):
    """A listing's texts are made as often in eight batches as in one, and each is cut into chunks once."""
    made, cut = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(t):
        made.add(1)
        return t

    def extractor(chunk, r):
        cut.add(1)
        return lifecycle.rule_extractor(chunk, r)

    base, counts = IndexedBase(spark, str(tmp_path / "base")), []
    for n, suffix in ((8, ""), (1, " Ida is old.")):
        made.value = cut.value = 0
        base.run(listing(spark, {p: t + suffix for p, t in FILES.items()}).withColumn("text", told("text")), extractor, batch_files=n)
        counts.append((made.value, cut.value))
    assert counts[0] == counts[1] and counts[0][1] == 16
    assert base.table("chunks").count() == 8 and len(base.runs()) == 2


def test_batches_are_bounded(spark, tmp_path):
    """the batches of a run don't grow in number with its files, and hold all of them."""
    base = IndexedBase(spark, str(tmp_path / "base"))
    files = listing(spark, {f"/k/{i}.md": f"Text {i}." for i in range(60)})
    found = base._dealt(files, 1, f"{tmp_path}/at")
    assert 1 < len(found) <= 16
    rows = [r.path for i in found for r in spark.read.parquet(f"{tmp_path}/at/work/batch={i}").collect()]
    assert sorted(rows) == sorted(r.path for r in files.collect())
    assert len(base._dealt(files, 1, f"{tmp_path}/more", 60)) > 16
