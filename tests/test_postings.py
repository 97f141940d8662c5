"""The stored full-text index against the scan of all rows."""

import random

from factloom.operators import fulltext, postings

SCHEMA = "id long, subject string, predicate string, object string, status string"
WORDS = ["amber", "birch", "cedar", "Delta", "élan", "fern", "x_y", "grove"]


def make(rng, ids):
    return [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 14))), rng.choice(WORDS), rng.choice(["", *WORDS[:3]]), rng.choice(["active"] * 4 + ["deleted"])) for i in ids]


QUERIES = ["amber", "cedar delta", "elan OR fern", "birch NOT amber", "x_y grove OR delta NOT fern", "nowhere", "nowhere OR amber", "()", "NOT amber", '"cedar" (birch)?']


def same(spark, index, rows, queries=QUERIES):
    df = spark.createDataFrame(rows, SCHEMA)
    for q in queries:
        for limit in (5, None) if "OR" in q else (5,):
            got = [(r.id, round(r.score, 9)) for r in index.search(q, limit).collect()]
            assert got == [(r.id, round(r.score, 9)) for r in fulltext.search(df, "id", q, limit).collect()], (q, limit)


def test_changes_and_merge(spark, tmp_path, monkeypatch):
    """Inserts, updates, soft deletes and deletes as segments give the rows of a scan; so does their merge, and a reader of the path."""
    monkeypatch.setattr(postings, "SPAN", 16)
    monkeypatch.setattr(postings, "FIRST", 2)
    rng = random.Random(11)
    rows = make(rng, [*range(60), *range(10**12, 10**12 + 40), -5])
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    index = postings.build(frame(rows), str(tmp_path / "index"))
    same(spark, index, rows)
    put = make(rng, range(100, 130))
    index.change(put=frame(put))
    rows += put
    old = rows[10:40]
    new = [(i, s, "amber", o, "active") for i, s, _, o, _ in old]
    index.change(put=frame(new), taken=frame(old))
    rows[10:40] = new
    gone, rows = rows[:15], rows[15:]
    index.change(taken=frame(gone))
    same(spark, index, rows, QUERIES[1:4])
    index.merge()
    assert len(index.segments) == 1
    index.change(put=frame(gone[:4]))  # an id that was taken out may come back
    rows += gone[:4]
    same(spark, postings.Index(spark, index.path), rows, QUERIES[2:4])
    totals = {r.term: r.df for r in index.totals().collect()}
    assert totals == {t.term: t["count"] for t in fulltext.postings(frame(rows), "id").groupBy("term").count().collect()}


def test_bounds_spare_postings(spark, tmp_path, monkeypatch):
    """Long rows cannot reach the best short ones: their cells are not read, and neither are other terms' buckets."""
    monkeypatch.setattr(postings, "FIRST", 1)
    rows = [(i, "cedar " + "filler " * (i % 40), "p", "", "active") for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    index = postings.build(df, str(tmp_path / "index"))
    got = index.search("cedar", 10, measure=True)
    assert [r.id for r in got.collect()] == [r.id for r in fulltext.search(df, "id", "cedar", 10).collect()]
    assert index.read["postings"] == 800 and index.read["read"] < 200
    plan = index.search("cedar", None)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term") and "subject" not in plan


def test_rows_are_bounded(spark, tmp_path, monkeypatch):
    """a frequent term's occurrences stand in rows of a bounded number, before and after a merge, with the results of a scan."""
    rows = [(i, "cedar " + "filler " * (i % 3), "p", "", "active") for i in range(2500)]
    index = postings.build(spark.createDataFrame(rows[:2000], SCHEMA), str(tmp_path / "index"))
    index.change(put=spark.createDataFrame(rows[2000:], SCHEMA), taken=spark.createDataFrame(rows[:700], SCHEMA))
    for _ in range(2):
        held = index._postings(index.segments).select("term", "cell", "n", "max_tf", "min_dl", "ids", "tfs", "dls").collect()
        assert max(r.n for r in held) <= 512 and all(r.n == len(r.ids) == len(r.tfs) and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls) for r in held)
        same(spark, index, rows[700:], ["cedar", "filler NOT nowhere"])
        index.merge()
    assert sum(r.n for r in held if r.term == "cedar") == 1800


def test_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "index"))
    assert index.search("amber").count() == 0 and index.totals().count() == 0
    assert postings.Index(spark, str(tmp_path / "none")).search("amber").count() == 0
