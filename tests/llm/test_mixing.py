import random
import re

from factloom.llm import mixing as M

DOCS = "doc_id long, text string, source string, size int, _key string"


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    capped = set()
    while True:
        room = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        t = {s: 2.0 * sizes[s] if s in capped else room * weight[s] / w for s in names}
        over = {s for s in names if t[s] > 2 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_targets_and_taken(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        s = rng.choice(["b", "b", "b", "a", "é", "z", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) if i % 17 else None, s, 1, "x"))
    rows += [(5000, "x " * 3000, "tiny", 1, "x")] + [rows[5]] * 3
    out = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken = {}
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        assert len(r.positions) == (0 if not r.taken else 1 if r.taken <= r.size else 2) and all(0 <= p <= 1 for p in r.positions)
        assert r.positions == sorted(r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "one two", s, 0, "") for i, s in enumerate(["a", "b", "c"] * 600)]
    out = M.mix(spark.createDataFrame(rows, DOCS)).collect()
    by = {s: sorted(p for r in out if r.source == s for p in r.positions) for s in "abc"}
    share = lambda s, t: sum(p <= t for p in by[s]) / len(by[s])
    assert abs(share("a", 0.5) - 0.625) < 0.01 and abs(share("b", 0.5) - 0.5) < 0.01
    assert abs(share("c", 0.5) - (0.5 * 0.625) / (0.5 * 0.625 + 0.5 * 1.375)) < 0.01


def test_training_order_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1, ""), (2, "c d e", "t", 1, ""), (3, None, None, 1, "")], DOCS)
    out = M.training_order(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {1, 2}
    assert M.mix(df.limit(0)).count() == 0 and M.training_order(df.limit(0)).count() == 0


def test_training_order_of_repeated_and_null_ids(spark, tmp_path):
    """Each row comes as often as the mix takes it, whatever its doc_id: repeated, null, equal rows, equal texts."""
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 1, 2, i]), rng.choice(["a b c d", "e f g", f"w{i} x", None, ""]), rng.choice("stu"), 1, "") for i in range(150)]
    df = spark.createDataFrame([*rows, *rows[:20]], DOCS)
    df.write.parquet(str(tmp_path / "docs"))
    for d in (df, spark.read.parquet(str(tmp_path / "docs"))):
        own = sorted(((r.doc_id, r.source, r.size, len(r.positions)) for r in M.mix(d).collect()), key=repr)
        want = {}
        for i, s, n, copies in own:
            want[i, s, n] = want.get((i, s, n), 0) + copies
        got = {}
        for r in M.training_order(d).collect():
            k = (r.doc_id, r.source, len((r.text or "").split()))
            got[k] = got.get(k, 0) + 1
        assert got == {k: n for k, n in want.items() if n}
        words = sum(n * c for (_, _, n), c in got.items())
        taken = sum(r.taken for r in M.mix(d).collect())
        assert taken <= words <= taken + 3 * 3 * 4  # a document at the border of each source's copies is kept whole


def test_oracle(spark, sf):
    """The query's rows, positions included, are those of the SQL, to the last bit; and they come in order of position."""
    import duckdb

    from factloom.llm.queries import op3_curriculum_mix

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(M.ORACLE).fetchall(), key=repr)
    out = op3_curriculum_mix(spark, sf).collect()
    assert sorted(map(tuple, out), key=repr) == want
    assert sum(r.position is not None for r in out) > 50 and sum(r.repeat_position is not None for r in out) > 5
    at = [2.0 if r.position is None else r.position for r in out]
    assert at == sorted(at) and at[0] < 1


def test_many_sources_are_joined(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(str, M.mix(docs).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, M.mix(docs).collect())) == want
