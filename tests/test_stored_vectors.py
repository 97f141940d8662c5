"""Stored vectors against a plain scan: clusters, odd vectors, removal, replacement, merge, loading."""

import numpy as np

from factloom.operators.stored_vectors import StoredVectors

_SCHEMA = "fact_id long, embedding array<float>, label string"


def plain(rows, q, k):
    """rows {id: vector} -> the k best, by a loop."""
    same = [(i, float(np.dot(np.float32(v).astype(float), q))) for i, v in rows.items() if len(v) == len(q)]
    return sorted(same, key=lambda r: (-r[1], r[0]))[:k]


def found(store, q, k):
    return [(r["fact_id"], r["score"]) for r in store.search(q, k).collect()]


def agree(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    np.testing.assert_allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def test_search_prunes_and_stays_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 12)) * 6
    rows = {i: (middle[i % 30] + rng.normal(size=12) * 0.3).tolist() for i in range(1500)}
    store = StoredVectors(spark, str(tmp_path / "v"))
    store.put(spark.createDataFrame([(i, v, "x") for i, v in rows.items()], _SCHEMA))
    for q in (middle[3], -middle[7], rng.normal(size=12), np.zeros(12)):
        agree(found(store, q.tolist(), 9), plain(rows, q, 9))
    store.search(middle[3].tolist(), 9)
    assert store.read["of_vectors"] == 1500 and store.read["vectors"] < 750


def test_changes_loading_and_ties(spark, tmp_path):
    rng = np.random.default_rng(6)
    at, rows = str(tmp_path / "v"), {i: rng.normal(size=5).tolist() for i in range(200)}
    df = lambda d: spark.createDataFrame([(i, v, None) for i, v in d.items()], _SCHEMA)
    StoredVectors(spark, at).put(df(rows))
    ids = lambda n: spark.createDataFrame([(i,) for i in n], "fact_id long")
    q = rng.normal(size=5)
    top = [i for i, _ in plain(rows, q, 6)]
    StoredVectors(spark, at).remove(ids([*top[:3], None, 10**6]))
    rows = {i: v for i, v in rows.items() if i not in top[:3]}
    agree(found(StoredVectors(spark, at), q, 8), plain(rows, q, 8))
    # One comes back, one is replaced, equal vectors tie, a vector of another length is met by its own queries only.
    new = {top[0]: (q * 3).tolist(), top[4]: (-q).tolist(), 901: q.tolist(), 900: q.tolist(), 902: [1.0, 2.0]}
    rows |= new
    StoredVectors(spark, at).put(df(new))
    store = StoredVectors(spark, at)
    agree(found(store, q, 8), plain(rows, q, 8))
    agree(found(store, [1.0, 1.0], 8), [(902, 3.0)])
    store.merge()
    assert len(store.files.segments()) == 1
    agree(found(StoredVectors(spark, at), q, 300), plain(rows, q, 300))
    assert sorted(r["fact_id"] for r in store.rows().collect()) == sorted(rows)
    store.remove(ids(rows))
    assert found(store, q, 5) == [] and store.rows().count() == 0
    store.merge()
    assert found(store, q, 5) == []


def test_odd_vectors(spark, tmp_path):
    store = StoredVectors(spark, str(tmp_path / "v"))
    assert found(store, [1.0], 3) == []
    store.put(spark.createDataFrame([], _SCHEMA))
    assert found(store, [1.0], 3) == [] and store.rows().count() == 0
    odd = [(1, None, ""), (2, [float("nan")], ""), (3, [None], ""), (4, [float("inf")], ""), (None, [1.0], ""), (5, [2.0], ""), (5, [2.0], ""), (6, [], ""), (7, [0.0], "")]
    store.put(spark.createDataFrame(odd, _SCHEMA))
    assert found(store, [1.0], 5) == [(5, 2.0), (5, 2.0), (7, 0.0)] and found(store, [1.0], 0) == []
    # Lengths that no sampled vector has.
    many = [(100 + i, [1.0], "") for i in range(300)] + [(i, [float(i)] * 3, "") for i in range(10, 14)]
    store.put(spark.createDataFrame(many, _SCHEMA), clusters=1)
    assert found(store, [1.0, 0.0, 0.0], 2) == [(13, 13.0), (12, 12.0)]
