import math
import random

from factloom.llm import topk_search as T

VECS = "vec_id long, embedding array<float>, rank int, score string"


def brute(rows, every, k):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi in sorted({i for i, _ in good if i % every == 0}):
        q = next(v for i, v in good if i == qi)
        s = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi and len(v) == len(q)))[:k]
        out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def run(spark, rows, every=50, k=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], VECS)
    return sorted(map(tuple, T.top_k(df, every, k).collect()))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.125) for _ in range(16)]) for i in range(1500)]
    rows = [(i, [struct_float(x) for x in v]) for i, v in rows]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # ties
    assert run(spark, rows) == brute(rows, 50, 5)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.25, -1.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (100, [1.0]), (6, []), (150, []), (None, [1.0, 1.0]), (7, [1e30, 1e30])]
    got = run(spark, rows)
    want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in brute(rows, 50, 5)]
    assert got == want
    assert run(spark, []) == []


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_NUMBERS", 8)
    rng = random.Random(6)
    rows = [(i, [struct_float(rng.gauss(0, 1)) for _ in range(4)]) for i in range(300)]
    assert run(spark, rows, 10, 3) == brute(rows, 10, 3)


def test_repeated_query_ids_in_a_large_batch(spark):
    """Rows of the query's own id score highest, and more of them than one."""
    rng = random.Random(8)
    rows = [(i, [struct_float(rng.gauss(0, 0.25)) for _ in range(6)]) for i in range(1, 97)]
    rows += [(0, [2.0, -2.0, 2.0, 2.0, -2.0, 2.0])] * 4
    assert run(spark, rows) == brute(rows, 50, 5)
    state = T.NoRandomAccess(T.np.array([0]), T.np.array([[512.0] * 6]), 5)
    state.add(T.np.array([0] * 4 + list(range(1, 97))), T.np.array([[512.0] * 6] * 4 + [[float(i)] * 6 for i in range(1, 97)]))
    assert state.rows()[1].tolist() == [96, 95, 94, 93, 92]


def test_stop_rules_decide(spark, sf):
    """On the given vectors most queries stop before their lists are read whole, and few scores are resolved."""
    import numpy as np

    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.floor(256 * np.array([r.embedding for r in rows], float))
    state = T.NoRandomAccess(ids[ids % 50 == 0], x[ids % 50 == 0], 5)
    state.add(ids, x)
    q, v, s = state.rows()
    scores = x[ids % 50 == 0] @ x.T
    scores[ids[ids % 50 == 0][:, None] == ids[None, :]] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert v.tolist() == ids[want].ravel().tolist() and s.tolist() == np.take_along_axis(scores, want, 1).astype(int).ravel().tolist()
    print("settled by round", state.settled.tolist(), "resolved", state.resolved / state.met)
    assert state.resolved < 0.25 * state.met and state.settled[:-1].sum() > 0.3 * state.settled.sum()


def test_repeated_query_is_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 9.0]), (1, [1.0, 1.0]), (2, [3.0, -1.0])]
    want = [(0, 1, 1, 128 * 256 + 9 * 256 * 256), (0, 2, 2, 128 * 768 - 9 * 256 * 256)]
    assert run(spark, rows) == want and run(spark, rows[::-1]) == want
