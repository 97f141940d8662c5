import math
import random
import zlib
from itertools import product

import numpy as np

from factloom.llm import quality_crf as Q

DOCS = "doc_id long, text string, score string, quality int"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        u, t = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = math.exp(sum(u[i] * y[i] for i in range(n)) + sum(t[a][b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(Q.marginals(u, t), good / total)


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    seqs = [(rng.normal(size=(4, 3, 5)), np.array([0, 1, 1, 0])), (rng.normal(size=(2, 1, 5)), np.array([1, 0]))]
    w, b, t = rng.normal(size=5), 0.3, rng.normal(size=(2, 2))
    _, gw, gb, gt = Q._gradient(seqs, w, b, t, 0.0)
    f = lambda w, b, t: Q._gradient(seqs, w, b, t, 0.0)[0]
    e = 1e-6
    assert np.allclose(gw, [(f(w + e * np.eye(5)[i], b, t) - f(w - e * np.eye(5)[i], b, t)) / (2 * e) for i in range(5)], atol=1e-4)
    assert abs(gb - (f(w, b + e, t) - f(w, b - e, t)) / (2 * e)) < 1e-4
    for i, j in product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = e
        assert abs(gt[i, j] - (f(w, b, t + d) - f(w, b, t - d)) / (2 * e)) < 1e-4


def make(n=400, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        lines = []
        for _ in range(rng.randint(1, 6)):
            w = [rng.choice(words) for _ in range(12)]
            if bad:
                w = rng.choice([[w[0]] * 12, [x.upper() + "!!" for x in w], [x + "###" for x in w]])
            lines.append(" ".join(w).capitalize() + ("." if not bad else ""))
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    docs, labels = make()
    docs += [(1000, None), (1001, ""), (1001, ""), (None, "Fine words stand here."), (1002, "x" * 100_000), (1003, "a\n" * 5000)]
    labels += [(2000, 1, 0), (None, 0, 0), (3, None, 0)]
    d = spark.createDataFrame([(*r, "", 1) for r in docs], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Q.quality(d, lab).collect()
    assert len(out) == len(docs)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and len(held) > 50
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.97 * len([r for r in held if r.doc_id in truth])
    kept = Q.keep_good(d, lab)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in out if r.predicted)
    flipped = lab.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(str, Q.quality(d, flipped).collect())) == sorted(map(str, out))  # held-out labels are never read


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b", "", 1)], DOCS)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.quality(d, lab).first().score == 0.5 and Q.quality(d.limit(0), lab).count() == 0


def test_a_stretch_keeps_its_neighbours():
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=(30, len(Q.NAMES))), np.arange(30)
    whole = Q.with_neighbours(x)
    for at in range(40):
        got, own = Q.with_context(*Q.stretch(x, n, 7, at))
        assert np.array_equal(got, whole[own[0] : own[0] + 7]) and np.array_equal(own, np.arange(own[0], own[0] + 7))
    got, own = Q.with_context(*Q.stretch(x, n, 64, 5))
    assert np.array_equal(got, whole) and len(own) == 30


def test_repeated_ids_count_once(spark):
    docs, labels = make(60)
    d = spark.createDataFrame([(*r, "", 1) for r in docs + docs[:30] * 4], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len(Q.training_sample(d, lab, 20)) == 20
    assert len(Q.training_sample(d, lab)) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i, *_ in labels)
