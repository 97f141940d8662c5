import random

import corpus_pipeline
from factloom.llm import jaccard_neardup as J

DOCS = "doc_id long, text string, _key string, key int"


def jaccard(a, b):
    s, t = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((x or "").lower().split() for x in (a, b)))
    return len(s & t) / len(s | t)


def components(rows):
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return label


def make(seed=2):
    """Texts of 100 to 400 words, each with a copy in which one run of words is replaced: similarities of about 0.7 to 1."""
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        n = max(1, int(len(w) * rng.uniform(0.0, 0.16)))
        at = rng.randrange(len(w) - n)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:at] + [f"x{rng.randrange(5000)}" for _ in range(n)] + w[at + n :]))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "keep", 1) for r in rows], DOCS)


def test_stage_against_brute_force(spark):
    rows = make()
    label = components(rows)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(i, least.get(c, i))
    assert 20 < len(rows) - len(least) < 70  # pairs on both sides of the threshold
    df = frame(spark, rows)
    out = corpus_pipeline.neardup_stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values())


def test_large_group(spark):
    """A group of near copies around one text, larger than a bucket that compares all its pairs, and copies of one text."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([f"v{i}" if k == p else x for k, x in enumerate(base)])) for i in range(60) for p in [rng.randrange(300)]]
    rows += [(100 + i, "one and the same text for all of them") for i in range(30)]
    assert sorted(r.doc_id for r in J.keep_one(frame(spark, rows)).collect()) == [0, 100]


def test_recall_of_bands():
    """Share of pairs at a similarity of 0.8 to 0.82 that share a band."""
    rng = random.Random(7)
    met = 0
    for k in range(400):
        a = [f"{k} {i}" for i in range(rng.randint(90, 400))]
        n = round(len(a) / 9)  # J = (len - n) / (len + n)
        n -= (len(a) - n) / (len(a) + n) < 0.8
        sets = [J.np.array([J.xxhash.xxh64_intdigest(x) for x in s], J.np.uint64) for s in (a, a[n:] + [f"{k} other {i}" for i in range(n)])]
        met += any(x == y for x, y in zip(*map(J.band_keys, sets)))
    assert met >= 398


def test_empty(spark):
    assert J.keep_one(frame(spark, []).limit(0)).count() == 0


def test_null_and_repeated_doc_ids(spark):
    """Each component keeps exactly one row, also without a doc_id or under one that another text has."""
    a, b, c = "a b c d e", "other words here now", "third text under a known id"
    rows = [(7, a), (7, a), (None, a), (None, b), (None, b), (7, c)]
    assert sorted((str(r.doc_id), r.text) for r in J.keep_one(frame(spark, rows)).collect()) == [("7", a), ("7", c), ("None", b)]
