import hashlib
import random
import zlib

from factloom.llm import period_runs as R
from factloom.llm import queries

DOCS = "doc_id long, text string, n_runs long, period string"


def brute(w):
    """All runs by trying each period over the whole text."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                out.setdefault((s, i + q - s), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n, o = h // 10, len(w), list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [o[a + (i - a) % p] if i >= a else o[i] for i in range(n)]
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = (*top, top[1] * 1000 // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *own, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def make(rng, n):
    """Words of a small or a large alphabet with periodic stretches put in, some of them broken, nested or side by side."""
    w = [f"w{rng.randrange(rng.choice([2, 3, 500]))}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 24, 31, 32, 33, 50])
        at, length = rng.randrange(n + 1), rng.randrange(2 * q, 6 * q + 24)
        unit = [f"u{rng.randrange(3)}" for _ in range(q)] if rng.random() < 0.5 else [f"v{i}" for i in range(q)]
        w[at : at + length] = [unit[i % q] for i in range(length)]
    return w


def test_runs_against_brute_force():
    rng = random.Random(4)
    some = 0
    for _ in range(400):
        w = make(rng, rng.choice([0, 5, 23, 24, 60, 200, 500]))
        found = R.runs(R.numbers(w))
        assert found == brute(w), w
        some += len(found)
    assert some > 200  # many of them have runs


def test_short_alphabets_against_brute_force():
    """Words over two letters, where runs overlap and have many periods; and Fibonacci words."""
    rng = random.Random(9)
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    for w in [list(b[:300]), *[[rng.choice("ab") for _ in range(150)] for _ in range(60)], ["x"] * 100, list("abab" * 20 + "b" + "abab" * 20)]:
        assert R.runs(R.numbers(w)) == brute(w)


def test_edges():
    """A run has 24 words at least, three periods at least, and ends with the text if it goes on to there."""
    assert R.runs(R.numbers(["x"] * 23)) == [] and R.runs(R.numbers(["x"] * 24)) == [(0, 24, 1)]
    unit = [f"u{i}" for i in range(9)]
    assert R.runs(R.numbers((unit * 3)[:26])) == [] and R.runs(R.numbers(unit * 3)) == [(0, 27, 9)]
    assert R.runs(R.numbers(["a", *unit * 4, "u0", "b"])) == [(1, 37, 9)]
    assert R.best([(0, 24, 8), (5, 30, 10), (9, 90, 30)]) == (0, 24, 8) and R.best([]) is None


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(make(rng, rng.choice([0, 1, 30, 120, 300])))) for i in range(150)]
    rows += [(None, "x " * 50), (None, None), (7, None), (8, ""), (8, "y " * 40), (8, "y " * 40), (9, "a b " * 30)]
    spark.createDataFrame([(*r, 5, "clash") for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_period_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 30 and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] > 0 for r in got) > 5


def test_very_long_text(spark):
    """A text of a few hundred thousand words, one run of them of a long period and one of a single word."""
    unit = [f"u{i}" for i in range(30000)]
    w = [f"w{i}" for i in range(1000)] + unit * 4 + ["z"] * 50000
    df = spark.createDataFrame([(1, " ".join(w), 0, "")], DOCS)
    got = [tuple(r) for r in R.find_runs(df).collect()]
    assert got == [(1, 1000, 120000, 30000), (1, 121000, 50000, 1)]
    assert R.collapse(df).first().text == " ".join(w[:31000] + ["z"])


def test_collapse_and_empty(spark):
    rows = [(1, "keep  this\n"), (2, None), (3, "a " + "b c " * 12), (4, "")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in R.collapse(df).collect()) == [(1, "keep  this\n"), (2, None), (3, "a b c"), (4, "")]
    assert R.planted_runs(df.limit(0)).count() == 0 and R.find_runs(df.limit(0)).count() == 0
