import random

from factloom.llm import line_dedup as L

DOCS = "doc_id long, text string, line string, key long, dropped int"


def shingle_set(line):
    """Every run of twelve characters; a shorter line is one."""
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def brute(rows):
    places = [(i, k, x) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if x.strip()]
    lines = sorted({p[2] for p in places})
    sets = [shingle_set(x) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    first, at = {}, {x: find(i) for i, x in enumerate(lines)}
    for i, k, x in sorted(places):
        first.setdefault(at[x], (i, k))
    out = {}
    for i, k, x in places:
        if first[at[x]] != (i, k):
            out.setdefault(i, set()).add(k)
    return out


def make(seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    rows = []
    for i in range(80):
        out = []
        for _ in range(rng.randint(1, 6)):
            w = list(rng.choice(base)) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(30)]
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        rows.append((i, "\n".join(out)))
    return rows + [(100, None), (101, ""), (102, " \n\n" + rows[0][1]), (103, "x" * 5000), (104, "x" * 5001), (None, rows[0][1])]


def test_against_brute_force(spark):
    rows = make()
    out = L.line_dedup(spark.createDataFrame([(*r, "", 1, 1) for r in rows], DOCS)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    miss = 0
    for r in out:
        got = {int(x) for x in r.dropped.split(",") if x}
        expect = want.get(r.doc_id, set())
        miss += len(got ^ expect)
        assert r.n_kept == r.n_lines - len(got)
    assert miss <= 2  # pairs near the threshold may miss all bands


def test_apply(spark):
    rows = [(1, "one line here\nother line there"), (2, "one line here"), (3, "fresh words only\n\none line here"), (3, None), (4, None)]
    df = spark.createDataFrame([(*r, "keep", 1, 1) for r in rows], DOCS)
    got = L.without_repeated_lines(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, str(r.text)) for r in got.collect()) == [(1, rows[0][1]), (3, "fresh words only\n"), (4, "None")]
    assert L.line_dedup(df.limit(0)).count() == 0


def test_failed_lines_meet_each_other(spark):
    """In a bucket whose least line is unlike two others, these still find each other."""
    a = " ".join(f"w{i}" for i in range(40))
    variants = [" ".join(f"w{i}" if i % 40 != k else "zz" for i in range(40)) for k in range(0, 40, 2)]
    rows = [(i, v) for i, v in enumerate([a, *variants])]
    out = L.line_dedup(spark.createDataFrame([(*r, "", 1, 1) for r in rows], DOCS)).collect()
    assert sum(r.n_kept for r in out) == 1


def test_large_near_group_near_the_threshold(spark):
    """Many lines whose similarities lie on both sides of the threshold: large buckets, sketches and joined components."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(1, 5)):
            w[k] = f"zz{i}q{k}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, "\t \r\n" + rows[0][1]) for i in range(40)]
    out = {r.doc_id: r for r in L.line_dedup(spark.createDataFrame([(*r, "", 1, 1) for r in rows], DOCS)).collect()}
    want = brute(rows)
    wrong = [i for i in out if {int(x) for x in out[i].dropped.split(",") if x} != want.get(i, set())]
    assert len(wrong) <= 2, wrong
