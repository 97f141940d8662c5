import random

from factloom.llm import line_dedup as L

DOCS = "doc_id long, text string"


def shingle_set(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def jaccard(a, b):
    s, t = shingle_set(a), shingle_set(b)
    return len(s & t) / len(s | t)


def lines():
    """Pairs of a line and one with a character, or a column, in front: no spaces, or tabs only."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for n in (11, 12, 13, 63, 64, 65, 75, 76, 128, 140, 300):
        cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
        url = "https://" + "".join(rng.choice(letters + "/") for _ in range(n))
        row = "\t".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n // 3))
        out += [(cjk, cjk[:2] + "一" + cjk[2:]), (url, "x" + url), (row, "0\t" + row), (url[::-1], url[::-1] + "zz"), ("\U0001f600" + cjk, cjk)]
    return out


def test_full_sets(spark):
    every = [x for pair in lines() for x in pair] + ["a", "twelve chars", "x" * 500]
    df = spark.createDataFrame(list(enumerate(every)), DOCS)
    got = {r.doc_id: len(set(r.s)) for r in df.select("doc_id", L.shingles(L.F.col("text")).alias("s")).collect()}
    assert got == {i: len(shingle_set(x)) for i, x in enumerate(every)}


def test_unspaced_lines_against_brute_force(spark):
    pairs = lines()
    df = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], DOCS)
    dropped = {r.doc_id for r in L.line_dedup(df).collect() if r.dropped}
    every = [x for p in pairs for x in p]
    label = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if label[i] != label[j] and jaccard(every[i], every[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    want = {i for i, c in enumerate(label) if c in label[:i]}
    assert 50 < len(want) and len(dropped ^ want) <= 1


def test_bands_are_the_lines_of_a_plane():
    """Any two minima share one band, and the recall at 0.8, over all ways in which minima may agree, is what is said."""
    from itertools import combinations

    assert len(set(L.BANDS)) == 12 and all(sum({a, b} <= set(x) for x in L.BANDS) == 1 for a, b in combinations(range(L.MINIMA), 2))
    recall = 0.0
    for n in range(L.MINIMA + 1):
        for same in combinations(range(L.MINIMA), n):
            recall += any(set(x) <= set(same) for x in L.BANDS) * 0.8**n * 0.2 ** (L.MINIMA - n)
    assert 0.990 < recall < 0.991
