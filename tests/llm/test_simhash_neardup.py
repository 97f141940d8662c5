import random

import numpy as np
import xxhash

from factloom.llm import simhash_neardup as S

DOCS = "doc_id long, text string, extra string, fp long, component_id long"


def brute_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows, radius):
    ids = [r[0] for r in rows]
    fps = [brute_fp(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], f"{fps[i]:016x}", least[find(i)]) for i in range(len(rows)))


def make(n=150, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i * 3 + 5, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    return [*rows, (1, ""), (2, None), (3, " \n"), (4, "one two"), (900, "ONE two"), (901, "x " * 30000)]


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], DOCS)
    got = sorted(map(tuple, S.near_duplicates(df).collect()))
    assert got == brute_components(rows, 4)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e", "", 1, 1)] * 3 + [(None, "a b c d e", "", 1, 1), (None, "other words here now", "", 1, 1)], DOCS)
    got = S.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7")] * 3 + [("None", "7"), ("None", "None")]
    assert S.near_duplicates(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in S.keep_one(df).collect()) == ["7", "None"]


def test_keep_one_row_of_each_component(spark):
    """Null and repeated doc_ids: each component keeps one row, unlike texts of one doc_id both stay."""
    a, b, c, d = ("".join(f"{x}{i} " for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (7, b), (7, c), (8, b), (None, c), (None, d), (9, d + " "), (3, None), (4, ""), (None, " ")]
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], DOCS)
    got = sorted((str(r.doc_id), (r.text or "").strip()) for r in S.keep_one(df).collect())
    assert got == sorted([("None", a.strip()), ("7", b.strip()), ("7", c.strip()), ("9", d.strip()), ("3", "")])
    assert S.keep_one(df).columns == df.columns


def test_long_runs_are_split_and_lose_no_link(spark):
    rng = np.random.default_rng(3)
    center = np.uint64(0x0123456789ABCDEF)
    fps = {int(center)}
    while len(fps) < 400:
        x = int(center)
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    a = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    from factloom.plans.components import connected_components

    parts = []
    for run in (20, 2048):
        comp = {r.node: r.component for r in connected_components(S.fingerprint_links(df, run=run)).collect()}
        parts.append([comp.get(int(x), int(x)) for x in a.view(np.int64)])
    dist = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.array([label[dist[i]].min() for i in range(len(a))])
        if (new == label).all():
            break
        label = new
    for p in parts:
        assert len(set(zip(label.tolist(), p))) == len(set(label.tolist())) == len(set(p))
