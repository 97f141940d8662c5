import hashlib
import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from factloom.llm import fingerprints as P

DOCS = "doc_id long, text string, grp int, fp0 string"


def make(n=120, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 120))) for _ in range(30)]
    rows = [(rng.randrange(10**6), rng.choice(base)) for _ in range(n)]
    for i in range(30):  # near copies
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "new"
        rows.append((10**7 + i, " ".join(w)))
    return rows + [(3, None), (4, ""), (5, " \n"), (6, "a b"), (7, "a b"), (8, "x y " * 40000), (None, "late one")]


def h(x, seed):
    raw = x.to_bytes(8, "little", signed=True) if isinstance(x, int) else x.encode()
    v = xxhash.xxh64_intdigest(raw, seed & (1 << 64) - 1)
    return v - (1 << 64) if v >> 63 else v


def brute_fp(text, width=5):
    words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0, 0
    hs = [h(w, 42) for w in words + [""] * max(0, width - len(words))]
    out = []
    for seed in P.SEEDS:
        votes, n = [0] * 64, 0
        for i in range(len(hs) - width + 1):
            v = spark_hash(seed, hs[i : i + width])
            n += 1
            for b in range(64):
                votes[b] += v >> b & 1
        out.append(sum(1 << b for b in range(64) if votes[b] * 2 > n))
    return tuple(out)


def spark_hash(seed, longs):
    v = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for x in longs:
        v = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), v)
    return v


def test_against_brute_force(spark):
    rows = make()
    got = P.fingerprints_with_links(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS), groups=8).collect()
    order = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda r: (-r[0], r[1])) + [(i, t or "") for i, t in rows if i is None]
    fps = {t: brute_fp(t) for _, t in order if len(t) < 10000}
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    assert len(got) == len(order)
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = by[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())]
        if t in fps:
            assert r.fingerprint == "%016x%016x" % fps[t]
            if len(edited) < 10000:
                assert r.edited_fingerprint == "%016x%016x" % brute_fp(edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    distinct = {int(r.fingerprint, 16) for r in got}
    for r in got:
        mine = int(r.fingerprint, 16)
        assert r.n_links == sum(0 < bin(mine ^ x).count("1") <= 6 for x in distinct)
        ids = [x.doc_id for x in got if x.fingerprint == r.fingerprint and x.doc_id is not None]
        assert r.class_id == (min(ids) if ids else None)


def test_null_and_hot_ids_are_split(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(None, text(12)) for _ in range(1500)] + [(None, "same words here")] * 9000 + [(None, None)] * 3
    rows += [(77, text(12)) for _ in range(1500)] + [(77, "same words here")] * 700 + [(i, text(9)) for i in range(400)] + [((1 << 63) - 1, "top"), (-(1 << 63), "low")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1], 42), r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    for groups in (1, 2, 64):
        got = P.document_fingerprints(df, groups=groups).collect()
        assert Counter((r.doc_id, r.edited_sha256) for r in got) == want, groups
        assert all(0 <= r.near_next <= 1 for r in got)
    sizes = P.with_next(df, 64).groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("tail").cast("int")).alias("tails")).collect()
    assert max(r.n for r in sizes) < 500 and all(r.tails == 1 for r in sizes)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "")], DOCS)
    assert P.fingerprints_with_links(df.limit(0)).count() == 0
    r = P.fingerprints_with_links(df).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c"[:5]).hexdigest()


def test_block_tables_are_not_broadcast(spark, tmp_path, capsys):
    """a table of exploded rows is many times as large as Spark sizes it; it is shuffled, however small it looks."""
    spark.createDataFrame([(i, i % 7) for i in range(60)], "fp0 long, fp1 long").write.parquet(f"{tmp_path}/fps")
    links = P.near_links(spark.read.parquet(f"{tmp_path}/fps"))
    assert links.count() > 0
    links.explain()
    assert "BroadcastHashJoin" not in (plan := capsys.readouterr().out) and "SortMergeJoin" in plan
