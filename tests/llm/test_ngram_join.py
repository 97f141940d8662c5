import random

import pytest

from factloom.llm import ngram_join as J
from factloom.llm import queries

DOCS = "doc_id long, text string, key string, n int, h int"


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    ids = {}
    for (i, _), c in zip(rows, label):
        ids.setdefault(c, []).append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    return sorted(((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, label)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(rng, n, most=300):
    """Texts with copies in which a run of words is replaced, on both sides of the threshold; chains of such copies."""
    out = []
    for _ in range(n):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 5, 6, 9, 30, most]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            out.append(" ".join(w))
            k = max(1, int(len(w) * rng.uniform(0.0, 0.16)))
            at = rng.randrange(len(w) - k + 1)
            w = w[:at] + [f"x{rng.randrange(4000)}" for _ in range(k)] + w[at + k :]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = near_copies(rng, 90)
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts[:20])]
    rows += [(None, texts[0]), (None, None), (None, None), (-5, texts[5].upper()), (7, "different text under a known id"), (50, ""), (51, " \n\t"), (52, None), (53, "one"), (54, "ONE"), (55, "É"), (56, "é")]
    rng.shuffle(rows)
    want = brute(rows)
    assert result(J.join_components(frame(spark, rows))) == want
    classes = [c for _, n, c in want if n]
    assert 20 < len(classes) - len(set(classes)) < len(classes) - 30


@pytest.mark.parametrize("small, part", [(6, 512), (2, 5)])
def test_large_groups(spark, monkeypatch, small, part):
    """Near copies around a text and around a far relative of it, texts that share a long passage, and copies of one text."""
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "PART", part)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    other = base[:150] + [f"o{i}" for i in range(50)]
    edit = lambda w, k, name: " ".join([f"{name}{p}" if k <= p < k + 6 else x for p, x in enumerate(w)])
    texts = [edit(b, rng.randrange(190), f"e{i}") for b in (base, other) for i in range(30)]
    passage = " ".join(f"p{i}" for i in range(120))
    texts += [f"{passage} " + " ".join(f"t{j} {i}" for j in range(rng.choice([2, 6, 8, 30]))) for i in range(40)]
    texts += ["the very same text again"] * 25
    rows = list(enumerate(texts))
    assert result(J.join_components(frame(spark, rows))) == brute(rows)


def test_passages_without_links(spark):
    """Texts of mostly one passage that are alike to none: the bucket's pairs are all looked at and none links."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"t{i}.{j}" for j in range(20))) for i in range(40)]
    want = brute(rows)
    assert result(J.join_components(frame(spark, rows))) == want and len({c for _, _, c in want}) == 40


def test_filters_lose_no_pair():
    """Pairs just above the threshold share a member of their prefixes under each order, and sketches never overstate."""
    rng = random.Random(7)
    for k in range(300):
        n = rng.randint(1, 300)
        d = n - -(-80 * n // 100) if rng.random() < 0.7 else n // 9
        a = [f"{k}.{i}" for i in range(n)]
        b = a[d:] + [f"{k}.o{i}" for i in range(min(d, n // 9 - (n - d) // n))]
        s, t = ({J.xxhash.xxh64_intdigest(x) for x in v} for v in (a, b))
        if 100 * len(s & t) < 80 * len(s | t):
            continue
        s, t = (J.np.array(sorted(v), J.np.uint64) for v in (s, t))
        for odd in J._ODD:
            cut = [set(J.np.sort(v * J.np.uint64(odd))[: J.prefix_length(len(v))].tolist()) for v in (s, t)]
            assert cut[0] & cut[1]
        apart = sum(int(J.np.bitwise_count(x)) for x in (J.sketch(s) ^ J.sketch(t)).view(J.np.uint64))
        assert apart <= len(set(s.tolist()) ^ set(t.tolist()))


def test_long_text_and_empty(spark):
    w = [f"w{i % 70001}" for i in range(200_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:190_000])), (3, "short text")]
    assert result(J.join_components(frame(spark, rows))) == brute(rows)
    assert J.join_components(frame(spark, rows).limit(0)).count() == 0


def test_copies_are_cut_once(spark):
    """equal texts are one text before their shingles are made, and no shingle is shared by copies of one text only."""
    texts = ["a b c d e f g", "A b c d e f g", "h i j k l m n o p", "one", ""]
    df = frame(spark, [(i, t) for i in range(9) for t in texts])
    rows = J.first_members(df, 5, 80)
    assert rows.count() == len(texts)
    held = J.prefixes(rows.filter("n > 0"), 80).collect()
    assert {r.n for r in held} == {3} and len({r.key for r in held}) == 2


def test_bitmap_grows_with_the_shared_shingles(spark):
    """a bitmap of one size is full at last, and then all first members are sent."""
    assert J._bitmap_parts(spark.range(5)) == J.BITMAP_PARTS
    assert J._bitmap_parts(spark.range(20_000_000)) * J._BITS >= 8 * 20_000_000
    assert J._bitmap_parts(spark.range(200_000_000)) == J.BITMAP_MOST


def test_shingles_of_a_batch():
    """the sets of many texts at once; words of all lengths, on both sides of the eight bytes that are hashed together, and with zero bytes."""
    rng = random.Random(11)
    words = ["a", "A", "b", "a\0", "a\0\0", "É", "漢字", "x" * 8, "x" * 9, "x" * 16, "x" * 17, "y" * 255, "y" * 256, "y" * 257, "y" * 600]
    texts = ["", " \n\t", None, " a b", "a b c d", "a b c d e "] + [rng.choice(["", " "]) + rng.choice([" ", "\x0b \r"]).join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(200)]
    got = J.shingle_sets(J.pa.array(["not this one", *[t or "" for t in texts]])[1:])
    told = {}
    for t, s in zip(texts, got):
        assert len(s) == len(shingles(t)) and sorted(set(s.tolist())) == s.tolist() == J.shingle_set(t).tolist()
        for g in shingles(t):
            told[g] = told.get(g, set(s.tolist())) & set(s.tolist())
    assert all(told.values()) and len({h for s in got for h in s.tolist()}) == len(told)


def test_query_is_registered():
    assert "op12_multi_order_join" in queries.QUERIES and "op12_multi_order_join" in queries.ORACLE_SQL
