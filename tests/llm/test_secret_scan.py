import hashlib
import random
import re
import string

from factloom.llm import secret_scan as S

DOCS = "doc_id long, text string, key long, token string"

BASE = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def make(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["the", "an", "on", "ing", "er", "tion", "en"]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows, planted = [], []
    for i in range(200):
        w = [rng.choice(words) for _ in range(60)]
        if i % 10 == 0:
            t = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
            w[rng.randrange(60)] = t
            planted.append((i, t))
        if i % 7 == 0:
            w[5] = rng.choice(["é token = ", "API_KEY:", "passwd'=\""]) + rng.choice(["abcdefghijkl", "short", "A" * 30])
        if i % 11 == 0:
            w[7] = "AKIA" + "Q7" * rng.randint(5, 9) + "é" + "0123456789abcdef" * rng.randint(0, 2)
        rows.append((i, " ".join(w)))
    edge = ["token=token: abcdefghijklmnop", "secret=" * 400 + "x", None, "", "a" * 50000, "Token: 'x' password = " + "f" * 20, "ſecret=abcdefghijklmnop", "AKIA" * 9]
    return rows + [(1000 + i, t) for i, t in enumerate(edge)] + [(1001, "secret=" * 400 + "x"), (None, "hex deadbeefdeadbeefdeadbeef")], planted


def test_base_and_added_spans(spark):
    rows, planted = make()
    out = S.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in out) == want
    texts = {i: t or "" for i, t in rows}
    by = {r.doc_id: r for r in out}
    for r in out:
        got = [x for x in r.spans.split(",") if x]
        assert [x for x in got if not x.startswith("random")] == base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.n_random] == [sum(x.startswith(k) for x in got) for k in S.KINDS]
    hit = sum(any(texts[i][int(s) : int(e)] == t for k, s, e in (x.split(":") for x in by[i].spans.split(",") if x) if k == "random") for i, t in planted)
    false = sum(r.n_random for r in out) - hit
    assert hit >= 0.9 * len(planted) and false <= 1


def test_empty(spark):
    assert S.scan(spark.createDataFrame([], DOCS)).count() == 0
    assert S.scan(spark.createDataFrame([(1, "plain words", 1, "")], DOCS)).first().spans == ""


def test_secrets_behind_names(spark):
    """NAME=value, query parameters and padded values; a token ends at a '=' that is no padding."""
    import base64

    rng = random.Random(4)
    rows, planted = [(1000 + i, t) for i, t in make()[0] if i is not None], []
    for i in range(40):
        value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
        value = base64.b64encode(rng.randbytes(31)).decode() if i % 4 == 1 else value
        name = ("AWS_CREDENTIAL_ACCESS_KEY_VALUE=", "https://host/x?sig=", "auth=", "--key==")[i % 4]
        planted.append((i, value, len(name) + 4))
        rows.append((i, f"the {name}{value} and"))
    by = {r.doc_id: r.spans.split(",") for r in S.scan(spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)).collect()}
    hit = sum(f"random:{at}:{at + len(v)}" in by[i] for i, v, at in planted)
    assert hit >= 0.9 * len(planted), hit
    tokens = lambda t: [m[0] for m in re.finditer(S.RANDOM, t)]
    assert tokens("a=" + "b" * 20 + "== c=" + "d" * 19 + " " + "e" * 18 + "== " + "f" * 18 + "= " + "g" * 25 + "=" + "h" * 20) == ["b" * 20 + "==", "e" * 18 + "==", "g" * 25, "h" * 20]


def test_battery_against_an_independent_computation(spark):
    """Each token's encoding, its three p-values and Fisher's sum, from their definitions."""
    import math
    from statistics import NormalDist

    rng = random.Random(11)
    sets = [string.digits, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", string.ascii_lowercase, string.ascii_letters, string.ascii_uppercase + string.ascii_lowercase + string.digits]
    tokens = [("".join(rng.choice(a) for _ in range(rng.randint(20, 90))), a) for a in sets for _ in range(6)] + [("abcdefghijklmnopqrstuvwxyz" * 2, string.ascii_lowercase), ("0" * 30, string.digits)]
    up = lambda z: 1 - NormalDist().cdf(z)
    got = {r.token: r for r in S.battery(spark.createDataFrame([(t,) for t, _ in tokens], "token string")).collect()}
    for t, a in tokens:
        a = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" if a == string.ascii_letters else a
        a = next(x for _, x in S.ENCODINGS if set(t) <= set(x))
        x, n, k = [a.index(c) for c in t], len(t), len(a)
        chi = sum((t.count(c) - n / k) ** 2 / (n / k) for c in a)
        uniform = up(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
        high = [v >= k / 2 for v in x]
        n1, n2, runs = sum(high), n - sum(high), 1 + sum(p != q for p, q in zip(high, high[1:]))
        mu = 1 + 2 * n1 * n2 / n
        sd2 = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = min(1, 2 * up(abs(runs - mu) / math.sqrt(sd2))) if n1 and n2 and sd2 > 0 else 0.0
        mean = sum(x) / n
        var = sum((v - mean) ** 2 for v in x)
        serial = min(1, 2 * up(abs((sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var + 1 / n) * math.sqrt(n)))) if var else 0.0
        r = got[t]
        for mine, want in ((r.p_uniform, uniform), (r.p_runs, p_runs), (r.p_serial, serial)):
            assert abs(mine - want) < 2e-6, (t, mine, want)
        h = -sum(math.log(max(p, 1e-300)) for p in (r.p_uniform, r.p_runs, r.p_serial))
        assert math.isclose(r.p_random, math.exp(-h) * (1 + h + h * h / 2), rel_tol=1e-9)


def test_step_up():
    ps = [0.0001, 0.0005, 0.004, 0.02, 0.3, 0.5, 0.9]
    bins = [(int(-10 * __import__("math").log10(p)), 1) for p in ps]
    # Each bin counts as its largest p-value: 1e-4, 10^-3.3, 10^-2.3, 10^-1.6 ...
    assert S.step_up(bins, 0.02) == 23 and S.step_up(bins, 0.01) == 33 and S.step_up([(1, 5)], 0.01) is None


def test_even_patterns_are_rejected_by_the_battery(spark):
    """Long tokens that look unlike words but are not random: the step-up on the battery's p-values throws them out."""
    rng = random.Random(5)
    even = ["".join(rng.choice("QZ79") for _ in range(48)) for _ in range(30)]
    true = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(48)) for _ in range(30)]
    words = ["".join(rng.choice(["the", "an", "on", "ing", "er", "tion", "en"]) for _ in range(16)) for _ in range(300)]
    found = {r.token for r in S.discoveries(spark.createDataFrame([(t,) for t in even + true + words], "token string")).collect()}
    assert len(found & set(true)) >= 28 and not found & set(even) and len(found & set(words)) <= 1


def test_corpora_without_long_words(spark):
    """Random tokens are found in prose of short words, and in texts that hold nothing else; prose alone has none."""
    rng = random.Random(21)
    words = "the of and mill river stone lamp oak was seen by men at dawn over field with cart and mule".split()
    some = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda: "".join(rng.choices(some, k=40))
    prose = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    found = lambda texts: [r.n_random for r in sorted(S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]
    mixed = found([f"{p} {token()} {p}" if i < 40 else p for i, p in enumerate(prose)])
    assert mixed == [1] * 40 + [0] * 260
    assert found([token() for _ in range(40)]) == [1] * 40
    assert found(["Incomprehensibilities of antidisestablishmentarianism", *prose[:20]]) == [0] * 21


def test_many_spans_in_one_text(spark):
    """Thousands of named and random spans of one text are swept, not compared with each other."""
    rng = random.Random(2)
    hexes = ["".join(rng.choices("0123456789abcdef", k=16)) for _ in range(4000)]
    some = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choices(some, k=40)) for _ in range(4000)]
    (row,) = S.scan(spark.createDataFrame([(1, " ".join(f"{h} {t} token={h}AAAA" for h, t in zip(hexes, tokens)))], "doc_id long, text string")).collect()
    assert row.n_assign == 4000 and row.n_hex == 8000 and row.n_random > 3900


def test_sweep_against_all_pairs(spark):
    rng = random.Random(5)
    spans = [(d, 0, k, s, s + rng.randint(1, 9)) for d in range(6) for k in range(4) for s in rng.sample(range(60), 9)]
    df = spark.createDataFrame(spans, "doc_id long, key long, kind int, start long, end long")
    want = [x for x in spans if x[2] < 3 or not any(y[0] == x[0] and y[2] < 3 and y[3] < x[4] and x[3] < y[4] for y in spans)]
    got = [tuple(r) for r in S._without_overlaps(df).select("doc_id", "key", "kind", "start", "end").collect()]
    assert sorted(got) == sorted(want) and len(got) < len(spans)
