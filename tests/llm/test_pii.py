import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import pii

DOCS = "doc_id long, text string, spans string, kind int"
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and plain_luhn(re.sub("[ -]", "", s)),
        "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in RAW.items()}


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ (0123456789)é", max_size=60))
def test_base_against_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def make(seed=1):
    rng = random.Random(seed)
    bits = ["mail me at a.b@x.example.com now", "ip 10.2.3.4 and 999.1.1.1", "card 4111 1111 1111 1111 ok", "4876179267539117", "call +1 (319) 555-5132 or 319-555-5132", "version 1.2.3.4", "SSN 123-45-6789", "Dear Mr. John Smith", "order 4111111111111112", "write to joe at mail dot com é"]
    rows = [(i, " filler ".join(rng.sample(bits, 3))) for i in range(300)]
    return rows + [(900, None), (901, ""), (901, ""), (902, "1" * 100_000 + "@" * 1000), (None, bits[0])]


def test_documents(spark):
    rows = make()
    out = pii.find(spark.createDataFrame([(*r, "", 1) for r in rows], DOCS)).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        want[str(i)] = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in (brute(t or "") if i != 902 else pii.base_spans(t))[k])
    for r in out:
        assert r.base_sha256 == hashlib.sha256(want[str(r.doc_id)].encode()).hexdigest()
        assert set(x for x in want[str(r.doc_id)].split(",") if x) <= set(r.spans.split(","))
    assert any("person:" in r.spans for r in out) and any("ssn:" in r.spans for r in out)
    assert pii.find(spark.createDataFrame([], DOCS)).count() == 0


def test_reliabilities_of_planted_labelers():
    rng = random.Random(2)
    right = (0.95, 0.9, 0.8, 0.7, 0.75, 0.6)
    counts, truth = {}, {}
    for _ in range(20000):
        k, y = rng.randrange(6), rng.random() < 0.4
        v = tuple(-1 if rng.random() < 0.3 else int(y) if rng.random() < r else int(not y) for r in right)
        c = pii.pattern(k, v)
        counts[c] = counts.get(c, 0) + 1
        truth.setdefault(c, []).append(y)
    post, told = pii.reliabilities(counts)
    good = sum(sum((p >= 0.5) == y for y in truth[c]) for c, p in post.items()) / 20000
    assert good > 0.93
    for name, r in zip(pii.LABELERS, right):
        assert abs(told["right"][name][0] / 0.7 - r) < 0.06
    # Marks that tell the truth better than the votes do: the classifier goes beyond its labelers.
    marked, seen = {}, {}
    for c, ys in truth.items():
        for y in ys:
            m = c * pii._MARKS + (1 if (rng.random() < 0.97) == y else 2)
            marked[m] = marked.get(m, 0) + 1
            seen.setdefault(m, []).append(y)
    probs = pii.classifier(marked, post)
    by_marks = sum(sum((probs[c] >= 0.5) == y for y in seen[c]) for c in marked) / 20000
    assert by_marks > good


def test_added_spans_against_one_loop(spark):
    """The whole result from all candidates at once, without Spark."""
    rows = make(3)
    found = [pii.candidates(t or "") for _, t in rows]
    counts, voted = {}, {}
    for c in (c for f in found for *_, c in f):
        counts[c] = counts.get(c, 0) + 1
        voted[c >> len(pii.MARKS)] = voted.get(c >> len(pii.MARKS), 0) + 1
    sure = pii.classifier(counts, pii.reliabilities(voted)[0])
    want = []
    for (i, _), f in zip(rows, found):
        keep = [(k, a, b) for k, a, b, base, _ in f if base]
        for k, a, b, base, c in f:
            if not base and sure[c] >= 0.5 and all(b <= x or y <= a for _, x, y in keep):
                keep.append((k, a, b))
        want.append((str(i), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(keep))))
    out = pii.find(spark.createDataFrame([(*r, "", 1) for r in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), r.spans) for r in out) == sorted(want)
    assert sum(len(w.split(",")) for _, w in want if w) > sum(base for f in found for _, _, _, base, _ in f)


def test_marks():
    bits = lambda t, a, b: {n for i, n in enumerate(pii.MARKS) if pii.marks(t, a, b) >> i & 1}
    assert bits("<1.2.3.4>", 1, 8) == {"opened"} and bits("Dr. A B", 0, 7) == {"separators", "line_start", "capital"}
    assert bits("x\n 12 345678 1.2", 3, 5) == {"line_start", "among_digits"} and bits("v1.2.3.4", 1, 8) == {"joined"}
