"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base: e-mail, ip, card, phone) and from looser ones (written-out e-mail,
national phone, card-like and ip-like numbers, social-security numbers, titled names). Labelers vote on each candidate
for, against, or not at all: strict pattern, checksum and ranges, gazetteer, words of context for and against, and
shape. Expectation-maximisation over the counts of the vote patterns estimates each labeler's reliability and the share
of true spans in each kind, and its posteriors train a logistic span classifier. Beside the votes it sees marks of the
span and of what stands around it that no labeler looks at (`MARKS`), by kind, and so tells spans apart that got the same
votes. A base span always stays; another candidate is added if the classifier says so and no base span overlaps it.

The texts are read once. Patterns of votes and marks are of a bounded number, so what is gathered for training is a
bounded table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from .common import batch, map_arrow, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "person")
#: Characters of context before a span and after it.
BEFORE, AFTER = 48, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WRITTEN = re.compile(r"\b[A-Za-z0-9._-]{2,40} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{2,40} ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,12}\b")
_NATIONAL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra?)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?\b")

# Gazetteers and words of context.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io ai app dev cloud online site example me tv co eu at au be br ca ch cl cn cz de dk es fi fr gr hk hu ie il in "
    "it jp kr lt lu lv mx my nl no nz ph pl pt ro rs ru se sg si sk th tr tw ua uk us vn za".split()
)
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
FIRST_NAMES = frozenset(
    "Adam Ahmed Aisha Alan Alejandro Alexander Ali Alice Amy Ana Andrea Andreas Andrew Angela Anna Anne Antoine Antonio Barbara Ben Bob Brian Camille Carlos Carmen "
    "Carol Charles Charlotte Chen Chloe Christian Christine Claire Claudia Daniel David Diego Dorothy Elena Elizabeth Emily Emma Eric Eva Fatima Felix Fernando Francisco "
    "Frank Franz George Georg Giulia Grace Hannah Hans Heinrich Helen Henry Hugo Ibrahim Ines Isabel Ivan Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Joao John "
    "Jonas Jose Joseph Juan Julia Julien Jun Karen Karl Katharina Kevin Klaus Laura Lea Linda Lisa Louis Lucas Lucia Luis Lukas Manuel Marco Margaret Maria Marie Mario "
    "Mark Marta Martin Mary Matthew Max Mei Michael Miguel Mohammed Monika Nancy Nicolas Nina Olga Oliver Pablo Patricia Paul Paula Pedro Peter Petra Philippe Pierre Rachel "
    "Raj Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula Victor Wei William Yuki".split()
)
FOR = {
    "email": re.compile(r"e-?mail|contact|mailto|write to|reach", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login from", re.I),
    "card": re.compile(r"card|visa|mastercard|amex|credit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|whatsapp", re.I),
    "ssn": re.compile(r"ssn|social security|insurance", re.I),
    "person": re.compile(r"name|dear|patient|signed|born", re.I),
}
AGAINST = re.compile(r"version|build|order|invoice|isbn|serial|part no|model|page|chapter|figure|sku", re.I)
LABELERS = ("strict", "checks", "gazetteer", "for", "against", "shape")
#: What the classifier sees beside the votes, yes or no each.
MARKS = ("opened", "joined", "among_digits", "long", "separators", "line_start", "capital")
_MARKS = 1 << len(MARKS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping, found by their @: each has its own run of local characters."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "at" in text and ("dot" in text):
        out += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if m.end() - m.start() <= 19]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= sum(c not in " -" for c in m[0]) <= 19]
        out += [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out += [("person", *m.span()) for m in _PERSON.finditer(text)]
    return out


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """One of -2 (the labeler has no say on the kind), -1 (no vote), 0 (against), 1 (for) by each labeler."""
    s = text[start:end]
    before, around = text[max(0, start - BEFORE) : start], text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    digits = "".join(c for c in s if c in "0123456789")
    if kind == "email":
        check = 1 if re.search(r"[.][A-Za-z]{2,}$|dot.{0,2}[A-Za-z]{2,}$", s) else 0
        gaz = 1 if re.split(r"[. \])]", s)[-1].lower() in DOMAINS else -1
        shape = 1 if len(s) <= 80 else 0
    elif kind == "ip":
        check = int(_octets(s)) if s.count(".") == 3 else 0
        gaz = 0 if s.startswith(("0.", "127.")) else -1
        shape = 0 if re.match(r"[.][0-9]|[0-9]", text[end : end + 2]) or before.endswith(("v", ".")) else -1
    elif kind == "card":
        check, gaz = int(luhn(digits)), int(digits.startswith(ISSUERS))
        shape = 1 if len(digits) in (15, 16) else -1
    elif kind == "phone":
        check = int(9 <= len(digits) <= 15)
        gaz = 1 if strict else -1
        shape = 1 if any(c in s for c in " ().-") else -1
    elif kind == "ssn":
        check = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
        gaz, shape = -2, -2
    else:
        check, gaz = -2, 1 if set(s.split()) & FIRST_NAMES else -1
        shape = 1 if s.count(" ") > 1 else -1
    return (-2 if kind not in BASE else 1 if strict else -1, check, gaz, 1 if FOR[kind].search(around) else -1, 0 if AGAINST.search(before) else -1, shape)


def pattern(kind: int, v: tuple[int, ...]) -> int:
    code = kind
    for x in v:
        code = code * 4 + x + 2
    return code


def marks(text: str, start: int, end: int) -> int:
    """The span's `MARKS` as bits: behind an opening sign, part of a longer run of letters or digits, between other
    numbers, over 18 characters, of two kinds of separators or more, first in its line, with a capital letter."""
    s, before, behind = text[start:end], text[max(0, start - 12) : start], text[end : end + 12]
    found = (
        before.rstrip(" ")[-1:] in tuple(":=<([\"'"),
        before[-1:].isalnum() or behind[:1].isalnum(),
        sum(map(str.isdigit, before + behind)) >= 6,
        len(s) > 18,
        len({c for c in s if not c.isalnum()}) > 1,
        before.rpartition("\n")[2].strip() == "" and (start <= 12 or "\n" in before),
        any(map(str.isupper, s)),
    )
    return sum(bool(x) << i for i, x in enumerate(found))


def unpattern(code: int) -> tuple[int, tuple[int, ...]]:
    v = []
    for _ in LABELERS:
        code, x = divmod(code, 4)
        v.append(x - 2)
    return code, tuple(reversed(v))


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, pattern of votes and marks), sorted; a loose span that equals a base one of its kind is that one."""
    base = base_spans(text)
    own = {(BASE.index(k), a, b) for k, spans in base.items() for a, b in spans}
    rest = {(KINDS.index(k), a, b) for k, a, b in loose_spans(text)} - own
    return [(k, a, b, strict, pattern(k, votes(KINDS[k], text, a, b, strict)) * _MARKS + marks(text, a, b)) for k, a, b, strict in sorted([(*x, True) for x in own] + [(*x, False) for x in rest])]


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], dict]:
    """Expectation-maximisation over vote patterns: ({pattern: posterior}, what was estimated). Two classes, labelers
    independent given the class; each kind has its own share. Starts from the majority of votes."""
    codes = sorted(counts)
    if not codes:
        return {}, {}
    kinds = np.array([unpattern(c)[0] for c in codes])
    v = np.array([unpattern(c)[1] for c in codes])
    n = np.array([counts[c] for c in codes], float)
    post = np.clip(((v == 1).sum(1) + 0.5) / ((v >= 0).sum(1) + 1), 0.05, 0.95)
    share, rate = np.full(len(KINDS), 0.5), np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            m = kinds == k
            share[k] = ((n * post)[m].sum() + 1) / (n[m].sum() + 2)
        for c, p in enumerate((1 - post, post)):
            for x in (-1, 0, 1):
                # A prior of a right vote being likelier than a wrong one keeps the classes from changing places.
                prior = 2.0 if (x == 1 and c) or (x == 0 and not c) else 1.0
                rate[c, :, x + 1] = ((n * p)[:, None] * (v == x)).sum(0) + prior
            rate[c] /= rate[c].sum(1, keepdims=True)
        ll = [np.where(v < -1, 0.0, np.log(rate[c][np.arange(len(LABELERS))[None, :], np.maximum(v, -1) + 1])).sum(1) for c in (0, 1)]
        z = np.log(share[kinds] / (1 - share[kinds])) + ll[1] - ll[0]
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    told = {"share": dict(zip(KINDS, share.tolist())), "right": {name: (float(rate[1, i, 2]), float(rate[0, i, 1])) for i, name in enumerate(LABELERS)}}
    return dict(zip(codes, post.tolist())), told


def _features(codes: list[int]) -> np.ndarray:
    """Kind, votes, marks, and each mark within each kind."""
    rows = []
    for c in codes:
        votes, m = divmod(c, _MARKS)
        k, v = unpattern(votes)
        kinds, own = [float(k == i) for i in range(len(KINDS))], [float(m >> i & 1) for i in range(len(MARKS))]
        rows.append([1.0, *kinds, *[float(x == 1) for x in v], *[float(x == 0) for x in v], *[float(x == -1) for x in v], float(v[1] == 1 and v[3] == 1), *own, *[x * y for x in kinds for y in own]])
    return np.array(rows)


def classifier(counts: dict[int, int], posterior: dict[int, float], steps: int = 60, l2: float = 1.0) -> dict[int, float]:
    """Logistic span classifier, by Newton steps, on the posteriors that the spans' votes have: {pattern of votes and
    marks: probability}."""
    codes = sorted(counts)
    if not codes:
        return {}
    x, y, n = _features(codes), np.array([posterior[c // _MARKS] for c in codes]), np.array([counts[c] for c in codes], float)
    n = n / n.sum() * min(n.sum(), 10_000.0)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + l2 * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _spans(rows: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(rows))


def find(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, n_other, base_sha256, spans; one row per row.

    spans is kind:start:end by kind, then start, comma-joined, in code points, end exclusive. Counts are of all spans of
    the kind. Null text counts as empty: no spans. Repeated rows and null doc_ids come back as they are; an empty table
    gives an empty table; other columns are ignored.
    """

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [candidates(t) for t in b.column(1).to_pylist()]
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int64())])
        rows = [[dict(zip(("kind", "start", "end", "base", "votes"), c)) for c in f] for f in found]
        return batch(["doc_id", "spans"], b.column(0), pa.array(rows, pa.list_(kind)))

    schema = "doc_id long, spans array<struct<kind:int,start:long,end:long,base:boolean,votes:long>>"
    seen = materialize(map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), read, schema), "candidates")
    # At most 6 kinds x 4^6 patterns of votes x 2^7 of marks, of which few occur.
    counts = {r["votes"]: r["n"] for r in seen.select(F.explode("spans").alias("s")).groupBy("s.votes").agg(F.count("*").alias("n")).collect()}
    voted: dict[int, int] = {}
    for c, n in counts.items():
        voted[c // _MARKS] = voted.get(c // _MARKS, 0) + n
    posterior, _ = reliabilities(voted)
    good = frozenset(c for c, p in classifier(counts, posterior).items() if p >= accept)

    def tell(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in b.column(1).to_pylist():
            base = sorted((s["kind"], s["start"], s["end"]) for s in spans if s["base"])
            taken = [(a, e) for _, a, e in base]
            extra = []
            for s in spans:
                if not s["base"] and s["votes"] in good and not any(a < s["end"] and s["start"] < e for a, e in taken):
                    extra.append((s["kind"], s["start"], s["end"]))
                    taken.append((s["start"], s["end"]))
            every = base + extra
            out.append((*[sum(k == i for k, _, _ in every) for i in range(4)], sum(k > 3 for k, _, _ in every), hashlib.sha256(_spans(base).encode()).hexdigest(), _spans(every)))
        cols = list(zip(*out)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.string()] * 2
        return batch(["doc_id", *[f"n_{k}" for k in BASE], "n_other", "base_sha256", "spans"], b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)])

    return map_arrow(seen, tell, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_other long, base_sha256 string, spans string")
