"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's score has weights on its own features and on those of the lines before and after it;
a transition score couples neighbours. Trained on documents whose lines all carry the document's label. The forward and
backward passes give each line's marginal; the mean of the marginals, weighted by line length, is the document's
quality, and a logistic map fitted on the same training documents turns it into a score from 0 to 1.

Features count characters and words; they know no vocabulary, language, source or id. The training sample is bounded:
at most `TRAIN_DOCS` labelled documents, chosen by a hash of the doc_id, and of each one stretch of at most `TRAIN_LINES`
neighbouring lines at a random place; the lines beside it count as neighbours. Scoring reads every line of every text.
"""

from __future__ import annotations

import math
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, text_or_empty

TRAIN_DOCS, TRAIN_LINES = 6000, 64
#: predicted is 1 from this score on.
THRESHOLD = 0.3

_CLASSES = 9  # lower, upper, digit, blank, stop, comma-like, bracket-like, other symbol, other letter
_STOPS, _COMMAS, _BRACKETS = ".?…。", ",;:'\"’-–", "()[]{}<>|/\\_=+*&^%$#@~`"


def _table() -> np.ndarray:
    t = np.full(0x10000, 8, np.uint8)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x in _STOPS:
            t[c] = 4
        elif x in _COMMAS:
            t[c] = 5
        elif x in _BRACKETS:
            t[c] = 6
        elif x.isspace():
            t[c] = 3
        elif x.isdigit():
            t[c] = 2
        elif x.isupper():
            t[c] = 1
        elif x.islower():
            t[c] = 0
        elif not x.isalpha():
            t[c] = 7
    return t


TABLE = _table()
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "blank", "stop", "comma", "bracket", "symbol", "other",
    "distinct", "repeats", "most_symbols", "shouts", "dull", "ends", "starts", "tail", "short", "empty",
)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths)."""
    lines = text.split("\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = TABLE[np.minimum(codes, 0xFFFF)]
    owner = np.repeat(np.arange(len(lines)), lengths + 1)[: len(codes)]
    counts = np.bincount(owner * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES).astype(np.float64)
    counts[:-1, 3] -= 1  # the newlines
    n = np.maximum(lengths, 1)
    part = counts / n[:, None]
    words = np.zeros(len(lines))
    distinct = np.ones(len(lines))
    repeats = np.zeros(len(lines))
    ends, starts, tail = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        if not w:
            continue
        words[i] = len(w)
        distinct[i] = len(set(w)) / len(w)
        repeats[i] = sum(map(eq, w, islice(w, 1, None))) / len(w)
        ends[i] = line.rstrip()[-1] in ".?!…。"
        starts[i] = w[0][0].isupper()
        tail[i] = w[-1][-1] in _BRACKETS
    nw = np.maximum(words, 1)
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    symbols = (counts[:, 6] + counts[:, 7]) / nw
    x = np.column_stack(
        [
            np.log1p(lengths), np.log1p(words), np.minimum(lengths / nw, 40) / 10, upper, part[:, 2], part[:, 3], part[:, 4] * 10, part[:, 5] * 10,
            np.minimum(part[:, 6] * 10, 5), np.minimum(part[:, 7] * 10, 5), part[:, 8], distinct, repeats, np.minimum(symbols, 4), upper > 0.5,
            (distinct < 0.4) & (words >= 5), ends, starts, tail, words < 4, words == 0,
        ]
    )
    return x, lengths


def with_neighbours(x: np.ndarray) -> np.ndarray:
    none = np.zeros((1, x.shape[1]))
    edge = np.zeros((len(x), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.column_stack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none]), edge])


def marginals(u: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(line is good) by forward-backward. u: log-odds of good by the features; t[a][b]: score of b after a (0 bad, 1 good)."""
    e00, e01, e10, e11 = (math.exp(t[0][0]), math.exp(t[0][1]), math.exp(t[1][0]), math.exp(t[1][1]))
    n = len(u)
    clipped = np.clip(u, -30, 30).tolist()
    exp, log = math.exp, math.log
    fore, a = [0.0] * n, clipped[0]
    fore[0] = a
    for i in range(1, n):
        r = exp(a)
        a = max(-60.0, min(60.0, clipped[i] + log((r * e11 + e01) / (r * e10 + e00))))
        fore[i] = a
    back, b = [0.0] * n, 0.0
    for i in range(n - 2, -1, -1):
        r = exp(max(-60.0, min(60.0, b + clipped[i + 1])))
        b = log((r * e11 + e10) / (r * e01 + e00))
        back[i] = b
    z = np.array(fore) + np.array(back)
    return 1 / (1 + np.exp(-z))


class LineModel:
    """Trained weights; `score(text)` -> (score, lines, good lines)."""

    def __init__(self, mean, std, w, bias, t, a, b):
        self.mean, self.std, self.w, self.bias, self.t, self.a, self.b = mean, std, w, bias, t, a, b

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.w + self.bias

    def quality(self, text: str) -> tuple[float, np.ndarray]:
        x, lengths = line_features(text)
        p = marginals(self.emission(with_neighbours(x)), self.t)
        weight = np.maximum(lengths, 1)
        return float((p * weight).sum() / weight.sum()), p

    def score(self, text: str) -> tuple[float, int, int]:
        q, p = self.quality(text)
        z = self.a * _logit(q) + self.b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), len(p), int((p >= 0.5).sum())


def _logit(q):
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _gradient(seqs, w, bias, t, l2):
    """Negative log-likelihood and gradient; seqs: blocks of equal length (features: docs x lines x f, label of each)."""
    loss, gw, gb, gt = l2 * float(w @ w) / 2, l2 * w, 0.0, l2 * t.copy()
    for x, y in seqs:
        d, n, _ = x.shape
        u = x @ w + bias
        emit = np.stack([np.zeros_like(u), u], axis=2)
        fore = np.empty((n, d, 2))
        fore[0] = emit[:, 0]
        for i in range(1, n):
            fore[i] = emit[:, i] + np.logaddexp(fore[i - 1][:, :1] + t[0], fore[i - 1][:, 1:] + t[1])
        back = np.zeros((n, d, 2))
        for i in range(n - 2, -1, -1):
            nxt = emit[:, i + 1] + back[i + 1]
            back[i] = np.logaddexp(t[:, 0][None, :] + nxt[:, :1], t[:, 1][None, :] + nxt[:, 1:])
        z = np.logaddexp(fore[-1][:, 0], fore[-1][:, 1])
        p = np.exp(fore[:, :, 1] + back[:, :, 1] - z).T  # docs x lines
        same = t[y, y] * (n - 1)
        loss += float((z - (u.sum(axis=1) * y + same)).sum())
        err = p - y[:, None]
        gw = gw + np.einsum("dl,dlf->f", err, x)
        gb += float(err.sum())
        for i in range(1, n):
            pair = fore[i - 1][:, :, None] + t[None] + (emit[:, i] + back[i])[:, None, :] - z[:, None, None]
            gt += np.exp(pair).sum(axis=0)
        for c in (0, 1):
            gt[c, c] -= (n - 1) * float((y == c).sum())
    return loss, gw, gb, gt


Example = tuple[np.ndarray, np.ndarray, int, bool, bool]


def stretch(x: np.ndarray, n: np.ndarray, lines: int, at: int) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """`lines` neighbouring lines from a place that `at`, any number, chooses, with the line before and the line behind if
    there are such; whether there are."""
    start = at % max(1, len(x) - lines + 1)
    a, b = max(0, start - 1), min(len(x), start + lines + 1)
    return x[a:b], n[a:b], a < start, b > start + lines


def with_context(x: np.ndarray, n: np.ndarray, before: bool, behind: bool) -> tuple[np.ndarray, np.ndarray]:
    """A stretch's features with its neighbours', and lengths, without the lines beside it."""
    own = slice(int(before), len(x) - int(behind))
    return with_neighbours(x)[own], n[own]


def train(docs: list[Example], rounds: int = 120, l2: float = 3.0) -> LineModel:
    """docs: (line features, line lengths, label, a line before, a line behind). Without both labels the score is constant: the share of label 1, or 0.5."""
    width = 3 * len(NAMES) + 2
    labels = {y for _, _, y, _, _ in docs}
    if len(labels) < 2:
        share = 0.5 if not docs else (0.98 if 1 in labels else 0.02)
        return LineModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), 0.0, math.log(share / (1 - share)))
    # One table of all lines with their neighbours, in float64, is what is held: groups of equal length are slices of it.
    sized = [len(n) - before - behind for _, n, _, before, behind in docs]
    order = sorted(range(len(docs)), key=sized.__getitem__)
    ends = np.cumsum([sized[i] for i in order])
    table = np.empty((int(ends[-1]), width))
    lengths, y = np.empty(len(table), np.int64), np.array([docs[i][2] for i in order])
    for i, end in zip(order, ends):
        x, n, _, before, behind = docs[i]
        table[end - sized[i] : end], lengths[end - sized[i] : end] = with_context(x, n, before, behind)
    mean = table.mean(axis=0)
    table -= mean
    std = np.sqrt(np.einsum("lf,lf->f", table, table) / len(table))
    std[std < 1e-9] = 1.0
    table /= std
    seqs, sizes = [], np.array([sized[i] for i in order])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        at = int(ends[own[0]]) - size
        seqs.append((table[at : at + size * len(own)].reshape(len(own), size, width), y[own]))
    w, bias, t = np.zeros(width), 0.0, np.zeros((2, 2))
    flat = lambda gw, gb, gt: np.concatenate((gw, [gb], gt.ravel()))
    p, m, v = flat(w, bias, t), np.zeros(width + 5), np.zeros(width + 5)
    for k in range(1, rounds + 1):  # Adam with a falling step
        _, gw, gb, gt = _gradient(seqs, p[:width], p[width], p[width + 1 :].reshape(2, 2), l2)
        g = flat(gw, gb, gt) / len(docs)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.15 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = LineModel(mean, std, p[:width], float(p[width]), p[width + 1 :].reshape(2, 2), 1.0, 0.0)
    q = []
    for size, end in zip(sizes, ends):
        own = slice(int(end) - size, int(end))
        weight = np.maximum(lengths[own], 1)
        q.append(float((marginals(table[own] @ model.w + model.bias, model.t) * weight).sum() / weight.sum()))
    z = _logit(np.array(q))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic map
        s = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = s - y, s * (1 - s) + 1e-9
        grad = np.array([(r * z).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    model.a, model.b = max(a, 0.05), b
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 5; 0 is held out. Null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % 5


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> list[Example]:
    """At most `most` labelled documents outside the held-out fifth, as line features; one stretch of `lines` lines of each.

    A doc_id counts once, with its least text and least label, so that the bound holds for rows as well.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(remainder(F.col("doc_id")) != 0)
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"), F.xxhash64("doc_id", F.lit(11)).alias("at"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, q, t, at in zip(*[b.column(c).to_pylist() for c in range(4)]):
            x, n, before, behind = stretch(*line_features(t), lines, at)
            rows.append((i, int(q), x.astype(np.float32).tobytes(), n.astype(np.int64).tobytes(), before, behind))
        cols = list(zip(*rows)) or [[]] * 6
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
        return batch(["doc_id", "quality", "x", "n", "before", "behind"], *[pa.array(c, ty) for c, ty in zip(cols, types)])

    found = map_arrow(texts, fn, "doc_id long, quality int, x binary, n binary, before boolean, behind boolean").toArrow()
    rows = sorted(zip(*[found.column(c).to_pylist() for c in range(6)]))
    return [(np.frombuffer(x, np.float32).reshape(-1, len(NAMES)), np.frombuffer(n, np.int64), q, before, behind) for _, q, x, n, before, behind in rows]


def quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> doc_id, held_out, score, predicted, n_lines, n_good.

    One row per row of docs. Null text counts as empty: one empty line. Texts are read whole. held_out: crc32(doc_id as
    text) mod 5 is 0; false for a null doc_id. Labels other than 0 and 1 are ignored; a doc_id with both counts as 0. If
    no usable label is left, or of one kind only, the score is one constant. Other columns are ignored. An empty table
    gives an empty table. Training reads at most `most` documents and `lines` lines of each.
    """
    model = train(training_sample(docs, labels, most, lines))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        s = [m.score(t) for t in b.column(1).to_pylist()]
        score = np.array([x[0] for x in s], np.float64)
        return batch(
            ["doc_id", "held_out", "score", "predicted", "n_lines", "n_good"], b.column(0), b.column(2), score, (score >= threshold).astype(np.int32),
            pa.array([x[1] for x in s], pa.int64()), pa.array([x[2] for x in s], pa.int64()),
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    return map_arrow(own, fn, "doc_id long, held_out boolean, score double, predicted int, n_lines long, n_good long")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, lines: int = TRAIN_LINES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose predicted quality is 1. Rows without doc_id are judged by their text like any other."""
    model = train(training_sample(docs, labels, most, lines))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        good = [held.value.score(t or "")[0] >= threshold for t in b.column(at).to_pylist()]
        return b.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, fn, docs.schema)
