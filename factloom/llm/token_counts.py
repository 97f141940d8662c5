"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

The vocabulary is that of a sentencepiece model file: its normal and user-defined pieces with their scores. An
Aho-Corasick automaton over the pieces enumerates every match; a dynamic program over the match ends carries the best
score so far and the number of pieces on that path, nothing else. The tie rule is the tokenizer's: among equal scores
the match that starts first, the longest one, stays. Where no piece of one character matches, an unknown edge of
``least score - 10`` spans the character and counts as its UTF-8 bytes (byte fallback).

Sums are exact in float64 (the scores are whole numbers), as in the `tokenizers` library's Unigram model. So a text may
be cut wherever no piece can span: before each run of spaces, if no piece has a space behind another character. The
counts of such units are kept in a cache of bounded size.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, text_or_empty

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Units kept, and the longest one.
CACHE, CACHE_CHARS = 400_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class UnigramCounter:
    """score, count = counter.unit(text) for escaped text; counter(text) counts a whole raw text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cuts = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces)
        self.cache: dict[str, tuple[float, int]] = {}

    @classmethod
    def from_model(cls, path: str) -> UnigramCounter:
        return _load(path)

    def unit(self, text: str) -> tuple[float, int]:
        n = len(text)
        score = [0.0] + [None] * n
        count = [0] * (n + 1)
        best_start = [0] * (n + 1)
        single = [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, s) in self.automaton.iter(text):
            ends[end + 1].append((end + 1 - length, s))
            if length == 1:
                single[end] = True
        run = False
        for e in range(1, n + 1):
            best, at, k = None, 0, 0
            for start, s in ends[e]:
                c = score[start] + s
                if best is None or c > best or (c == best and start < at):
                    best, at, k = c, start, count[start] + 1
            if not single[e - 1]:
                c = score[e - 1] + self.unknown
                if best is None or c > best:  # it starts last: at a tie the piece stays
                    width = len(text[e - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                    fused = not self.byte_fallback and e > 1 and run and best_start[e - 1] == -1
                    best, at, k = c, -1, count[e - 1] + (0 if fused else width)
            run = at == -1
            score[e], best_start[e], count[e] = best, at, k
        return score[n], count[n]

    def _unit(self, text: str) -> tuple[float, int]:
        found = self.cache.get(text)
        if found is None:
            found = self.unit(text)
            if len(text) <= CACHE_CHARS:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[text] = found
        return found

    def __call__(self, text: str | None) -> tuple[float, int]:
        """(score, tokens). Empty or null text: no tokens, else a space is put in front."""
        if not text:
            return 0.0, 0
        text = text.replace(SPACE, " ")
        if not self.cuts:
            return self.unit(SPACE + text.replace(" ", SPACE))
        if "  " in text or text[0] == " ":
            units = [u.replace(" ", SPACE) for u in re.findall(" +[^ ]*", " " + text)]
        else:
            units = [SPACE + u for u in text.split(" ")]
        score, total = 0.0, 0
        get, slow = self.cache.get, self._unit
        for u in units:
            s, n = get(u) or slow(u)
            score += s
            total += n
        return score, total


@lru_cache(maxsize=2)
def _load(path: str) -> UnigramCounter:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)
    return UnigramCounter([(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not skip(i)])


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_chars, n_tokens, score), one row per row.

    Null text counts as empty, which has no tokens and score 0. Texts are counted whole, however long; a null doc_id
    comes back as null; repeated rows come back repeated; an empty table gives an empty table; other columns are
    ignored. A literal U+2581 counts as a space, as in the tokenizer.
    """
    path = model or default_model()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        counter = UnigramCounter.from_model(path)
        out = [(len(t), *counter(t)) for t in b.column(1).to_pylist()]
        return batch(
            ["doc_id", "n_chars", "n_tokens", "score"], b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), fn, "doc_id long, n_chars long, n_tokens long, score double")
