import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pytest

from factloom.llm import packing as K

DOCS = "doc_id long, text string, length string, piece int"


def optimum(lengths, capacity):
    """Least number of bins, by search over assignments."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                at = rooms.index(r)
                go(i + 1, rooms[:at] + [r - lengths[i]] + rooms[at + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_least_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
    counts = np.bincount(lengths, minlength=21)
    plan = K.bin_completion(counts, 20)
    assert np.array_equal(np.bincount([x for f, t in plan for x in f for _ in range(t)], minlength=21), counts)
    assert all(sum(f) <= 20 for f, _ in plan)
    assert sum(t for _, t in plan) == optimum(lengths, 20) >= K.lower_bound(counts, 20)


def test_large_counts_reach_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(rng.integers(1, 1024, 50000), minlength=1025)
    assert sum(t for _, t in K.bin_completion(counts)) <= K.lower_bound(counts, 1024) * 1.003


def test_dominance_and_cut():
    assert K._dominates((10,), (4, 6)) and K._dominates((7, 3), (4, 3, 3)) and not K._dominates((7, 3), (5, 4))
    assert K.cut(1024, 1024) == [(0, 1024)] and K.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]
    assert list(combinations_with_replacement("a", 1)) == [("a",)]


def test_packs_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "x<|endoftext|>y 's 一  z"), (-4, "ab1" * 5000), (None, "null id"), (-1, None)]
    out = K.pack(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(K.default_tokenizer())
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(str(i), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(K.cut(len(ids), 1024))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    counts = np.bincount([r.length for r in out], minlength=1025)
    assert len(bins) <= K.lower_bound(counts, 1024) + 1
    assert K.pack(spark.createDataFrame([], DOCS)).count() == 0
