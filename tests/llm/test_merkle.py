import hashlib
import random
import zlib

import pytest

from factloom.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, digest int, proof string, idx string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, width):
    """The root of the nodes and, for each, its (left, right) siblings a level."""
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % width
            way[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + width])))
        nodes = [sha(*nodes[i : i + width]) for i in range(0, len(nodes), width)]
        at = [i // width for i in at]
    return nodes[0], way


def brute(rows, width=2):
    """{(doc_id, leaf): (subroot, root, proof)} of rows whose pairs of doc_id and leaf differ."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r[:5]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], width) for g in order}
    root, upper = tree([trees[g][0] for g in order], width)
    return {(x[3], x[2]): (trees[g][0], root, way + upper[k]) for k, g in enumerate(order) for x, way in zip(sorted(groups[g]), trees[g][1])}


def fold(h, proof):
    for a, b in proof:
        h = sha(a, h, b)
    return h


def make(n, seed=1):
    rng = random.Random(seed)
    some = lambda *v: rng.choice([None, *v])
    rows = [(i, some("s", "é"), rng.choice([None, "", "de", "en", "en", "en", "日本"]), some(0, 7), some("", "a", "ü b", "x" * 5000)) for i in rng.sample(range(-50, 10 * n), n)]
    return rows + [(None, "s", "en", 1, "x"), (None, "s", "en", 2, "x"), (4, None, None, None, None), (4, "", "", None, "")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "p", "i") for r in rows], DOCS)


VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("n, width, levels", [(150, 2, 3), (90, 3, 2), (3, 2, 8), (40, 2, 1)])
def test_against_brute_force(spark, n, width, levels):
    rows = make(n)
    want = brute(rows, width)
    got = merkle.manifest(frame(spark, rows), "lang", "doc_id", VALUES, width=width, levels=levels).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.subroot, r.root, [tuple(s) for s in r.proof]) == want[r.doc_id, r.leaf]
        assert fold(r.leaf, r.proof) == r.root


def test_query(spark, tmp_path):
    """The query's digests, and that it finds exactly the tampered rows."""
    rows = make(200, 3)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows)
    of = {(r[0], leaf(r[:5])): r for r in rows}
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    tampered = 0
    for r in got:
        subroot, root, proof = want[r.doc_id, r.leaf]
        own = of[r.doc_id, r.leaf]
        touched = r.doc_id is not None and own[3] is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        assert (r.subroot, r.root, r.proof_sha256) == (subroot, root, sha(*(a + b for a, b in proof)))
        assert r.folded_root == fold(leaf((*own[:3], own[3] + 1, own[4])) if touched else r.leaf, proof) and r.verified == (not touched)
        tampered += touched
    assert 5 < tampered < 60


def test_repeated_rows_and_one_row(spark):
    """Equal rows are leaves of their own; a single row is its own root, with an empty proof."""
    rows = [(1, "s", "en", 3, "abc")] * 5 + [(None, None, None, None, None)] * 4
    got = merkle.manifest(frame(spark, rows), "lang", "doc_id", VALUES).collect()
    assert len(got) == 9 and all(fold(r.leaf, r.proof) == r.root for r in got) and len({r.root for r in got}) == 1 and len({str(r.proof) for r in got if r.doc_id == 1}) == 5
    (one,) = merkle.manifest(frame(spark, rows[:1]), "lang", "doc_id", VALUES).collect()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_empty(spark):
    out = merkle.manifest(frame(spark, []).limit(0), "lang", "doc_id", VALUES)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
