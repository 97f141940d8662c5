"""Answers cut at every place, and their continuations."""

import json

from factloom.functions import truncation
from factloom.operators import lifecycle
from pyspark.sql import functions as F

FACTS = [
    {"subject": "Ada", "predicate": "wrote \"notes\"", "object": "on {engines]", "confidence": 80, "tags": ["a}", "[b"]},
    {"subject": "Élan", "predicate": "is", "object": "back\\slash \\\" quote", "confidence": 70},
    {"subject": "C", "predicate": "has", "object": "D", "extra": {"deep": [{"subject": "no", "predicate": "no", "object": "no"}]}},
]
SHAPES = [lambda f: json.dumps({"facts": f}), lambda f: json.dumps(f, ensure_ascii=False), lambda f: "```json\n" + json.dumps({"facts": f}, indent=1) + "\n```"]


def triples(facts):
    return [(f["subject"], f["predicate"], f["object"]) for f in facts]


def ends(text):
    """Where each fact of a whole answer ends, by a parser of its own."""
    out, at, read = [], text.index("["), json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        out.append(read.raw_decode(text, at)[1])
        at = out[-1]
    return out


def test_every_cut():
    for shape in SHAPES:
        text, want = shape(FACTS), triples(FACTS)
        places = ends(text)
        for at in range(len(text) + 1):
            n = sum(e <= at for e in places)
            facts, resume, whole = truncation.complete_facts(text[:at])
            assert triples(facts) == want[:n] and resume == ([0, *places][n] if not whole else resume), (at, text[:at])
            if n and not whole:
                closed = text[:resume] + truncation.Cut().feed(text[:at]).closing
                assert triples(truncation.errors.tolerant_facts(closed)) == want[:n]
            # Taken up where it was cut, after the last whole fact, or by an answer with what remains.
            assert triples(truncation.joined(text[:at], text[at:])) == want
            assert triples(truncation.joined(text[:at], SHAPES[0](FACTS[n:]))) == want
            if n < 3 and 0 < resume:
                assert triples(truncation.joined(text[:at], text[resume:])) == want


def test_pieces_are_read_like_the_whole():
    text = SHAPES[2](FACTS)
    whole = truncation.Cut().feed(text)
    for step in (1, 2, 7):
        cut = truncation.Cut()
        for i in range(0, len(text), step):
            cut.feed(text[i : i + step])
        assert vars(cut) == vars(whole)


def test_odd_answers():
    for odd in (None, "", "no JSON", '"', "}]", "[", "{", '{"facts": [', "[1, 2", '{"facts": [{"subject": 1}'):
        assert truncation.complete_facts(odd)[0] == []
    assert truncation.joined("", "") == [] and truncation.joined("no", "JSON") == []
    same = json.dumps([{**FACTS[0], "confidence": 90}])
    assert truncation.joined(SHAPES[0](FACTS)[:-1], same)[0]["confidence"] == 90


def test_extraction_goes_on(spark):
    whole = json.dumps({"facts": [{"subject": f"s{i}", "predicate": "is", "object": "o", "confidence": 60} for i in range(6)]})

    def ask(chunk, r):
        return whole[: int(chunk)], int(chunk) < len(whole)

    def go_on(chunk, r, so_far):
        at = len(so_far)
        return whole[at : at + 150], at + 150 < len(whole)

    chunks = spark.createDataFrame([(i, 1, str(n)) for i, n in enumerate((0, 100, 333, 10**4))], "id long, file_id long, content string")
    got = lifecycle.extract(chunks, truncation.recovering(ask, go_on), rounds=1)
    n = {r["chunk_id"]: r["n"] for r in got.groupBy("chunk_id").agg(F.count("subject").alias("n")).collect()}
    assert n == {0: n[0], 1: 6, 2: 6, 3: 6} and n[0] >= 5
    # Three continuations of 150 characters do not reach the end from nothing: what is complete counts.
    assert n[0] == len(truncation.complete_facts(whole[:450])[0])
    told = spark.createDataFrame([(whole[:200],), (None,)], "a string").select(truncation.cut_state(F.col("a")).alias("s")).select("s.*").collect()
    assert len(told[0]["facts"]) == len(truncation.complete_facts(whole[:200])[0]) and told[1]["facts"] == [] and not told[1]["whole"]
