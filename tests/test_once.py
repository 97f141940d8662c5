"""Long rules, embedders and texts are asked once for each row, in all tasks, and rules that skip work agree with those that don't."""

import math
from collections import Counter

import pytest

from factloom.functions import text
from factloom.operators import entities, graph, postings, retrieve, vector
from pyspark.sql import functions as F

@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


FACTS = "id long, file_id long, subject string, predicate string, object string, confidence int, status string, title string, description string"


def facts(spark, n):
    rows = [(i, i % 3, f"Name {i}", "is", "1995-01-02" if i % 4 == 0 else f"Thing_{i % 7}", 50, "active" if i % 5 else "deleted", "", "") for i in range(n)]
    return spark.createDataFrame(rows, FACTS).coalesce(1)


def test_name_rules(spark):
    """counts by sorted runs, against counting; names that pass by one pattern are no literals."""
    names = ["", "a", "aab", "aabb", "\n\n\nx", "漢字漢字", "\U0001f600\U0001f600ab\U0001f600\U0001f600", "Customer#000000001", "abcabcabc", ".*.*.*", None]
    odd = ["12kg", "温度 3℃", "5 元", "１２３", " 42 ", "'7'", "+5", "a1b2c3d4e5f6", "1995-01-02", "12:30", "139-12345678", "x 10^9/L", "10^9/L", "NATION_7", "Name 7m", " 7 "]
    got = spark.createDataFrame([(n,) for n in names + odd], "name string").select("name", text.char_entropy(F.col("name")).alias("h"), text.repeated_ngrams(F.col("name")).alias("g"), text.has_repeated_chars(F.col("name")).alias("r")).collect()
    for row in got:
        t = row.name
        if t is None:
            continue
        grams = Counter(t[i : i + 2] for i in range(len(t) - 1))
        assert math.isclose(row.h, sum(-k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()), abs_tol=1e-9)
        assert math.isclose(row.g, sum(k > 1 for k in grams.values()) / len(grams) if len(t) >= 4 else 0.0)
        assert row.r == any(k >= 4 for k in Counter(t).values())
    want = {"", "12kg", "5 元", "１２３", " 42 ", "'7'", "a1b2c3d4e5f6", "1995-01-02", "12:30", " 7 "} - {"'7'", " 7 "}
    said = {r.name: r.l for r in spark.createDataFrame([(n,) for n in names + odd], "name string").select("name", text.is_literal(F.col("name")).alias("l")).collect()}
    assert all(said[n] for n in want) and not any(said[n] for n in ("Customer#000000001", "NATION_7", "139-12345678", "abcabcabc")) and said[None] is None


def test_names_in_batches(spark):
    """gibberish counted in batches is what the expressions say; F17 to F19: so is the one pattern that most names pass by."""
    names = ["", " ", "a", "aab", "aabb", "aaaa", "abababab", "漢字漢字", "漢字漢a", "\U0001f600\U0001f600ab", "\x00x\u200by", "\x85x", "[@`{^", "Customer#000000001", "x\n", " 7元", "7元", "a\u2028", None]
    d = spark.createDataFrame([(n,) for n in names], "name string").repartition(3)
    c, long_before = F.col("name"), r"""(?U)^[\p{Nd}.+\-,，'"\s]|[元块角分万亿千百天年月日周时钟秒个只条件次项笔张份篇页本节章%％倍成点股手lLgmzBs]$|^[A-Za-z0-9]{12,}$"""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    each = d.select("name", text.gibberish(c).alias("a"), text.gibberish_of(c).alias("b"), trimmed.alias("t"), text.trim(c).alias("u"), trimmed.rlike(long_before).alias("o"), trimmed.rlike(text._ODD).alias("p"))
    got = each.collect()
    assert len(got) == len(names) and all(r.a == r.b and r.t == r.u and r.o == r.p for r in got)
    assert text.gibberish_scores([]).tolist() == []


def test_explore_builds_edges_once(spark, monkeypatch):
    """the search for a name reads the written edges that the expansion reads too."""
    read, search = [], graph.search_nodes
    monkeypatch.setattr(graph, "search_nodes", lambda edges, *a: read.append(edges.inputFiles()) or search(edges, *a))
    found, _ = graph.explore(graph.build_edges(facts(spark, 200)), "thing_1", 1)
    assert all("/edges-" in f for f in read[0]) and {r.name for r in found.collect() if r.depth == 0} == {"Thing_1"}


def test_a_question_reads_facts_once(spark):
    """F16: a question cuts the facts' words once and asks for its lists' facts once with the graph and once without."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(x):
        asked.add(1)
        return x

    rows = facts(spark, 400).withColumn("user_score", F.lit(1.0)).withColumn("evidence_span", F.col("subject"))
    table = rows.withColumn("title", told.asNondeterministic()(F.col("title")))
    files = spark.createDataFrame([(i, "/a.md") for i in range(3)], "id long, path string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(400)], "fact_id long, embedding array<float>")
    out = retrieve.ask("thing 1", table, files, vectors, lambda _: [[1.0, 0.0]], edges=graph.build_edges(rows))
    assert out["count"] == 10 and asked.value <= 3 * 400


def test_facts_are_dealt(spark, uncoalesced):
    """F9, F15 to F19: facts of one partition reach all tasks before the literal rules; F3: traits stand with the entities."""
    live = graph.live_facts(facts(spark, 2000))
    assert len(live.inputFiles()) > 1
    assert live.count() == 1600 and live.filter("literal").count() == 400
    files = spark.createDataFrame([(i, "/a.md", None) for i in range(3)], "id long, path string, error_msg string")
    table = entities.entity_table(facts(spark, 2000), files)
    assert "score" in table.columns and {c for c in entities.check(table).columns if c[0] == "_"} == set()
    assert table.count() == 1600 + 7


def test_words_are_cut_once(spark, tmp_path, uncoalesced):
    """the words of documents are written, dealt to all tasks, before they are counted."""
    words = postings.told(facts(spark, 2000))
    assert len(words.inputFiles()) > 1 and words.count() == 2000
    index = postings.build(facts(spark, 300), str(tmp_path / "i"))
    assert {r.term: r.df for r in index.totals().collect()}["name"] == 300


def test_names_are_embedded_once(spark):
    """F6 to F8: with one block of heads, each name is embedded once, and the heads once more."""
    asked, inner = spark.sparkContext.accumulator(0), vector.hash_embedder(8)

    def embedder(texts):
        asked.add(len(texts))
        return inner(texts)

    names = spark.createDataFrame([(f"name{'abcdefgh'[i % 8]} x{i:04d}y",) for i in range(800)], "name string")
    found = entities.merge_candidates(vector.embed(names, "name", embedder), 0.3, most=20).collect()
    assert len(found) == 20 and asked.value <= 800 + entities.HEADS
