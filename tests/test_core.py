"""Operators against hand-made inputs and plain models."""

import random
import sqlite3

import pytest

import __spark_entry__ as entry
from factloom import queries
from factloom.functions import errors, text
from factloom.operators import entities, fulltext, graph, lifecycle, relational, retrieve, stored_graph, updates, vector
from factloom.plans.components import connected_components
from factloom.sources import files as source_files
from factloom.streaming import feeds
from pyspark.sql import functions as F
from tests.compare import connect, differ


def test_entry(spark):
    assert entry.entry(spark).count() > 0


TWINS = sorted(n for n in queries.ORACLE_SQL)


@pytest.mark.parametrize("group", range(6))
def test_against_sql(spark, sf, group):
    """Every core query with SQL gives the SQL's rows."""
    con = connect(sf)
    wrong = {n: differ(spark, con, queries.QUERIES[n], queries.ORACLE_SQL[n], sf) for n in TWINS[group::6]}
    assert not {n: w for n, w in wrong.items() if w}


def test_no_twin_is_empty(sf):
    """A comparison of no rows would show nothing; and updates change some rows."""
    con = connect(sf.replace("0.001", "0.01"))
    assert not [n for n in TWINS if not con.execute(f"SELECT count(*) FROM ({queries.ORACLE_SQL[n]})").fetchone()[0]]
    for name in ("upd_07_rename", "upd_08_delete_entity", "upd_09_batch", "gr_05_merge_nodes"):
        table = "e" if name.startswith("gr") else "facts"
        sql = queries.ORACLE_SQL[name]
        columns = "src, dst" if table == "e" else ", ".join(d[0] for d in con.execute(sql).description)
        head, _, _ = sql.rpartition("SELECT DISTINCT" if table == "e" else "SELECT id")
        assert con.execute(f"{head} SELECT count(*) FROM (SELECT {columns} FROM {table} EXCEPT ({sql[len(head):]}))").fetchone()[0], name


def test_every_query_has_a_stable_schema(spark, sf):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in ("er_01_candidates", "str_08_chunk", "ix_01_run", "vec_05_near_dedup"):
        a, b = (queries.QUERIES[n](spark, sf).schema for _ in range(2))
        assert a == b and len(a)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chunker():
    assert text.chunk("  ") == [] and text.chunk(None) == []
    assert text.chunk("red\n\ngreen\n\nblue", 30, 0) == ["red\n\ngreen\n\nblue"]
    assert text.chunk("first words here\n\nsecond words here", 20, 0) == ["first words here", "second words here"]
    assert [len(c) for c in text.chunk("z" * 50, 20, 0)] == [20, 20, 10]
    # An overlap only behind a chunk that is longer than it.
    assert text.chunk("ab\n\ncdefgh", 6, 2) == ["ab", "cdefgh"] and text.chunk("abc\n\ncdefgh", 6, 2) == ["abc", "bc\n\ncdefgh"]
    # Lines are packed before sentences are looked at: a line that fits stays whole.
    assert text.chunk("One. Two.\nThree is long. Four is long too.", 20, 0) == ["One. Two.", "Three is long.", "Four is long too."]
    assert text.chunk("aa\nbb\n" + "c" * 9, 8, 0) == ["aa\n\nbb", "cccccccc", "c"]


def test_resplit():
    assert text.resplit("p" * 30 + "\n\n" + "q" * 40) == ["p" * 30, "q" * 40]
    assert text.resplit("p" * 5 + "\n\n" + "q" * 65) == ["p" * 5 + "\n\n" + "q" * 29, "q" * 36]  # too far in front
    assert text.resplit("a b. " * 10) == [("a b. " * 5).strip(), ("a b. " * 5).strip()]
    assert text.resplit(" ab\n\ncd ", 3) == [" ab\n", "\ncd "] and text.resplit("x") == ["x"]


def test_text_columns(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "s string").select(c(F.col("s"))).first()[0]
    assert one(lambda c: text.hard_split(c, 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(text.detect_chinese, "汉字在此") and not one(text.detect_chinese, "only Latin") and not one(text.detect_chinese, "98765 ?&#")
    assert one(text.sentences, "One. Two! Three") == ["One.", "Two!", "Three"]
    assert one(text.is_cjk, "⺀") and one(text.is_cjk, "㇀") and one(text.is_cjk, "。") and not one(text.is_cjk, "あ") and not one(lambda c: text.is_cjk(c, True), "。")
    assert one(text.gibberish, "") == 1.0 and one(text.gibberish, "bbbbbbbb") >= 0.5 and one(text.gibberish, "a\u200bb") == 0.1
    assert one(text.repeated_ngrams, "aaa") == 0.0 and one(text.repeated_ngrams, "aaaa") == 1.0
    assert one(lambda c: text.string_similarity(c, F.lit("ROSE")), "Rose") == 1.0 and one(lambda c: text.string_similarity(c, F.lit("rose")), " Rose") == 0.85


def test_literals(spark):
    """Numbers with units, codes and dates are values; names and phone numbers are not."""
    numeric = ["12,500元", "0.75mmol/L", "-3.5", "42", "8.25万元", "+7.00 元", "95%", "16GB", "5×10^9/L"]
    codes = ["620000199001012345", "62000019900101234x", "88001122", "20230100ab12", "AB12cd34EF56", "01-22-3333"]
    dates = ["2019年", "2019年3月4日", "2019-03", "2019/3/4", "2019.3", "9:05", "23:59:59", "12 天", "1999"]
    names = ["Ada", "长江大学", "PureLettersOnlyName", "x", "Room 7b extension", "010-1234567", "13900001111"]
    rows = spark.createDataFrame([(x,) for x in [*numeric, *codes, *dates, *names, "  "]], "s string")
    got = {r.s: r for r in rows.select("s", text.numeric_dominant(F.col("s")).alias("n"), text.code_like(F.col("s")).alias("c"), text.date_like(F.col("s")).alias("d"), text.is_literal(F.col("s")).alias("lit")).collect()}
    assert all(got[x].n for x in numeric) and all(got[x].c for x in codes) and all(got[x].d for x in dates)
    assert not [x for x in names if got[x].lit] and all(got[x].lit for x in [*numeric, *codes, *dates, "  "])


def test_words_and_entity_checks(spark):
    cut = lambda s: {"某甲乙丙": ["某", "甲", "乙", "丙"], "清风明月": ["清风", "明月"], "甲乙丙": ["甲乙丙"]}.get(s, [s])
    assert not text.plausible_word("某甲乙丙", cut) and not text.plausible_word("甲乙丙", cut) and text.plausible_word("清风明月", cut)
    assert text.plausible_word("王乙丙", cut) and text.plausible_word("甲乙丙公司", cut) and text.plausible_word("甲乙", cut) and text.plausible_word("Ada", cut)
    rows = [("Ada", 0, 1, 0, 0), ("某甲乙丙", 2, 2, 2, 0), ("77", 0, 1, 0, 1), ("A name of many letters", 1, 0, 0, 0), ("x", 3, 1, 0, 1), ("2051", 1, 1, 0, 0)]
    df = spark.createDataFrame(rows, "name string, degree long, sources long, ocr long, images long")
    got = {r["name"]: (r.flags, r.suspect) for r in entities.check(df, cut).collect()}
    assert got["Ada"] == (["isolated"], False) and got["某甲乙丙"] == (["not_a_word", "ocr_only"], True) and got["x"] == (["too_short", "image_source"], True)
    assert got["77"] == (["isolated", "image_source", "numeric_dominant"], True) and got["A name of many letters"][0][0] == "too_long" and got["2051"] == (["numeric_dominant", "looks_like_date"], True)
    assert entities.check(df).filter("array_contains(flags, 'not_a_word')").count() == 0


def test_errors_and_json(spark):
    rows = [("the context is full", "CONTEXT_LENGTH_EXCEEDED"), ("a token too many", "CONTEXT_LENGTH_EXCEEDED"), ("HTTP 429", "RATE_LIMIT"), ("slow: timed out", "TIMEOUT"), ("boom", "UNKNOWN"), ("connection refused", "UNKNOWN")]
    got = spark.createDataFrame(rows, "m string, c string").select(errors.error_class(F.col("m")).alias("g"), "c").collect()
    assert all(r.g == r.c for r in got)
    typed = [("boom", "ConnectError", None, "MODEL_UNAVAILABLE"), ("rate", "KeyError", None, "INVALID_JSON"), ("rate", "ReadTimeout", 502, "MODEL_UNAVAILABLE"), ("rate", None, 418, "UNKNOWN"), ("rate", None, None, "RATE_LIMIT")]
    got = spark.createDataFrame(typed, "m string, k string, s int, c string").select(errors.error_class(F.col("m"), F.col("k"), F.col("s")).alias("g"), "c").collect()
    assert all(r.g == r.c for r in got)
    assert errors.exception_class(ValueError("rate")) == "INVALID_JSON" and errors.exception_class(RuntimeError("Rate")) == "RATE_LIMIT"
    assert [errors.backoff(i) for i in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    fact = '{"subject": "A", "predicate": "p", "object": "B"}'
    assert errors.tolerant_facts("```json\n{\"facts\": [" + fact + "]}\n```")[0]["confidence"] == 50
    assert len(errors.tolerant_facts("[" + fact + "," + fact + ', {"subj')) == 2 and errors.tolerant_facts("garbage {") == [] and errors.tolerant_facts(None) == []


def test_graph(spark):
    rows = [
        (11, "Ferry", "crosses", "Sound", 40, "active"), (12, "Sound", "parts", "Isle", 71, "active"), (13, "Isle", "has", "Lighthouse", 55, "active"), (14, "Lighthouse", "warns", "Ferry", 90, "active"),
        (15, "Keeper", "lives_in", "Lighthouse", 35, "active"), (16, "Keeper", "writes", "Log", 52, "active"), (17, "Lighthouse", "height", "31m", 66, "active"), (18, "Old Ferry", "crosses", "Sound", 47, "active"),
        (19, "Ferry", "crosses", "Sound", 20, "active"), (20, "Ferry", "sank_in", "Harbour", 80, "deleted"),
    ]
    facts = spark.createDataFrame(rows, "id long, subject string, predicate string, object string, confidence int, status string")
    e = graph.build_edges(facts)
    assert {r["name"] for r in graph.nodes(facts).collect()} == {"Ferry", "Sound", "Isle", "Lighthouse", "Keeper", "Log", "Old Ferry"}
    assert graph.build_properties(facts).first().properties == {"height": ["31m"]}
    assert e.filter("src = 'Ferry'").first().fact_id == 19
    assert graph.nodes(updates.rename_entity(facts, "Old Ferry", "Ferry")).count() == 6
    merged = {(r.src, r.dst, r.fact_id) for r in graph.merge_nodes(e, "Old Ferry", "Ferry").collect()}
    assert merged == {("Ferry", "Sound", 19), ("Sound", "Isle", 12), ("Isle", "Lighthouse", 13), ("Lighthouse", "Ferry", 14), ("Keeper", "Lighthouse", 15), ("Keeper", "Log", 16)}
    assert graph.rewired(e, "Lighthouse").first().n == 3
    seen, own = graph.expand(e, "Log", 2)
    assert {(r["name"], r.depth) for r in seen.collect()} == {("Log", 0), ("Keeper", 1), ("Lighthouse", 2)} and own.count() == 2


def test_vectors_and_dedup(spark):
    rows = [(3, 50, [0.6, 0.8]), (5, 50, [0.62, 0.785]), (6, 20, [-1.0, 0.05]), (8, 65, [-0.98, 0.2]), (9, 65, [0.0, -1.0]), (12, 10, [0.1, -0.99])]
    df = spark.createDataFrame(rows, "fact_id long, confidence int, embedding array<float>")
    assert sorted(r.fact_id for r in vector.near_dedup(df, 0.95).collect()) == [3, 8, 9]
    assert [r.fact_id for r in vector.search(df, [0.0, -1.0], 2).collect()] == [9, 12]
    assert vector.embed(spark.createDataFrame([("oak elm",), ("oak elm",)], "t string"), "t").select("embedding").distinct().count() == 1


def test_dedup_rule_in_rounds(spark, monkeypatch):
    """Random graphs, chains in order and against it, stars and cliques, in tasks of a few links: what the plain loop leaves."""
    rng = random.Random(14)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)}
    pairs |= {(i, i + 1) for i in range(100, 140)} | {(200, i) for i in range(201, 215)} | {(i, 314) for i in range(300, 314)} | {(i, j) for i in range(400, 407) for j in range(i + 1, 407)}
    confidence = {i: rng.randrange(4) for p in pairs for i in p}
    nodes, gone = sorted(confidence), set()
    for a in nodes:
        for b in nodes:
            if a in gone:
                break
            if b > a and b not in gone and (a, b) in pairs:
                gone.add(b if confidence[a] >= confidence[b] else a)
    assert vector.greedy(sorted(pairs), confidence) == gone
    links = spark.createDataFrame([(a, b, confidence[a], confidence[b]) for a, b in pairs], "a long, b long, ca int, cb int")
    monkeypatch.setattr(vector, "PART", 30)
    got = [r.fact_id for r in vector.dropped_facts(links).collect()]
    assert set(got) == gone and len(got) == len(gone)
    assert vector.dropped_facts(links.limit(0)).count() == 0


def test_stored_graph(spark, tmp_path):
    """A stored graph after changes and a merge has the edges, and the surroundings, of one that is built anew."""
    rng = random.Random(8)
    rows = [(i, f"n{rng.randrange(25)}", "p", f"n{rng.randrange(25)}" if i % 9 else "31m", 1, "active" if i % 7 else "deleted") for i in range(120)]
    frame = lambda r: spark.createDataFrame(r, "id long, subject string, predicate string, object string, confidence int, status string")
    g = stored_graph.build(frame(rows[:80]), str(tmp_path / "g"))
    g.change(put=frame(rows[80:]), taken=frame(rows[:20]))
    moved = [(i, s, "q", o, 2, st) for i, s, _, o, _, st in rows[20:40]]
    g.change(put=frame(moved), taken=frame(rows[20:40]))
    now = frame(moved + rows[40:])
    for merged in (False, True):
        e = graph.build_edges(now)
        assert sorted(g.edges().collect()) == sorted(e.select("src", "dst", "predicate", "fact_id", "confidence").collect())
        for start, hops, most in (("n3", 1, 500), ("n3", 2, 9), ("nowhere", 2, 500)):
            want, own = graph.expand(e, start, hops, most)
            seen, edges = g.expand(start, hops, most)
            assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, want.select("name", "depth", "degree").collect()))
            assert sorted(map(str, edges.select("src", "dst", "fact_id").collect())) == sorted(map(str, own.select("src", "dst", "fact_id").collect()))
        g.merge()
    assert stored_graph.StoredGraph(spark, str(tmp_path / "none")).expand("x")[0].count() == 0


def test_similar_pairs_by_tiles(spark, monkeypatch):
    """Tiles of a few rows give the pairs of a plain loop, within a block and without, vectors of other lengths aside."""
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(100, 0, [0.0, 0.0, 0.0]), (101, 0, [1.0]), (102, 1, None)]
    df = spark.createDataFrame(rows, "fact_id long, label int, embedding array<double>")
    unit = lambda v: [x / max(1e-300, sum(y * y for y in v) ** 0.5) for x in v]
    cos = lambda a, b: sum(x * y for x, y in zip(unit(a), unit(b)))
    full = [r for r in rows if r[2] and len(r[2]) == 3]
    monkeypatch.setattr(vector, "TILE", 7)
    for block in (None, "label"):
        want = {(a[0], b[0]) for a in full for b in full if a[0] < b[0] and (not block or a[1] == b[1]) and cos(a[2], b[2]) > 0.6}
        got = vector.similar_pairs(df, 0.6, block).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_merge_candidates(spark):
    rows = [("Rosewood Ltd", [1.0, 0.1]), ("Rosewood", [1.0, 0.0]), ("Zzyxq", [1.0, 0.05]), ("Far away", [0.0, 1.0]), ("123456789", [1.0, 0.0])]
    got = entities.merge_candidates(spark.createDataFrame(rows, "name string, embedding array<double>"), 0.8).collect()
    assert [(r.entity_a, r.entity_b) for r in got] == [("Rosewood", "Rosewood Ltd")]


def test_query_operators(spark):
    assert fulltext.parse_query("a AND b OR c NOT d") == [(["a", "b"], []), (["c"], ["d"])] and fulltext.parse_query("NOT x") == []
    rows = [(1, "red fish"), (2, "red bird"), (3, "blue fish"), (4, "čajový ŝtrudel")]
    df = spark.createDataFrame([(i, t, "", "", "active") for i, t in rows], "id long, subject string, predicate string, object string, status string")
    of = lambda q: sorted(r.id for r in fulltext.search(df, "id", q, None).collect())
    assert of("red fish") == [1] and of("red OR fish") == [1, 2, 3] and of("fish NOT red") == [3] and of("red AND bird OR blue") == [2, 3] and of("cajovy strudel") == [4] and of("()") == []


def test_bm25_against_sqlite(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Éclair", "x_y", "zeta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), rng.choice(words), rng.choice(words)) for i in range(1, 80)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(subject, predicate, object, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, subject, predicate, object) VALUES (?, ?, ?, ?)", rows)
    df = spark.createDataFrame([(*r, "active") for r in rows], "id long, subject string, predicate string, object string, status string")
    for q in ("gamma", "eclair zeta"):
        want = {i: -s for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (q,))}
        got = {r.id: r.score for r in fulltext.search(df, "id", q, None).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_feedback(spark):
    # In the given order; the last row takes the rest.
    cited = spark.createDataFrame([(1, 0.9), (2, 0.6), (3, 0.3)], "fact_id long, similarity_score double")
    d = {r.fact_id: r.delta for r in entities.allocate(cited, 0.3).collect()}
    assert d[1] > d[3] and abs(sum(d.values()) - 0.3) < 1e-9
    assert [r.delta for r in entities.allocate(cited.limit(2), 0.2, "uniform").collect()] == [0.1, 0.1]
    votes = spark.createDataFrame([(1, 1, 5.0), (1, 2, -0.5), (2, 1, -9.0)], "fact_id long, seq long, delta double")
    assert {r.fact_id: r.user_score for r in entities.fold_votes(votes).collect()} == {1: 1.5, 2: 0.0}
    facts = spark.createDataFrame([(1, 1.5, "active")], "id long, user_score double, status string")
    assert updates.decay(facts, 0.5).first().user_score == 1.25


def test_merges_one_after_another(spark):
    """Renames in order against a loop over the names; triaged pairs, the most similar first."""
    rng = random.Random(17)
    for _ in range(200):
        merges = [tuple(rng.choices("abcdef", k=2)) for _ in range(rng.randrange(9))]
        want = {}
        for name in "abcdefg":
            now = name
            for old, new in merges:
                now = new if now == old else now
            if now != name:
                want[name] = now
        assert entities.in_order(merges) == want, merges
    pairs = [("ab", "abd", 0.9, "abd"), ("ab", "abc", 0.99, "abc"), ("a", "bb", 0.9, "bb"), ("bb", "ccc", 0.99, "ccc"), ("x", "xy", 0.5, "xy")]
    triaged = spark.createDataFrame([(*p, "auto_approved" if p[2] > 0.8 else "proposed") for p in pairs], "entity_a string, entity_b string, similarity double, canonical string, status string")
    facts = spark.createDataFrame([(i, s, o) for i, (s, o) in enumerate([("ab", "a"), ("bb", "x"), ("abd", "ccc")])], "id long, subject string, object string")
    assert sorted((r.subject, r.object) for r in entities.apply_merges(facts, triaged).collect()) == [("abc", "bb"), ("abd", "ccc"), ("ccc", "x")]


def test_merge_candidates_in_order(spark, monkeypatch):
    """Block by block, capped or not, tiles behind the blocks: the pairs of a plain loop over the sorted names."""
    rng = random.Random(23)
    names = sorted({"".join(rng.choices("abcdxyz", k=rng.randint(3, 7))) for _ in range(90)}, key=str.encode)
    rows = [(n, [rng.gauss(0, 1) for _ in range(2 + i % 2)]) for i, n in enumerate(names)]
    df = spark.createDataFrame([*rows, ("nothing", None), ("12345678", [1.0, 0.0])], "name string, embedding array<double>")
    plain = {r["name"] for r in df.filter(~text.numeric_dominant(F.col("name")) & ~text.code_like(F.col("name")) & (text.gibberish(F.col("name")) < 0.5) & F.col("embedding").isNotNull()).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    overlap = lambda a, b: 0.85 if a in b or b in a else len(set(a) & set(b)) / max(len(set(a)), len(set(b)))
    want = [(a, b) for i, (a, v) in enumerate(rows) for b, w in rows[i + 1 :] if {a, b} <= plain and len(v) == len(w) and cos(v, w) >= 0.9 and overlap(a, b) >= 0.4]
    monkeypatch.setattr(entities, "HEADS", 3)
    monkeypatch.setattr(entities, "BLOCKS", 2)
    assert len(want) > 60
    for most in (2, 50, None):
        got = entities.merge_candidates(df, 0.9, most=most).collect()
        assert sorted((r.entity_a, r.entity_b) for r in got) == want[:most]
        assert [r.similarity for r in got] == sorted((r.similarity for r in got), reverse=True)


def test_votes_compose(spark):
    """Votes in many partitions and batches, one fact with most of them, against the plain fold; with scores to start from."""
    rng = random.Random(19)
    votes = [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.choice([-0.7, -0.3, 0.2, 0.9, 3.0])) for i in range(3000)]
    rng.shuffle(votes)
    start = {1: 0.4, 2: 1.9}
    want = {}
    for f, _, d in sorted(votes, key=lambda v: v[1]):
        want[f] = min(2.0, max(0.0, want.get(f, start.get(f, 1.0)) + d))
    df = spark.createDataFrame(votes, "fact_id long, seq long, delta double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.fact_id: r.user_score for r in entities.fold_votes(df, spark.createDataFrame(list(start.items()), "fact_id long, user_score double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
    assert entities.fold_votes(df.limit(0)).count() == 0


def test_stream_of_votes_in_batches(spark, tmp_path):
    """Scores go on from batch to batch; a late vote is folded when it comes, and counted."""
    schema = "fact_id long, seq long, delta double"
    for name, rows in (("a", [(1, 1, 5.0), (1, 4, -0.5), (2, 2, 0.25)]), ("b", [(1, 3, -1.0), (1, 5, 0.1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = feeds.score_votes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(str(tmp_path / "out"))).outputMode("update")
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (row.fact_id, round(row.user_score, 9), row.late) == (1, 0.6, 1)


def test_index_run_and_retry(spark):
    listing = spark.createDataFrame([("/a.md", "h1", "Alice is a boss.\n\nBob is tall."), ("/b.md", "h2", "same")], "path string, sha256 string, text string")
    known = spark.createDataFrame([("/b.md", "h2", "done"), ("/c.md", "h3", "done")], "path string, sha256 string, status string")
    out = lifecycle.index_run(listing, known)
    assert {(r.path, r.change) for r in out["changes"].collect()} == {("/a.md", "added"), ("/b.md", "unchanged"), ("/c.md", "deleted")}
    assert {(r.subject, r.object) for r in out["facts"].collect()} == {("Alice", "a boss"), ("Bob", "tall")}

    def broken(chunk, r):
        if r == 0:
            raise RuntimeError("request timed out")
        return lifecycle.rule_extractor(chunk, r)

    out = lifecycle.index_run(listing, known, broken)
    assert out["facts"].count() == 2 and {r.error_class for r in out["failed_chunks"].collect()} == {"TIMEOUT"}
    plan = lifecycle.retry_plan(spark.createDataFrame([("/p", "pending", 0), ("/f", "failed", 2), ("/x", "failed", 3), ("/d", "done", 0)], "path string, status string, retry_count int"))
    assert {r.path: r.plan for r in plan.collect()} == {"/p": "retry", "/f": "retry", "/x": "dead"}


def test_sources(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    (tmp_path / "a.py").write_text('"""Doc."""\nimport os\ndef f(x):\n    return x + 1\n')
    (tmp_path / "b.csv").write_text("n,m\n1,2\n")
    (tmp_path / "c.json").write_text('{"k": [1]}')
    (tmp_path / "d.xyz").write_text("?")
    (tmp_path / "skip" / "e.md").write_text("no")
    (tmp_path / "g.html").write_text("<p>Hi <b>you</b></p><script>x</script>")
    got = {r.path.rsplit("/", 1)[1]: (r.route, r.text) for r in source_files.parse(source_files.scan(spark, str(tmp_path), exclude=("skip",))).collect()}
    assert set(got) == {"a.py", "b.csv", "c.json", "d.xyz", "g.html"}
    assert got["a.py"][1] == '""" Doc. """\nimport os\ndef f(x): ...'
    assert got["b.csv"][1] == "CSV file: b.csv\nColumns (2): n, m\nRows: 1\n\nSample (first 10 rows):\n  1 | 2" and got["d.xyz"] == ("unsupported", None) and got["g.html"][1] == "Hi you"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    seen = []
    q = feeds.ingest(feeds.file_stream(spark, str(tmp_path / "in")), lambda: spark.createDataFrame([], "path string, sha256 string"), lambda d: seen.extend(r.path for r in d.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 1
    spark.createDataFrame([(1, 1, 5.0), (1, 2, -0.5)], "fact_id long, seq long, delta double").write.parquet(str(tmp_path / "v"))
    s = feeds.score_votes(spark.readStream.schema("fact_id long, seq long, delta double").parquet(str(tmp_path / "v")))
    q = s.writeStream.format("memory").queryName("scores").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scores").first().user_score == 1.5


def test_ask(spark):
    facts = spark.createDataFrame([(1, 1, "Alice", "works_at", "Acme", 90, 1.0, "active"), (2, 1, "Bob", "likes", "tea", 90, 1.0, "active")], "id long, file_id long, subject string, predicate string, object string, confidence int, user_score double, status string")
    facts = facts.withColumns({c: F.lit(None).cast("string") for c in ("title", "description", "evidence_span")})
    files = spark.createDataFrame([(1, "/a.md")], "id long, path string")
    embed = vector.hash_embedder()
    vecs = vector.embed(facts.select(F.col("id").alias("fact_id"), F.concat_ws(" ", "subject", "object").alias("t")), "t")
    out = retrieve.ask("Alice", facts, files, vecs, embed)
    asked = []
    near = retrieve.ask("Alice", facts, files, vecs, embed, lambda q, c: asked.append(q) or "yes", edges=graph.build_edges(facts.withColumn("confidence", F.lit(1))), history=[{"role": "user", "content": "Hello"}])
    assert near["answer"] == "yes" and asked == ["user: Hello\nAlice"] and near["related"][0]["score"] > out["related"][0]["score"]
    assert "[Fact 1] Alice works_at Acme\n  Source: /a.md\n  Evidence: \n" in out["answer"]
    assert out["related"][0]["subject"] == "Alice" and out["sources"][0]["path"] == "/a.md"
    assert retrieve.ask(" ", facts, files, vecs, embed)["count"] == 0
    assert relational.counts(facts, facts, facts.withColumn("status", F.lit("done"))).first().files == 2


def test_extraction_and_backfill_take_whole_tables(spark, sf):
    from factloom import queries
    from factloom.plans.adapters import KnowledgeBase

    k = KnowledgeBase(spark, sf)
    have = {r.fact_id for r in k.embeddings.select("fact_id").collect()}
    want = {r.id for r in k.facts.select("id").collect()} - have
    assert {r.id for r in queries.QUERIES["vec_08_backfill"](spark, sf).collect()} == want
    later = {r.id for r in k.chunks.filter("chunk_index > 0").select("id").collect()}
    assert later & {r.chunk_id for r in queries.QUERIES["ex_01_extract"](spark, sf).select("chunk_id").collect()}
