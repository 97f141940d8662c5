import random

from pyspark.sql import functions as F

from factloom.llm import line_dedup as L


def shingle_set(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def test_sketches_rule_out_long_unlike_lines_and_no_alike_ones(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(n))
    base, again = word(1500), "ab" * 40 + word(900)
    lines = [base, base[:1000] + word(500), base[:1450] + word(50), again, again + again, "short", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "key long, s string")
    sketches = L.odd_sketches(df, L.shingles)
    sets = [shingle_set(x) for x in lines]
    assert {r.key: r.n for r in sketches.collect()} == {i: len(x) for i, x in enumerate(sets)}
    both = L._named(sketches, "f").join(L._named(sketches, "x"), F.col("f_key") < F.col("x_key"))
    got = {(r.f_key, r.x_key): (r.d, r.near) for r in both.select("f_key", "x_key", L._apart().alias("d"), L._near(0.8).alias("near")).collect()}
    assert all(d <= len(sets[a] ^ sets[b]) for (a, b), (d, _) in got.items())
    assert not got[0, 1][1]  # half alike, of 1,500 shingles: more than words enough for 512 bits
    assert got[0, 2][1] and got[3, 4][1]


def test_verified_counts_repeated_shingles_once(spark):
    a, b, c = "ab" * 300 + "the end of the line", "ab" * 50 + "the end of the line", "ab" * 300
    df = spark.createDataFrame([(i, x, len(shingle_set(x))) for i, x in enumerate((a, b, c))], "key long, s string, n int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert [(r.a, r.b) for r in L._verified(pairs, df, L.shingles, 0.8).collect()] == [(0, 1)]


def test_bitmap_keeps_every_needed_row(spark):
    rows = spark.range(0, 300000).select((F.col("id") * 7919 - 10**9).alias("key"))
    need = rows.filter("key % 100 = 0")
    got = L.through_bitmap(rows, "key", need)
    assert need.join(got, "key", "left_anti").count() == 0 and got.count() < 1.05 * need.count() + 0.01 * 300000
