"""Full-text search: postings and BM25 as relational plans."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.runtime import materialize

FIELDS = ("subject", "predicate", "object", "title", "description")
K1, B = 1.2, 0.75


def sanitise(query: str) -> str:
    """FTS-01."""
    for c in "*\"'()?？：:":
        query = query.replace(c, " ")
    return " ".join(query.split())


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and the letters they are built on, by Unicode's decompositions."""
    pairs = []
    for x in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        d = unicodedata.normalize("NFD", x)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and x == x.lower() and all(map(unicodedata.combining, d[1:])):
            pairs.append((x, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def fold(c: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def tokens(c: Column) -> Column:
    """FTS-02: runs of letters and digits, folded."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def _is(word: str):
    return lambda x: x == word


def postings(docs: DataFrame, key: str, fields=FIELDS) -> DataFrame:
    """(key, term, tf, dl) over the fields together."""
    fields = [f for f in fields if f in docs.columns]
    t = docs.select(key, tokens(F.concat_ws(" ", *fields)).alias("t"))
    return t.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def parse_query(query: str) -> list[tuple[list[str], list[str]]]:
    """FTS-03: a sanitised query as alternatives of (words that must stand there, words that must not). OR parts the
    alternatives; a word behind NOT must not occur; AND and a blank mean the same."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    no = False
    for w in query.split():
        if w == "OR":
            out.append(([], []))
        elif w == "NOT":
            no = True
            continue
        elif w != "AND":
            out[-1][no].append(w)
        no = False
    return [a for a in out if a[0]]


def search(docs: DataFrame, key: str, query: str, limit: int | None = 10, fields=FIELDS, status: str | None = "status") -> DataFrame:
    """FTS-03..05, TOPK-02: documents that the query holds for, by BM25; statistics over all rows, those of another status
    included, which drop afterwards. Only the query's terms are counted, in one pass for the statistics and the hits. Fields that `docs` has not are left out."""
    spark, fields = docs.sparkSession, [f for f in fields if f in docs.columns]
    parsed = parse_query(sanitise(query))
    words = list(dict.fromkeys(w for a in parsed for part in a for w in part))
    cut = spark.range(1).select(*[tokens(F.lit(w)).alias(f"w{i}") for i, w in enumerate(words)]).first() if words else []
    of = dict(zip(words, map(list, cut)))
    terms = list(dict.fromkeys(t for ws in of.values() for t in ws))
    nothing = docs.filter("false").select(key, F.lit(0.0).alias("score"))
    if not terms:
        return nothing
    t = docs.select(key, *([status] if status else []), tokens(F.concat_ws(" ", *fields)).alias("t")).withColumn("dl", F.size("t"))
    own = [F.size(F.filter("t", _is(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    has = {t: F.col(f"tf{i}") > 0 for i, t in enumerate(terms)}
    all_of = lambda ws: reduce(Column.__and__, [has[t] for w in ws for t in of[w]], F.lit(True))
    holds = reduce(Column.__or__, [reduce(Column.__and__, [~all_of([w]) for w in no if of[w]], all_of(yes)) for yes, no in parsed], F.lit(False))
    # Statistics are observed while the hits are written, so that documents are cut once.
    seen = Observation()
    dfs = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]
    scored = t.select(key, *([status] if status else []), "dl", *own).observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *dfs)
    hits = materialize(scored.filter(holds & (F.col(status) == "active") if status else holds), "hits")
    stats = seen.get
    if not stats["n"]:
        return nothing
    out = F.lit(0.0)
    for i in range(len(terms)):
        idf = max(1e-6, math.log((stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col(f"tf{i}").cast("double")
        out = out + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / stats["avg"]))
    hits = hits.select(key, out.alias("score")).orderBy(F.desc("score"), key)
    return hits.limit(limit) if limit else hits
