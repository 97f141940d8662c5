"""A stored full-text index: bucketed posting tables that searches read a little of, kept up to date by signed segments.

A change adds a segment and rewrites nothing: postings of the rows it puts in, the ids of those it takes out, and term
counts with their sign. `merge` makes one segment of all. Each segment's term counts and postings are parquet, in folders by a
term's bucket and sorted by term within, so that a search reads the buckets of its own terms and of these the row
groups that may hold them.

A posting row is a term's occurrences in one cell, or a piece of them where there are many: documents of about one length and
of one range of ids. It carries the greatest term frequency and the least length, which bound what the term may add to a score there. A search adds these
bounds up a cell without reading any occurrence, scores the cells of the highest bounds first, and then only those
cells whose bound reaches the k-th score that was found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.runtime import materialize
from ..plans.segments import Segments, bucket
from .fulltext import FIELDS, K1, B, parse_query, sanitise, tokens

#: Folders of a segment; ids of a cell; cells that are scored before any other.
BUCKETS, SPAN, FIRST = 32, 65536, 8
#: Lengths of a cell differ by less than this factor.
LENGTHS = 1.25
#: Occurrences of a row. Rows are written and read some thousands at a time, so this bounds what a task holds of a frequent term.
PIECE = 512
_POSTINGS = "term string, cell string, n long, max_tf long, min_dl long, ids array<long>, tfs array<long>, dls array<long>, live array<boolean>, bucket int"
_TERMS = "term string, df long, bucket int"


def _bucket(term: Column) -> Column:
    return bucket(term, BUCKETS)


def told(docs: DataFrame, key: str = "id", fields=FIELDS, status: str | None = "status") -> DataFrame:
    """(id, live, t): documents' words; live: whether their status is active. Documents are dealt to all tasks by id before they
    are cut, and written, so that all that counts words reads them."""
    own = [f for f in fields if f in docs.columns]
    live = (F.coalesce(F.col(status) == "active", F.lit(False)) if status else F.lit(True)).alias("live")
    dealt = docs.select(F.col(key).cast("long").alias("id"), live, F.concat_ws(" ", *own).alias("text")).repartition("id")
    return materialize(dealt.select("id", "live", tokens(F.col("text")).alias("t")), "words")


def cut(words: DataFrame) -> DataFrame:
    """told -> (id, term, tf, dl, live): the postings of documents. What is dealt by id is counted where it is."""
    each = words.repartition("id").select("id", "live", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("id", "live", "dl", "term").agg(F.count("*").alias("tf"))


def rows_of(postings: DataFrame) -> DataFrame:
    """cut -> the rows of a segment's posting table."""
    level = F.floor(F.log(LENGTHS, F.col("dl"))).cast("string")
    cell = F.concat_ws(":", level, F.floor(F.col("id") / SPAN).cast("string")).alias("cell")
    each = postings.select("term", cell, F.struct("id", "tf", "dl", "live").alias("p")).groupBy("term", "cell").agg(F.sort_array(F.collect_list("p")).alias("p"))  # a cell's ids are bounded
    pieces = F.transform(F.sequence(F.lit(1), F.size("p"), F.lit(PIECE)), lambda i: F.slice("p", i, PIECE))
    each = each.select("term", "cell", F.explode(F.when(F.size("p") > PIECE, pieces).otherwise(F.array("p"))).alias("p"))
    arrays = [F.col(f"p.{c}").alias(name) for c, name in (("id", "ids"), ("tf", "tfs"), ("dl", "dls"), ("live", "live"))]
    return each.select("term", "cell", F.size("p").cast("long").alias("n"), F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"), *arrays, _bucket(F.col("term")).alias("bucket"))


@dataclass
class Index:
    """A stored index in a folder; see `plans.segments` for how changes become visible."""

    spark: SparkSession
    path: str
    fields: tuple = FIELDS
    key: str = "id"
    status: str | None = "status"
    #: Of the last search: postings of its terms, and those that were read.
    read: dict = field(default_factory=dict)

    def __post_init__(self):
        self.files = Segments(self.spark, self.path)

    @property
    def segments(self) -> list[dict]:
        """Of each segment: path, n and dl (rows and words it adds, less those it takes away), put, dead."""
        return self.files.segments()

    # -- changes

    def change(self, put: DataFrame | None = None, taken: DataFrame | None = None) -> None:
        """Puts rows in and takes rows out, which are given as they were when they were put in; an update is both."""
        at = self.files.new()
        counts, n, dl = [], 0, 0
        for rows, sign in ((put, 1), (taken, -1)):
            if rows is None:
                continue
            words = told(rows, self.key, self.fields, self.status)
            own = materialize(cut(words), "postings")
            counts.append(own.groupBy("term").agg((sign * F.count("*")).alias("df")))
            size = F.size("t").cast("long")
            all_of = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("dl")).first()
            n, dl = n + sign * all_of["n"], dl + sign * all_of["dl"]
            if sign > 0:
                self.files.write(rows_of(own), f"{at}/postings", "term", "cell")
            else:
                rows.select(F.col(self.key).cast("long").alias("id")).write.parquet(f"{at}/dead")
        terms = reduce(DataFrame.union, counts).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        self.files.write(terms.select("term", "df", _bucket(F.col("term")).alias("bucket")), f"{at}/terms", "term")
        self.files.commit([*self.segments, {"path": at, "n": n, "dl": dl, "put": put is not None, "dead": taken is not None}])

    def merge(self) -> None:
        """One segment of all; what was taken out is no longer stored."""
        at, old = self.files.new(), self.segments
        live = self._postings(old).select("term", F.explode(F.arrays_zip("ids", "tfs", "dls", "live")).alias("p"), "seg")
        live = live.select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), F.col("p.live").alias("live"), "seg")
        self.files.write(rows_of(self._without_dead(live, old)), f"{at}/postings", "term", "cell")
        self.files.write(self._terms(old).groupBy("term", "bucket").agg(F.sum("df").alias("df")).filter("df <> 0").select("term", "df", "bucket"), f"{at}/terms", "term")
        self.files.commit([{"path": at, "n": sum(s["n"] for s in old), "dl": sum(s["dl"] for s in old), "put": True, "dead": False}])

    # -- reads

    def _read(self, old: list[dict], name: str, schema: str) -> DataFrame | None:
        parts = [self.spark.read.schema(schema).parquet(f"{s['path']}/{name}").withColumn("seg", F.lit(i)) for i, s in enumerate(old) if name == "terms" or s["put"]]
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], f"{schema}, seg int")

    def _postings(self, old: list[dict]) -> DataFrame:
        return self._read(old, "postings", _POSTINGS)

    def _terms(self, old: list[dict]) -> DataFrame:
        return self._read(old, "terms", _TERMS)

    def _without_dead(self, rows: DataFrame, old: list[dict]) -> DataFrame:
        """rows(id, seg, ...) without those that a later segment takes out; a change takes out before it puts in."""
        gone = [self.spark.read.schema("id long").parquet(f"{s['path']}/dead").withColumn("until", F.lit(i)) for i, s in enumerate(old) if s["dead"]]
        if not gone:
            return rows.drop("seg")
        last = reduce(DataFrame.union, gone).groupBy("id").agg(F.max("until").alias("until"))
        return rows.join(last, "id", "left").filter(F.col("until").isNull() | (F.col("seg") >= F.col("until"))).drop("seg", "until")

    def totals(self) -> DataFrame:
        """(term, df): in how many documents a term is."""
        return self._terms(self.segments).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def search(self, query: str, limit: int | None = 10, measure: bool = False) -> DataFrame:
        """(id, score) of the documents that the query holds for, best first: what `fulltext.search` gives for all rows.

        Reads the buckets of the query's terms. With a limit, cells whose bound does not reach the limit-th score of those
        with the highest bounds are not read. `measure` counts postings into `read`.
        """
        spark, old = self.spark, self.segments
        nothing = spark.createDataFrame([], f"{self.key} long, score double")
        parsed = parse_query(sanitise(query))
        words = list(dict.fromkeys(w for a in parsed for part in a for w in part))
        n, dl = sum(s["n"] for s in old), sum(s["dl"] for s in old)
        if not words or not n:
            return nothing
        cuts = [tokens(F.lit(w)) for w in words]
        row = spark.range(1).select(*[F.transform(c, lambda t: F.struct(t.alias("t"), _bucket(t).alias("b"))).alias(f"w{i}") for i, c in enumerate(cuts)]).first()
        of = {w: [x["t"] for x in row[i]] for i, w in enumerate(words)}
        at = {x["t"]: x["b"] for r in row for x in r}
        terms = list(at)
        if not terms:
            return nothing
        own = F.col("bucket").isin(sorted(set(at.values()))) & F.col("term").isin(terms)
        df = {r["term"]: r["df"] for r in self._terms(old).filter(own).groupBy("term").agg(F.sum("df").alias("df")).collect()}
        idf = [max(1e-6, math.log((n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))) for t in terms]
        average = dl / n
        # A term that a NOT names may add to a score, as it does where all rows are looked at.
        part = lambda i, tf, length: idf[i] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

        def holds(has: dict[str, Column], with_not: bool) -> Column:
            all_of = lambda ws: reduce(Column.__and__, [has[t] for w in ws for t in of[w]], F.lit(True))
            return reduce(Column.__or__, [reduce(Column.__and__, [~all_of([w]) for w in no if of[w] and with_not], all_of(yes)) for yes, no in parsed], F.lit(False))

        found = self._postings(old).filter(own)
        if limit is None:
            return self._scored(found, old, terms, part, holds)
        at_most = [F.max(F.when(F.col("term") == t, part(i, F.col("max_tf").cast("double"), F.col("min_dl")))).alias(f"b{i}") for i, t in enumerate(terms)]
        cells = found.groupBy("cell").agg(F.sum("n").alias("n"), *at_most)
        bound = reduce(Column.__add__, [F.coalesce(f"b{i}", F.lit(0.0)) for i in range(len(terms))])
        cells = cells.filter(holds({t: F.col(f"b{i}").isNotNull() for i, t in enumerate(terms)}, False)).select("cell", "n", bound.alias("bound"))
        first = cells.orderBy(F.desc("bound"), "cell").limit(FIRST + 1).collect()
        names = [r["cell"] for r in first[:FIRST]]
        top = self._scored(found.filter(F.col("cell").isin(names)), old, terms, part, holds).limit(limit)
        if len(first) <= FIRST:
            if measure:
                self._measure(cells, found, names)
            return top
        best = top.collect()
        least = best[-1]["score"] - 1e-9 if len(best) == limit else float("-inf")
        more = cells.filter((F.col("bound") >= least) & ~F.col("cell").isin(names))
        if measure:
            self._measure(cells, found, names + [r["cell"] for r in more.select("cell").collect()])
        if first[FIRST]["bound"] < least:
            return spark.createDataFrame(best, f"{self.key} long, score double")
        rest = found.join(more.select("cell"), "cell", "left_semi")
        both = spark.createDataFrame(best, f"{self.key} long, score double").union(self._scored(rest, old, terms, part, holds))
        return both.orderBy(F.desc("score"), self.key).limit(limit)

    def _measure(self, cells: DataFrame, found: DataFrame, names: list[str]) -> None:
        told = found.agg(F.sum("n"), F.sum(F.when(F.col("cell").isin(names), F.col("n")))).first()
        self.read = {"postings": told[0] or 0, "read": told[1] or 0}

    def _scored(self, rows: DataFrame, old: list[dict], terms: list[str], part, holds) -> DataFrame:
        """(id, score) of the documents in posting rows that the query holds for, best first."""
        each = rows.select("term", "seg", F.explode(F.arrays_zip("ids", "tfs", "dls", "live")).alias("p"))
        each = self._without_dead(each.select("term", "seg", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), F.col("p.live").alias("live")), old)
        tfs = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
        docs = each.groupBy("id").agg(F.max("dl").alias("dl"), F.max("live").alias("live"), *tfs)
        score = F.lit(0.0)
        for i in range(len(terms)):
            score = score + part(i, F.coalesce(f"tf{i}", F.lit(0)).cast("double"), F.col("dl"))
        hits = docs.filter(holds({t: F.col(f"tf{i}").isNotNull() for i, t in enumerate(terms)}, True) & F.col("live"))
        return hits.select(F.col("id").alias(self.key), score.alias("score")).orderBy(F.desc("score"), self.key)


def build(docs: DataFrame, path: str, key: str = "id", fields=FIELDS, status: str | None = "status") -> Index:
    """A new index of the documents in the folder `path`."""
    index = Index(docs.sparkSession, path, tuple(fields), key, status)
    index.change(put=docs)
    return index
