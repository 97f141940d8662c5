"""Filters, joins, aggregates, top-k and set operations over the knowledge base's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors, text


def by_value(df: DataFrame, column: str, value) -> DataFrame:
    """FLT-01..04, FLT-09, FLT-13: rows of one value."""
    return df.filter(F.col(column) == value)


def facts_of_entity(facts: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """FLT-05."""
    return facts.filter("status = 'active'").filter((F.col("subject") == entity) | (F.col("object") == entity)).orderBy("id").limit(limit)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """FLT-06, TOPK-04, TOPK-05: a total order, then a page."""
    return df.orderBy(*order).offset(offset).limit(limit)


def pick(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """FLT-08: rows whose key is in a list of ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def due(failed: DataFrame, now, limit: int = 10) -> DataFrame:
    """FLT-10: pending entries without a retry time or past it, oldest first."""
    ready = failed.filter("status = 'pending'").filter(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return ready.orderBy("created_at", "id").limit(limit)


def proposals_by(proposals: DataFrame, status: str | None = "proposed", kind: str | None = None) -> DataFrame:
    """FLT-11, TOPK-11: proposals of a status, the open ones if none is named, the surest first."""
    out = proposals.filter(F.col("status") == status)
    return (out.filter(F.col("proposal_type") == kind) if kind else out).orderBy(F.desc("confidence"), "id")


def all_proposals(proposals: DataFrame, kind: str | None = None) -> DataFrame:
    """FLT-12: proposals of any status, the newest first."""
    out = proposals.filter(F.col("proposal_type") == kind) if kind else proposals
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def transcript(chat: DataFrame, kb: str, session: str) -> DataFrame:
    """FLT-13: a session's messages in order."""
    return chat.filter((F.col("kb_name") == kb) & (F.col("session_id") == session)).orderBy("created_at", "id")


def directories(table: DataFrame) -> DataFrame:
    """FLT-03: the watched directories by path."""
    return table.orderBy("path")


def file_filter(files: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """FLT-16: status equality and path substring; % and _ stay wildcards."""
    out = files.filter("status <> 'deleted'")
    if status:
        out = out.filter(F.col("status") == status)
    return out.filter(F.col("path").ilike(f"%{search}%")) if search else out


def vanished(files: DataFrame, listing: DataFrame) -> DataFrame:
    """FLT-18: files that the listing no longer has."""
    return files.filter("status <> 'deleted'").join(listing.select("path").distinct(), "path", "left_anti")


def list_files(files: DataFrame, chunks: DataFrame, facts: DataFrame, status=None, search=None, limit: int | None = 50, offset: int = 0, zero_facts: bool = False) -> DataFrame:
    """JOIN-01, AGG-02, AGG-03, TOPK-04: files with their chunk and active fact counts; each side is summed before the join.
    Without a limit all of them, in no order."""
    c = chunks.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    a = facts.filter("status = 'active'").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("fact_count"))
    out = file_filter(files, status, search).join(c, "id", "left").join(a, "id", "left").fillna(0, ["chunk_count", "fact_count"])
    if zero_facts:
        out = out.filter("fact_count = 0")
    return out if limit is None else page(out, [F.desc_nulls_last("indexed_at"), F.desc("created_at"), "id"], limit, offset)


def count_files(files: DataFrame, facts: DataFrame, zero_facts: bool = False) -> DataFrame:
    """JOIN-02."""
    live = file_filter(files)
    if zero_facts:
        live = live.join(facts.filter("status = 'active'").select(F.col("file_id").alias("id")), "id", "left_anti")
    return live.agg(F.count("*").alias("n"))


def hydrate(ranked: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-03, JOIN-04: ranked ids (fact_id, score) with their facts and file paths; inactive facts drop."""
    f = facts.filter("status = 'active'").withColumnRenamed("id", "fact_id")
    paths = files.select(F.col("id").alias("file_id"), "path")
    return ranked.join(f, "fact_id").join(paths, "file_id", "left")


def entity_sources(facts: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN-05, AGG-10: the sorted distinct files of each entity."""
    named = facts.filter("status = 'active'").select("file_id", F.explode(F.array("subject", "object")).alias("entity")).distinct()
    joined = named.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joined.groupBy("entity").agg(F.sort_array(F.collect_set("path")).alias("sources"))


def with_path(failed: DataFrame, files: DataFrame, status=None, limit: int = 100) -> DataFrame:
    """JOIN-06, TOPK-10: failed chunks with their files' paths, newest first."""
    rows = failed.filter(F.col("status") == status) if status else failed
    return rows.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def entity_counts(facts: DataFrame) -> DataFrame:
    """AGG-04, SET-01: occurrences over both columns of active facts."""
    return facts.filter("status = 'active'").select(F.explode(F.array("subject", "object")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def valid_entities(facts: DataFrame) -> DataFrame:
    """SET-03: subjects, and objects that are no literals."""
    live = facts.filter("status = 'active'")
    objects = live.select(F.col("object").alias("name")).distinct().filter(~text.is_literal(F.col("name")))
    return live.select(F.col("subject").alias("name")).union(objects).distinct()


def counted_entities(facts: DataFrame) -> DataFrame:
    """SET-03 with AGG-04 in one scan and one exchange: names and their occurrences; a name that is a literal stays only
    if it is a subject somewhere."""
    ends = F.array(F.struct(F.col("subject").alias("name"), F.lit(True).alias("subject")), F.struct(F.col("object").alias("name"), F.lit(False).alias("subject")))
    each = facts.filter("status = 'active'").select(F.explode(ends).alias("e")).select("e.*")
    own = each.groupBy("name").agg(F.count("*").alias("n"), F.max("subject").alias("subject"))
    return own.filter(F.col("subject") | ~text.is_literal(F.col("name"))).select("name", "n")


def proposal_names(proposals: DataFrame, kind: str) -> DataFrame:
    """JOIN-07, JOIN-08: names in open proposals of a kind; for merges either side, as two equi-joins' keys."""
    p = proposals.filter("status = 'proposed'").filter(F.col("proposal_type") == kind)
    ends = F.array("entity_a", "entity_b") if kind == "merge" else F.array("entity_a")
    return p.select(F.explode(ends).alias("name")).distinct()


def list_entities(facts, proposals, search=None, sort_by: str = "count", descending: bool = True, page_no: int = 1, page_size: int = 50, suspect_only=False, merge_only=False) -> DataFrame:
    """QA-05, JOIN-13, TOPK-05: entities with counts and proposal badges, filtered, ordered and paged."""
    names = counted_entities(facts)
    if search:
        names = names.filter(F.lower("name").contains(search.lower()))
    suspects, merges = proposal_names(proposals, "suspect"), proposal_names(proposals, "merge")
    if suspect_only:
        names = names.join(suspects, "name", "left_semi")
    if merge_only:
        names = names.join(merges, "name", "left_semi")
    badge = lambda d, c: d.withColumn(c, F.lit(True))
    out = names.join(badge(suspects, "has_suspect"), "name", "left").join(badge(merges, "has_merge"), "name", "left").fillna(False, ["has_suspect", "has_merge"])
    first = F.col("name") if sort_by == "name" else F.col("n")
    return page(out, [first.desc() if descending else first.asc(), "name"], page_size, (page_no - 1) * page_size)


def snapshot_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """JOIN-09, SET-02, IX-04: (path, sha256) twice -> (path, change)."""
    c, p = current.select("path", F.col("sha256").alias("now")), previous.select("path", F.col("sha256").alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "modified").otherwise("unchanged")
    return c.join(p, "path", "full_outer").select("path", change.alias("change"))


def under_directories(files: DataFrame, directories: list[str]) -> DataFrame:
    """JOIN-14: files under any configured directory, compared with a trailing separator."""
    hit = F.lit(False)
    for d in directories:
        hit = hit | F.startswith(F.col("path"), F.lit(d.rstrip("/") + "/"))
    return files.filter(hit)


def not_proposed(names: DataFrame, proposals: DataFrame, kind: str = "suspect") -> DataFrame:
    """JOIN-10: names without a proposal of the kind, of any status."""
    seen = proposals.filter(F.col("proposal_type") == kind).select(F.col("entity_a").alias("name"))
    return names.join(seen, "name", "left_anti")


def verdicts(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """JOIN-15: judged pairs matched by their ordinal; unanswered pairs are not the same."""
    return pairs.join(answers, "ordinal", "left").withColumn("same", F.coalesce("same", F.lit(False)))


def counts(files: DataFrame, facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-01, AGG-16: one row of totals."""
    n = lambda d, a: d.agg(F.count("*").alias(a))
    return n(files, "files").crossJoin(n(facts.filter("status = 'active'"), "facts")).crossJoin(n(chunks.filter("status = 'done'"), "chunks_done"))


def status(files: DataFrame, facts: DataFrame, chunks: DataFrame, edges: DataFrame, vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """AGG-16: the totals with those of the graph and the vectors, and the last run's status."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    rest = (ends.agg(F.count_distinct("name").alias("nodes")), edges.agg(F.count("*").alias("edges")), vectors.agg(F.count("*").alias("vectors")), runs.agg(F.max_by("status", "id").alias("last_run")))
    return reduce(DataFrame.crossJoin, rest, counts(files, facts, chunks))  # one row each


def chat_sessions(chat: DataFrame, kb: str) -> DataFrame:
    """AGG-05."""
    s = chat.filter(F.col("kb_name") == kb).groupBy("session_id")
    return s.agg(F.min("created_at").alias("started"), F.count(F.when(F.col("role") == "user", 1)).alias("questions"), F.max("created_at").alias("latest"))


def failed_by_class(failed: DataFrame) -> DataFrame:
    """AGG-06."""
    return failed.filter("status = 'pending'").groupBy("error_class").agg(F.count("*").alias("n"))


def failure_report(failed: DataFrame, dashboard: bool = False) -> DataFrame:
    """AGG-07, AGG-08, RS-02: totals, the map by class, and how many can be tried again."""
    by = failed_by_class(failed)
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_failed"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_class", "n")))).alias("by_error_class"),
        F.coalesce(F.sum(F.when(errors.retryable(F.col("error_class"), dashboard), F.col("n"))), F.lit(0)).alias("can_retry"),
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """AGG-09, AGG-17, AGG-20, TOPK-12: rows by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def topics(questions: DataFrame, column: str = "content", words: int = 10, limit: int = 10) -> DataFrame:
    """AGG-14, TOPK-09, ARR-01: the commonest of each question's first words, ties by name."""
    w = F.explode(F.slice(F.filter(F.split(F.lower(column), r"\s+"), lambda x: x != ""), 1, words)).alias("topic")
    return questions.select(w).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(limit)


def best_triples(facts: DataFrame) -> DataFrame:
    """AGG-15, WIN-05: of equal triples the most confident, the first at a tie."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy(F.desc("confidence"), "id")
    return facts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_counters(verdict: DataFrame) -> DataFrame:
    """AGG-21."""
    return verdict.agg(F.count_if(F.col("status") == "approved").alias("same"), F.count_if(F.col("status") == "rejected").alias("not_same"), F.count("*").alias("total"))


def work_list(changed: DataFrame, retry: DataFrame) -> DataFrame:
    """SET-04."""
    return changed.select("path").union(retry.select("path")).distinct()


def ranks(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """WIN-01, WIN-06: places from 0 within each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def with_overlap(chunks: DataFrame, overlap: int) -> DataFrame:
    """WIN-02: each chunk led by the tail of the one before it, if that one is longer than the overlap."""
    before = F.lag("content").over(Window.partitionBy("file_id").orderBy("chunk_index"))
    return chunks.withColumn("content", F.when(F.length(before) > overlap, F.concat(F.right(before, F.lit(overlap)), F.lit("\n\n"), F.col("content"))).otherwise(F.col("content")))
