"""Extraction, retries and the index run as DataFrame jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import errors, text
from ..plans.runtime import materialize, small_batches
from . import relational, updates

Extractor = Callable[[str, int], str]


def rule_extractor(chunk: str, round_no: int) -> str:
    """A deterministic stand-in for a language model: "A is B." sentences as JSON."""
    import json
    import re

    rows = [{"subject": a, "predicate": "is", "object": b, "confidence": 60 + 10 * round_no} for a, b in re.findall(r"\b([A-Z]\w+) is ([\w ]+?)[.\n]", chunk + "\n")]
    return json.dumps({"facts": rows})


def extract(chunks: DataFrame, extractor: Extractor = rule_extractor, rounds: int = 2, least: int = 30, attempts: int = 3) -> DataFrame:
    """EX-01..03, RS-01: chunks(id, file_id, content) -> facts, and a row with error_class for a round that fails.

    A round is tried `attempts` times; one that fails does not stop the others. Equal triples of a chunk are one fact,
    the most confident.
    """
    fields = [*errors.FACT_FIELDS, "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, f, content in zip(b["id"], b["file_id"], b["content"]):
                for r in range(rounds):
                    wrong = None
                    for _ in range(attempts):
                        try:
                            out += [(i, f, r, *[x[c] for c in fields], None) for x in errors.tolerant_facts(extractor(content, r))]
                            wrong = None
                            break
                        except Exception as e:  # noqa: BLE001  whatever the model's client raises is data here
                            wrong = str(e) or type(e).__name__
                    if wrong:
                        out.append((i, f, r, *[None] * len(fields), wrong))
            yield pd.DataFrame(out, columns=["chunk_id", "file_id", "round", *fields, "error"]).astype({"confidence": "Int32"})

    small_batches(chunks.sparkSession)
    schema = "chunk_id long, file_id long, round int, " + ", ".join(f"{c} string" for c in errors.FACT_FIELDS) + ", confidence int, error string"
    return chunks.select("id", "file_id", "content").mapInPandas(run, schema).withColumn("error_class", F.when(F.col("error").isNotNull(), errors.error_class(F.col("error"))))


def extracted_facts(raw: DataFrame, least: int = 30) -> DataFrame:
    """EX-01, AGG-15: what of an extraction are facts: confident, and once for each triple of a chunk."""
    good = raw.filter("error IS NULL").filter(F.col("confidence") >= least)
    best = good.groupBy("chunk_id", "file_id", "subject", "predicate", "object").agg(F.max_by(F.struct("confidence", "title", "description", "evidence_span"), F.struct("confidence", -F.col("round"))).alias("x"))
    return best.select("chunk_id", "file_id", "subject", "predicate", "object", "x.*")


def retry_plan(files: DataFrame, budget: int = 3) -> DataFrame:
    """IX-03: what to do with each file: retry pending and failed ones within the budget, the exhausted are dead."""
    plan = F.when(F.col("status") == "pending", "retry").when((F.col("status") == "failed") & (F.col("retry_count") < budget), "retry").when(F.col("status") == "failed", "dead")
    return files.select("path", "status", "retry_count", plan.alias("plan")).filter("plan IS NOT NULL")


def repair(runs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPD-14: what a crash left behind."""
    return updates.set_where(runs, F.col("status") == "running", status="crashed"), updates.set_where(files, F.col("status") == "processing", status="pending")


def dead_letters(failed: DataFrame, chunks: DataFrame, extractor: Extractor = rule_extractor, now=0, batch: int = 10) -> tuple[DataFrame, DataFrame]:
    """RS-02, DLQ-01: due entries tried again: (facts, entries with their new status)."""
    ready = relational.due(failed, now, batch).filter(errors.retryable(F.col("error_class")))
    again = materialize(extract(chunks.join(ready.select(F.col("chunk_id").alias("id")), "id", "left_semi"), extractor), "extracted")
    bad = again.filter("error IS NOT NULL").select("chunk_id").distinct().withColumn("_bad", F.lit(True))
    done = ready.join(bad, "chunk_id", "left").select("id", F.when(F.col("_bad"), "failed").otherwise("done").alias("_new"))
    new = failed.join(done, "id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
    return extracted_facts(again), new


def index_run(listing: DataFrame, files: DataFrame, extractor: Extractor = rule_extractor, max_chars: int = 24000, overlap: int = 500) -> dict[str, DataFrame]:
    """IX-01, IX-02: listing(path, sha256, text) against the known files: changes, files, chunks, facts, failures."""
    changes = relational.snapshot_diff(listing, files.filter("status <> 'deleted'"))
    work = listing.join(changes.filter("change IN ('added', 'modified')").select("path"), "path", "left_semi")
    named = work.withColumn("file_id", updates.id_of("path"))
    pieces = named.select("path", "file_id", F.posexplode(text.chunk_udf(max_chars, overlap)(F.col("text"))).alias("chunk_index", "content"))
    chunks = pieces.withColumn("id", updates.id_of("path", "chunk_index")).drop("path")
    raw = materialize(extract(chunks, extractor), "extracted")  # read twice, and a model is asked once
    failed = raw.filter("error IS NOT NULL").select("chunk_id", "file_id", "error_class", text.cut(F.col("error")).alias("error_msg"))
    return {"changes": changes, "chunks": chunks, "facts": extracted_facts(raw), "failed_chunks": failed, "files": named.select("path", "sha256", "file_id")}
