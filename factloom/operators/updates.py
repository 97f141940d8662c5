"""Updates and deletes as pure transforms: the old table in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_of(*columns: str) -> Column:
    """An id that is not negative, from the 63 upper bits of the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """UPD-01, UPD-10, UPD-13, UPD-14, UPD-18: columns set on the rows that a condition holds for."""
    new = {c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    return df.withColumns(new)


def retry_count(files: DataFrame, condition: Column, reset: bool = False) -> DataFrame:
    """UPD-02."""
    return set_where(files, condition, retry_count=F.lit(0) if reset else F.col("retry_count") + 1)


def soft_delete(files: DataFrame, facts: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """UPD-03: files marked deleted, and their facts, detached from their chunks."""
    ids = files.filter(gone).select(F.col("id").alias("_gone"))
    hit = facts.join(ids, facts["file_id"] == ids["_gone"], "left")
    new = hit.withColumns({"status": F.when(F.col("_gone").isNotNull(), "deleted").otherwise(F.col("status")), "chunk_id": F.when(F.col("_gone").isNull(), F.col("chunk_id"))})
    return set_where(files, gone, status="deleted"), new.drop("_gone")


def delete_chunks(chunks: DataFrame, failed: DataFrame, file_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UPD-04: chunks of files dropped, and failed entries' references to them nulled."""
    ids = file_ids.select(F.col("file_id").alias("_f")).distinct()
    lost = chunks.join(ids, chunks["file_id"] == ids["_f"], "left_semi").select(F.col("id").alias("_c"))
    kept = chunks.join(ids, chunks["file_id"] == ids["_f"], "left_anti")
    ref = failed.join(lost, failed["chunk_id"] == lost["_c"], "left").withColumn("chunk_id", F.when(F.col("_c").isNull(), F.col("chunk_id"))).drop("_c")
    return kept, ref


def clamp(score: Column, delta) -> Column:
    """UPD-05: a score and a vote, held to 0..2."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), score + delta))


def decay(facts: DataFrame, rate: float = 0.01) -> DataFrame:
    """UPD-06: active scores move to 1."""
    return set_where(facts, F.col("status") == "active", user_score=F.col("user_score") - (F.col("user_score") - 1.0) * rate)


def rename_entity(facts: DataFrame, old: str, new: str, any_status: bool = False) -> DataFrame:
    """UPD-07: both columns of active facts."""
    live = F.lit(True) if any_status else F.col("status") == "active"
    swap = lambda c: F.when(live & (F.col(c) == old), new).otherwise(F.col(c))
    return facts.withColumns({"subject": swap("subject"), "object": swap("object")})


def delete_entity(facts: DataFrame, name: str) -> DataFrame:
    """UPD-08."""
    return set_where(facts, (F.col("status") == "active") & ((F.col("subject") == name) | (F.col("object") == name)), status="deleted")


def batch_entities(facts: DataFrame, operations: list[dict]) -> tuple[DataFrame, list[dict]]:
    """UPD-09: renames and deletes in their order; one result for each, with what is wrong with an invalid one."""
    results = []
    for o in operations:
        kind, name, new = o.get("op"), o.get("name"), o.get("new_name")
        wrong = None if kind in ("rename", "delete") else "unknown operation"
        wrong = wrong or (None if name else "name is missing") or ("new name is missing" if kind == "rename" and not new else None)
        if not wrong:
            facts = rename_entity(facts, name, new) if kind == "rename" else delete_entity(facts, name)
        results.append({"op": kind, "name": name, "ok": not wrong, "error": wrong})
    return facts, results


def map_names(facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """ER-03: many renames at once, each name as it is to be called in the end."""
    if not names:
        return facts
    rows = facts.sparkSession.createDataFrame(list(names.items()), "_old string, _new string")
    for c in ("subject", "object"):
        facts = facts.join(rows, facts[c] == rows["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return facts


def retry_failed(failed: DataFrame, entry_id: int) -> DataFrame:
    """UPD-11: queued again unless done."""
    return set_where(failed, (F.col("id") == entry_id) & (F.col("status") != "done"), status="pending", retry_count=F.lit(0))


def prune(failed: DataFrame, oldest) -> DataFrame:
    """UPD-12: entries since a time."""
    return failed.filter(F.col("created_at") >= oldest)


def write_back(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """UPD-15: new embeddings (fact_id, embedding) onto facts."""
    new = vectors.select(F.col("fact_id").alias("id"), F.col("embedding").alias("_new"))
    old = F.col("embedding") if "embedding" in facts.columns else F.lit(None).cast("array<float>")
    return facts.join(new, "id", "left").withColumn("embedding", F.coalesce("_new", old)).drop("_new")


def delete_directory(files: DataFrame, chunks: DataFrame, facts: DataFrame, directory_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """UPD-16: a directory's files and all that hangs on them."""
    keep = files.filter(F.col("directory_id") != directory_id)
    gone = files.filter(F.col("directory_id") == directory_id).select(F.col("id").alias("file_id"))
    return keep, chunks.join(gone, "file_id", "left_anti"), facts.join(gone, "file_id", "left_anti")


def checkpoint(files: DataFrame, chunks: DataFrame, file_id: int) -> tuple[DataFrame, DataFrame]:
    """UPD-17: a file and its processing chunks done."""
    return set_where(files, F.col("id") == file_id, status="done"), set_where(chunks, (F.col("file_id") == file_id) & (F.col("status") == "processing"), status="done")


def upsert(files: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-02, SNK-03: rows by path; known paths keep their id, unknown ones get the hash of the path."""
    n = new.select("path", *[F.col(c).alias(f"_{c}") for c in new.columns if c != "path"])
    out = files.withColumn("_known", F.lit(True)).join(n.withColumn("_given", F.lit(True)), "path", "full_outer")
    given = {c: F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c)) for c in new.columns if c != "path" and c in files.columns and c != "id"}
    given["id"] = F.coalesce("id", id_of("path"))
    return out.withColumns(given).select(*files.columns)


def latest(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """FLT-15, WIN-03: the last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
