"""Table schemas and states of the knowledge base."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _T = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


DIRECTORIES = _table(id=_L, path=_S, recursive=_B, exclude_patterns=T.ArrayType(_S), created_at=_T)
FILES = _table(id=_L, directory_id=_L, path=_S, sha256=_S, status=_S, error_msg=_S, file_size=_L, mtime=_D, indexed_at=_T, created_at=_T, retry_count=_I)
CHUNKS = _table(id=_L, file_id=_L, chunk_index=_I, content=_S, token_count=_I, status=_S, created_at=_T)
FACTS = _table(
    id=_L, file_id=_L, chunk_id=_L, subject=_S, predicate=_S, object=_S, title=_S, description=_S, evidence_span=_S, confidence=_I,
    tags=T.ArrayType(_S), embedding=T.ArrayType(T.FloatType()), user_score=_D, status=_S, created_at=_T,
)
RUNS = _table(id=_L, status=_S, files_total=_I, files_changed=_I, facts_added=_I, facts_removed=_I, started_at=_T, finished_at=_T, stop_requested=_I)
FEEDBACK = _table(id=_L, fact_id=_L, feedback_type=_S, reason=_S, created_at=_T)
PREFERENCES = _table(id=_L, pref_key=_S, pref_value=_S, confidence=_D, updated_at=_T)
PROPOSALS = _table(id=_L, entity_a=_S, entity_b=_S, proposed_name=_S, confidence=_D, llm_response=_S, status=_S, reviewed_at=_T, created_at=_T, proposal_type=_S)
FAILED_CHUNKS = _table(id=_L, chunk_id=_L, file_id=_L, error_class=_S, error_msg=_S, retry_count=_I, next_retry_at=_T, status=_S, created_at=_T)
CHAT = _table(id=_L, kb_name=_S, session_id=_S, role=_S, content=_S, sources=_S, related_facts=_S, feedback_given=_S, created_at=_T)
TABLES = {
    "directories": DIRECTORIES, "files": FILES, "chunks": CHUNKS, "facts": FACTS, "runs": RUNS, "user_feedback": FEEDBACK,
    "user_preferences": PREFERENCES, "entity_proposals": PROPOSALS, "failed_chunks": FAILED_CHUNKS, "chat_history": CHAT,
}


def empty_tables(spark) -> dict:
    """SNK-05: an empty table for each schema."""
    return {n: spark.createDataFrame([], s) for n, s in TABLES.items()}
