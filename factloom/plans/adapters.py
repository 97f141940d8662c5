"""Knowledge-base tables as views of the driver's tables, and the same views as DuckDB CTEs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored_path

# Eight kinds of files, by doc_id.
_SUFFIX = "CASE abs(doc_id) % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.csv' WHEN 4 THEN '.html' WHEN 5 THEN '.png' WHEN 6 THEN '.PDF' ELSE '.xyz' END"
_STATUS = "CASE {0} % 7 WHEN 0 THEN 'pending' WHEN 4 THEN 'failed' WHEN 5 THEN 'deleted' WHEN 6 THEN 'processing' ELSE 'done' END"
_FACTS = """
SELECT cast(n_nationkey AS BIGINT) AS id, n_name AS subject, 'in_region' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000 + c_custkey, c_name, 'in_nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 10000000 + s_suppkey, s_name, 'in_nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 20000000 + o_orderkey, concat('Order ', cast(o_orderkey AS STRING)), 'placed_by', c_name FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 60000000 + o_orderkey, concat('Order ', cast(o_orderkey AS STRING)), 'placed_on', substr(cast(o_orderdate AS STRING), 1, 10) FROM orders
"""
_FACT_TABLES = ("nation", "region", "customer", "supplier", "orders")
_VIEWS = {
    "files": "SELECT doc_id AS id, doc_id % 5 AS directory_id, concat('/kb/', source, '/', cast(doc_id AS STRING), " + _SUFFIX + ") AS path, sha256 AS sha256, "
    + _STATUS.format("doc_id")
    + " AS status, CASE WHEN doc_id % 7 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'ocr used' ELSE 'parse error' END END AS error_msg, file_size, "
    "CASE WHEN doc_id % 7 IN (1, 2, 3) THEN doc_id * 60 END AS indexed_at, doc_id * 30 AS created_at, cast(doc_id % 5 AS INT) AS retry_count FROM hashed",
    "facts": "SELECT id, id % 997 AS file_id, id AS chunk_id, subject, predicate, object, cast(30 + id % 70 AS INT) AS confidence, "
    "CASE id % 3 WHEN 0 THEN concat(subject, ' and ', object) ELSE '' END AS title, CASE id % 4 WHEN 0 THEN concat('Recorded in row ', cast(id AS STRING)) ELSE '' END AS description, "
    "concat(subject, ' ', predicate, ' ', object) AS evidence_span, cast(0.5 + (id % 4) * 0.5 AS DOUBLE) AS user_score, CASE WHEN id % 11 = 0 THEN 'deleted' ELSE 'active' END AS status FROM triples",
    "failed_chunks": "SELECT event_id AS id, event_id * 3 AS chunk_id, event_id % 997 AS file_id, CASE event_id % 6 WHEN 0 THEN 'CONTEXT_LENGTH_EXCEEDED' WHEN 1 THEN 'RATE_LIMIT' "
    "WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'INVALID_JSON' WHEN 4 THEN 'MODEL_UNAVAILABLE' ELSE 'UNKNOWN' END AS error_class, props AS error_msg, cast(event_id % 4 AS INT) AS retry_count, "
    "CASE WHEN event_id % 3 > 0 THEN event_id % 1000 END AS next_retry_at, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'skipped' ELSE 'pending' END AS status, "
    "cast(event_id AS BIGINT) AS created_at FROM events WHERE event_type = 'error'",
    "chat": "SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'other' END AS kb_name, cast(conv_id AS STRING) AS session_id, role, text AS content, "
    "conv_id * 1000 + turn AS created_at FROM conversations WHERE role IN ('user', 'assistant')",
    "feedback": "SELECT event_id AS id, event_id % 5000 AS fact_id, CASE event_type WHEN 'error' THEN 'negative' ELSE 'positive' END AS feedback_type, user_id FROM events "
    "WHERE event_type IN ('purchase', 'signup', 'error')",
    "proposals": "SELECT s_suppkey AS id, s_name AS entity_a, concat(s_name, ' Ltd') AS entity_b, cast((s_suppkey % 100) / 100.0 AS DOUBLE) AS confidence, "
    "CASE s_suppkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, cast(s_suppkey % 17 AS BIGINT) AS created_at, CASE WHEN s_suppkey % 3 = 0 THEN 'suspect' ELSE 'merge' END AS proposal_type FROM supplier",
    "runs": "SELECT cast(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'cancelled' ELSE 'completed' END AS status, n_nationkey * 10 AS files_total, "
    "n_nationkey % 3 AS stop_requested FROM nation",
    "previous": "SELECT doc_id AS id, concat('/kb/', source, '/', cast(CASE WHEN doc_id % 13 = 0 THEN -doc_id - 1 ELSE doc_id END AS STRING), " + _SUFFIX + ") AS path, "
    "CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE sha256 END AS sha256 FROM hashed",
}

#: The views as CTEs for DuckDB; a query is appended.
SQL = (
    "WITH hashed AS (SELECT doc_id, source, sha256(text) AS sha256, octet_length(encode(text)) AS file_size FROM documents), triples AS ("
    + _FACTS.replace(" STRING)", " VARCHAR)")
    + "), "
    + ", ".join(f"{n} AS ({q.replace(' STRING)', ' VARCHAR)')})" for n, q in _VIEWS.items())
    + ", chunks AS (SELECT doc_id * 100000 + i - 1 AS id, doc_id AS file_id, cast(i - 1 AS INT) AS chunk_index, l[i] AS content, CASE WHEN (doc_id + i) % 5 = 0 THEN 'failed' ELSE 'done' END AS status "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))\n"
)


class KnowledgeBase:
    """The knowledge base of a folder of driver tables, each table built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, tag: str) -> str:
        """Where something that is built of the facts is kept as long as their tables stay the same."""
        return stored_path(self.spark, tag, [f"{self.sf_dir}/{n}.parquet" for n in _FACT_TABLES])

    @cached_property
    def hashed(self) -> DataFrame:
        return self.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("file_size"))

    @cached_property
    def triples(self) -> DataFrame:
        q = _FACTS
        for n in _FACT_TABLES:
            q = q.replace(f" {n} ", f" {{{n}}} ").replace(f" {n}\n", f" {{{n}}}\n")
        return self.spark.sql(q, **{n: self.table(n) for n in _FACT_TABLES})

    def _view(self, name: str, source: str, df: DataFrame) -> DataFrame:
        return self.spark.sql(_VIEWS[name].replace(f"FROM {source}", "FROM {src}"), src=df)

    files = cached_property(lambda s: s._view("files", "hashed", s.hashed))
    previous = cached_property(lambda s: s._view("previous", "hashed", s.hashed))
    facts = cached_property(lambda s: s._view("facts", "triples", s.triples))
    failed_chunks = cached_property(lambda s: s._view("failed_chunks", "events", s.table("events")))
    chat = cached_property(lambda s: s._view("chat", "conversations", s.table("conversations")))
    feedback = cached_property(lambda s: s._view("feedback", "events", s.table("events")))
    proposals = cached_property(lambda s: s._view("proposals", "supplier", s.table("supplier")))
    runs = cached_property(lambda s: s._view("runs", "nation", s.table("nation")))
    embeddings = cached_property(lambda s: s.table("embeddings").select(F.col("vec_id").alias("fact_id"), "embedding", "label"))

    @cached_property
    def chunks(self) -> DataFrame:
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
        failed = (F.col("doc_id") + F.col("chunk_index") + 1) % 5 == 0
        return lines.select(
            (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), F.col("doc_id").alias("file_id"), "chunk_index", "content", F.when(failed, "failed").otherwise("done").alias("status")
        )
