"""Queries of this subpackage's operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, line_dedup, merkle, mixing, ngram_join, packing, period_runs, pii, quality_crf, secret_scan, simhash_neardup, token_counts, topk_search
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.positioned(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", F.get("positions", F.lit(1)).alias("repeat_position"))


def op4_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_with_links(table(spark, sf_dir, "documents"))


def op10_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = merkle.row_digest(*own[:3], own[3] + 1, own[4])
    chosen = F.crc32(own[0].cast("string").cast("binary")) % 7 == 0
    proven = merkle.manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"tampered": F.when(chosen, tampered)})
    out = proven.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_multi_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.planted_runs(table(spark, sf_dir, "documents"))


_ALL = (
    op1_token_counts,
    op2_simhash_pivot,
    op3_curriculum_mix,
    op4_weak_pii,
    op5_minhash_lines,
    op6_line_crf,
    op7_bin_completion,
    op8_secret_battery,
    op9_simhash_fingerprints,
    op10_nra_topk,
    op11_merkle_manifest,
    op12_multi_order_join,
    op13_period_runs,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op12_multi_order_join": ngram_join.ORACLE,
    "op13_period_runs": period_runs.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op3_curriculum_mix": mixing.ORACLE,
    "op10_nra_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
