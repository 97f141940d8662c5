"""A corpus pipeline: quality, line dedup, near-dup removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import jaccard_neardup, line_dedup, mixing, packing, quality_crf, simhash_neardup
from factloom.llm.common import table
from factloom.plans.runtime import discard, materialize, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is not predicted 0."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand before; documents left without a line go."""
    return line_dedup.without_repeated_lines(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose fingerprints link (op2's search), and those of Jaccard similarity
    0.8 or more on five-word shingles, most of which differ in more bits than that search allows."""
    return jaccard_neardup.keep_one(docs, width=5, similarity=0.8, links=simhash_neardup.text_links(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order, a row for each copy."""
    return mixing.training_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", neardup_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The stages' models and searches have no SQL. The tests hold each stage against brute force or its operator's own
#: decisions, which have tests of their own, and the run against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again as the next one's input.

    Tables that a stage has written for itself are deleted once its result is written; only the last stage's remain.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch() as own:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")
        discard(spark, before + own[:-1])
        before = own[-1:]
    return docs
