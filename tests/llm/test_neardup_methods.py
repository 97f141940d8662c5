"""the pipeline's near-dup stage joins what op2's fingerprints link, beside what the Jaccard similarity does."""

import corpus_pipeline as P


def test_fingerprints_count(spark):
    often = "the same five plain words " * 300
    rows = [(i, often + " ".join(f"{w}{k}" for k in range(60))) for i, w in ((3, "river"), (1, "stone"), (None, "field"))]
    rows.append((7, " ".join(f"alone{k}" for k in range(60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Distinct shingles in common are 5 of more than 100; the repeated ones outweigh the rest in each bit.
    assert sorted(r.doc_id for r in P.neardup_stage(spark, docs, "").collect()) == [1, 7]
