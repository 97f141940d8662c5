import re

import corpus_pipeline as P
from factloom.llm import line_dedup, mixing, packing, quality_crf
from factloom.llm.common import table


def one_of_each(texts):
    """The least doc_id of each component, by the Jaccard similarity of all pairs on five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return set(label.values())


def test_stages(spark, sf):
    """Each stage against what its operator says about the rows it was given."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    good = P.quality_stage(spark, docs, sf)
    said = {r.doc_id for r in quality_crf.quality(docs, table(spark, sf, "labels")).collect() if r.predicted}
    rows = good.collect()
    assert good.columns == columns and {r.doc_id for r in rows} == said
    good = spark.createDataFrame(rows, docs.schema)

    lines = P.line_stage(spark, good, sf)
    told = {r.doc_id: {int(x) for x in r.dropped.split(",") if x} for r in line_dedup.line_dedup(good).collect()}
    want = {}
    for r in rows:
        kept = [x for i, x in enumerate(r.text.split("\n")) if i not in told[r.doc_id]]
        if any(x.strip() for x in kept) or not told[r.doc_id]:
            want[r.doc_id] = "\n".join(kept)
    rows = lines.collect()
    assert lines.columns == columns and {r.doc_id: r.text for r in rows} == want
    lines = spark.createDataFrame(rows, docs.schema)

    one = P.neardup_stage(spark, lines, sf)
    want = one_of_each({r.doc_id: r.text for r in lines.collect()})
    rows = one.collect()
    assert one.columns == columns and {r.doc_id for r in rows} == want and len(rows) == len(want)
    one = spark.createDataFrame(rows, docs.schema)

    mixed = P.mixing_stage(spark, one, sf)
    copies = {r.doc_id: len(r.positions) for r in mixing.mix(one).collect()}
    rows = mixed.collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and got == {i: n for i, n in copies.items() if n}
    mixed = spark.createDataFrame(rows, docs.schema)

    packed = sorted(map(str, packing.pack(mixed).collect()))
    assert sorted(map(str, P.packing_stage(spark, mixed, sf).collect())) == packed
    run = P.run(spark, sf)
    assert run.count() == len(packed)


def test_odd_tables(spark, sf, tmp_path):
    """Null and empty texts, null and repeated doc_ids, repeated rows, near copies, clashing columns, empty tables."""
    body = "\n".join(f"Line number {i} tells of the river, the mill and the {w} that stood there." for i, w in enumerate("barn well gate oak fence path".split()))
    near = body.replace("mill and the well", "mill near a well")
    rows = [(1, body, "a"), (1, body, "a"), (2, near, "a"), (3, None, None), (4, "", "b"), (None, body, "b"), (None, "Some other words stand here, all alone.", "b"), (5, "x " * 30000, "c")]
    rows += [(100 + i, f"A clean text of its own, number {i * 7919}, with {i} apples and {i * i} pears in a basket.", "d") for i in range(30)]
    schema = "doc_id long, text string, source string, lang string, n_chars long, size int, position double, score string, _key long"
    spark.createDataFrame([(*r, "en", 1, 2, 0.5, "x", 7) for r in rows], schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(30)] + [(None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    out = P.run(spark, f"{tmp_path}/odd").collect()
    ids = [r.doc_id for r in out]
    assert {1, *range(100, 130)} <= set(ids) and not {3, 4} & set(ids)  # a document without lines has nothing left
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0
