"""Near-duplicate texts by the exact Jaccard similarity of their word shingles.

A text's set is the XXH64 of its shingles of `width` lower-case words (a shorter text is one shingle). Equal texts are one
text with many rows. Each text's MinHash signature is cut into bands, texts that share a band are candidates, and these
are verified on their whole sets, by the same leaders, sketches and components as lines (see `line_dedup`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from . import line_dedup
from .common import batch, map_arrow, text_or_empty
from .simhash_neardup import shingle_hashes

SIMILARITY, WIDTH = 0.8, 5
#: Recall of a pair at the similarity s is 1 - (1 - s^ROWS)^BANDS: 0.9998 at 0.8.
BANDS, ROWS = 12, 3

_FACTORS = np.array([xxhash.xxh64_intdigest(f"factor {i}") | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles; a text without words has the hash of nothing."""
    h = np.unique(shingle_hashes(text, width).view(np.uint64).ravel())
    return h if len(h) else np.array([xxhash.xxh64_intdigest(b"")], np.uint64)


def band_keys(members: np.ndarray) -> list[int]:
    least = (members[None, :] * _FACTORS[:, None]).min(axis=1).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(least[b].tobytes(), b) for b in range(BANDS)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("line"))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, bands) of the distinct texts."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.array([band_keys(shingle_set(t, width)) for t in b.column(1).to_pylist()], np.uint64).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64)))
        return batch(["key", "bands"], b.column(0), lists)

    return map_arrow(_texts(docs), fn, "key long, bands array<long>").dropDuplicates(["key"])


def text_sets(docs: DataFrame, need: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key) -> (key, s): the whole sets of the needed texts."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        members = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return batch(["key", "s"], b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(members.view(np.int64))))

    return map_arrow(line_dedup.needed(_texts(docs), need), fn, "key long, s array<long>")


def text_components(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the texts, by key, that have a near duplicate."""
    sigs = line_dedup.materialize(signatures(docs, width), "text-signatures")
    return line_dedup.line_components(docs, sigs, similarity, lambda d, need: text_sets(d, need, width), lambda s: s)


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, links: DataFrame | None = None) -> DataFrame:
    """Keeps exactly one row of each component of near duplicates; the columns of `docs`.

    It is the row with the smallest doc_id, nulls last, then by the hash of the text. Null text counts as empty. Texts
    alone decide: rows of equal doc_id and unlike texts are rows of different components. `links` (src, dst) of texts' hashes,
    as another method finds them, count beside those of the similarity.
    """
    named = text_components(docs, width, similarity)
    if links is not None:
        named = connected_components(named.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(links.select("src", "dst")))
    first = docs.select(F.xxhash64(text_or_empty()).alias("key"), F.col("doc_id").cast("long").alias("doc_id")).groupBy("key").agg(F.min("doc_id").alias("first"))
    classes = first.join(named, first["key"] == named["node"], "left").withColumn("class", F.coalesce("component", "key"))
    kept = classes.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("k"))
    # Null doc_ids are dealt by the hash, so that the join is on plain keys and no group of equal texts lands in one task.
    kept = kept.select(F.coalesce("k.first", "k.key").alias("_at"), F.col("k.key").alias("_key"), F.col("k.none").alias("_none"))
    own = docs.withColumn("_key", F.xxhash64(text_or_empty())).withColumn("_none", F.col("doc_id").isNull())
    own = own.withColumn("_at", F.coalesce(F.col("doc_id").cast("long"), F.col("_key")))
    return own.join(kept, ["_at", "_key", "_none"], "left_semi").dropDuplicates(["_at", "_key", "_none"]).select(*docs.columns)
