"""Stored tables that change by adding segments: a folder of segments, and numbered manifests that name those that count.

A manifest is written last, whole and under a new number, so a reader has the state before a change or the state after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Segments:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._last = spark, path, 0

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _newest(self) -> int:
        """The newest manifest's number, 0 if there is none. Numbers follow each other, so one that was seen is gone on from."""
        done = lambda v: self._exists(f"{self.path}/v{v}/_SUCCESS")
        if not self._last or not done(self._last):
            self._last = (self.versions() or [0])[-1]
        while self._last and done(self._last + 1):
            self._last += 1
        return self._last

    def versions(self) -> list[int]:
        at, fs = self._at("")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._at(f"{n}/_SUCCESS")[0]))

    def segments(self) -> list[dict]:
        """What the newest manifest says of each segment, oldest first; none if there is no manifest."""
        return self.newest()[1]

    def newest(self) -> tuple[int, list[dict]]:
        """The newest manifest's number, 0 if there is none, and what `segments` gives."""
        v = self._newest()
        return (v, json.loads(self.spark.read.text(f"{self.path}/v{v}").first()[0])) if v else (0, [])

    def new(self) -> str:
        """A folder for a segment to be."""
        return f"{self.path}/s-{uuid.uuid4().hex}"

    def commit(self, segments: list[dict], after: int | None = None) -> None:
        """Makes these the segments that count; fails if another change has taken the number meanwhile. `after`: the number of the
        manifest that was read, so that a change since then makes it fail too."""
        v = 1 + (self._newest() if after is None else after)
        self.spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/v{v}")

    def write(self, rows: DataFrame, path: str, *order: str) -> None:
        """Rows in folders by their bucket and sorted by `order` within, a range of both for each task."""
        by = ["bucket", *order]
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.option("parquet.block.size", str(8 << 20)).partitionBy("bucket").parquet(path)


def bucket(c, buckets: int):
    """The folder of a value."""
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
