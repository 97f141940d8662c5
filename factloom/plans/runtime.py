"""Lineage cuts in the folder that all executors share.

A table that several later jobs read is written once to the folder named by
``spark.checkpoint.dir`` and read back, so that a lost executor costs a re-read
and never a recomputation of the stages before the cut.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a record batch for Python at most, beyond its last row: texts are long, and both sides hold a batch whole.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit of a batch for Python to `BATCH_BYTES`."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where it is unset (tests, local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths written since each `scratch` block of this thread or task began, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes `df` to the shared folder and returns the written table. Hashes do not shrink: write such tables `uncompressed`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    for scope in _scopes.get():
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths that `materialize` writes in the block, for `discard` once nothing reads them any more."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that `materialize` has written; empties the list."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def stored_path(spark: SparkSession, tag: str, tables: list[str]) -> str:
    """A folder of the application for something that is built of these tables: another one once a file of theirs changes."""
    seen = []
    for table in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at):
            seen.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{sha256(repr(sorted(seen)).encode()).hexdigest()[:32]}"
