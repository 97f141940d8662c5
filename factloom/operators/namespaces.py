"""Several knowledge bases in one folder: a catalogue that says which folder is whose, changed as a whole."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.segments import Segments
from .indexed import _TABLES, IndexedBase

DEFAULT = "default"


class Namespaces:
    """KB-01: create, rename, delete, clear, and the directories whose files a knowledge base takes.

    Each change is a new version of the catalogue, which holds names, not data: a rename moves nothing, and a reader that has
    opened a base goes on with what it has opened. Of two changes that were made from one version the second fails with
    Spark's error of a path that exists, and nothing of it counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Segments(spark, f"{path}/catalogue")

    def _now(self) -> tuple[int, dict[str, dict]]:
        v, rows = self.files.newest()
        found = {r["name"]: r for r in rows}
        return v, found if v else {DEFAULT: {"name": DEFAULT, "folder": DEFAULT, "description": "", "directories": []}}

    def _swap(self, v: int, found: dict[str, dict]) -> None:
        self.files.commit(list(found.values()), after=v)

    def names(self) -> dict[str, str]:
        """Each name with its description."""
        return {n: r["description"] for n, r in sorted(self._now()[1].items())}

    def base(self, name: str) -> IndexedBase:
        """The knowledge base that has the name now."""
        return IndexedBase(self.spark, f"{self.path}/bases/{self._known(name)['folder']}")

    def _known(self, name: str, found: dict[str, dict] | None = None) -> dict:
        found = self._now()[1] if found is None else found
        if name not in found:
            raise KeyError(f"no knowledge base {name!r}")
        return found[name]

    def create(self, name: str, description: str = "") -> None:
        v, found = self._now()
        self._swap(v, found | {self._free(name, found): self._entry(name.strip(), description)})

    @staticmethod
    def _free(name: str, found: dict[str, dict]) -> str:
        name = (name or "").strip()
        if not name:
            raise ValueError("a knowledge base needs a name")
        if name in found:
            raise ValueError(f"there is a knowledge base {name!r}")
        return name

    @staticmethod
    def _entry(name: str, description: str = "") -> dict:
        return {"name": name, "folder": uuid.uuid4().hex, "description": description, "directories": []}

    def rename(self, old: str, new: str) -> None:
        """The base keeps its data, description and directories. The default one may be renamed; a new default is then empty."""
        v, found = self._now()
        row = self._known(old, found)
        new = self._free(new, found)
        found = {n: r for n, r in found.items() if n != old} | {new: {**row, "name": new}}
        self._swap(v, found if DEFAULT in found else found | {DEFAULT: self._entry(DEFAULT)})

    def delete(self, name: str) -> None:
        """Its directories are no longer anybody's. The default base cannot be deleted."""
        if name == DEFAULT:
            raise ValueError("the default knowledge base stays")
        v, found = self._now()
        self._known(name, found)
        self._swap(v, {n: r for n, r in found.items() if n != name})

    def clear(self, name: str) -> dict[str, int]:
        """An empty base under the name, with its description and directories; returns the rows of each table that are gone."""
        v, found = self._now()
        row, base = self._known(name, found), self.base(name)
        gone = {t: base.table(t).count() for t in _TABLES}
        self._swap(v, found | {name: {**row, "folder": uuid.uuid4().hex}})
        return gone

    def add_directory(self, directory: str, name: str) -> None:
        """Files below the directory are the base's; a new name makes a new base. A directory is one base's at a time."""
        v, found = self._now()
        at = directory.rstrip("/")
        found = {n: {**r, "directories": [d for d in r["directories"] if d != at]} for n, r in found.items()}
        row = found.get(name) or self._entry(self._free(name, found))
        self._swap(v, found | {row["name"]: {**row, "directories": [*row["directories"], at]}})

    def remove_directory(self, directory: str) -> None:
        v, found = self._now()
        self._swap(v, {n: {**r, "directories": [d for d in r["directories"] if d != directory.rstrip("/")]} for n, r in found.items()})

    def routed(self, files: DataFrame) -> DataFrame:
        """Files with `kb`: the base whose directory is the longest above the path, null if there is none. The directories are those
        that somebody has configured, and become one expression."""
        own = sorted(((d, n) for n, r in self._now()[1].items() for d in r["directories"]), key=lambda x: (-len(x[0]), x))
        tests = reduce(lambda c, x: c.when(F.col("path").startswith(x[0] + "/"), x[1]), own, F.when(F.lit(False), ""))
        return files.withColumn("kb", tests)

    def vacuum(self) -> int:
        """Deletes folders that no name has: no reader may have one of them open. Returns their number."""
        held = {r["folder"] for r in self._now()[1].values()}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bases")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        lost = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in held] if fs.exists(at) else []
        for folder in lost:
            fs.delete(folder, True)
        return len(lost)
