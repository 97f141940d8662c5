"""Knowledge bases by name: catalogue changes, readers in between, and files by directory."""

from pathlib import Path

import pytest

from factloom.operators.namespaces import DEFAULT, Namespaces
from pyspark.sql import functions as F


def listing(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string").select("path", F.sha2("text", 256).alias("sha256"), "text")


def stored(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path, "bases").rglob("*.parquet")}


def test_names_move_no_data(spark, tmp_path):
    kbs = Namespaces(spark, str(tmp_path))
    assert list(kbs.names()) == [DEFAULT]
    kbs.create(" work ", "of the office")
    kbs.base("work").run(listing(spark, {"/w/a.md": "Anna is tall."}))
    kbs.create("home")
    before, reader = stored(tmp_path), kbs.base("work")
    kbs.rename("work", "office")
    assert stored(tmp_path) == before and kbs.names() == {DEFAULT: "", "home": "", "office": "of the office"}
    assert kbs.base("office").table("facts").count() == 1 and kbs.base("home").table("facts").count() == 0
    with pytest.raises(KeyError):
        kbs.base("work")
    for wrong in (lambda: kbs.create("home"), lambda: kbs.create("  "), lambda: kbs.rename("office", "home"), lambda: kbs.delete(DEFAULT)):
        with pytest.raises(ValueError):
            wrong()
    for wrong in (lambda: kbs.rename("none", "x"), lambda: kbs.delete("none"), lambda: kbs.clear("none")):
        with pytest.raises(KeyError):
            wrong()
    # An open reader keeps what it has; who opens the base now finds it empty.
    assert kbs.clear("office") == {"files": 1, "chunks": 1, "facts": 1, "vectors": 1, "failed_chunks": 0}
    assert reader.table("facts").count() == 1 and kbs.base("office").table("facts").count() == 0
    assert kbs.vacuum() == 1 and kbs.names()["office"] == "of the office"
    kbs.delete("office")
    assert list(kbs.names()) == [DEFAULT, "home"]
    kbs.rename(DEFAULT, "first")
    assert list(kbs.names()) == [DEFAULT, "first", "home"]


def test_of_two_changes_of_one_version_one_counts(spark, tmp_path):
    one, two = Namespaces(spark, str(tmp_path)), Namespaces(spark, str(tmp_path))
    v, found = two._now()
    one.create("a")
    with pytest.raises(Exception, match="exist"):
        two._swap(v, found | {"b": two._entry("b")})
    assert list(two.names()) == ["a", DEFAULT]


def test_files_by_directory(spark, tmp_path):
    kbs = Namespaces(spark, str(tmp_path))
    kbs.add_directory("/d/", "docs")
    kbs.add_directory("/d/deep", "deep")
    files = spark.createDataFrame([("/d/a",), ("/d/deep/b",), ("/d/deeper/c",), ("/e/x",), (None,)], "path string")
    of = lambda: {r["path"]: r["kb"] for r in kbs.routed(files).collect()}
    assert of() == {"/d/a": "docs", "/d/deep/b": "deep", "/d/deeper/c": "docs", "/e/x": None, None: None}
    kbs.rename("docs", "texts")
    kbs.add_directory("/e", DEFAULT)
    kbs.delete("deep")
    assert of() == {"/d/a": "texts", "/d/deep/b": "texts", "/d/deeper/c": "texts", "/e/x": DEFAULT, None: None}
    kbs.remove_directory("/d")
    assert of()["/d/a"] is None
