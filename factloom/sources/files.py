"""Files as DataFrames: scanning, hashing, routing and parsing; writing tables."""

from __future__ import annotations

import ast
import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes by the way a file is read.
TEXT = (".md", ".txt", ".rst", ".log", ".yaml", ".yml", ".toml", ".cfg")
WEB = (".html", ".htm")
OFFICE = (".docx", ".xlsx", ".pptx", ".doc", ".ppt", ".xls")
CODE = (".py", ".js", ".ts", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp")
IMAGES = (".jpg", ".jpeg", ".png", ".tiff", ".bmp", ".gif", ".webp")
DATA = (".csv", ".json")
PDF = ".pdf"
EXTERNAL = (*OFFICE, *IMAGES, PDF)
SUPPORTED = (*TEXT, *WEB, *CODE, *DATA, *EXTERNAL)
MAX_BYTES = 50 << 20


def scan(spark: SparkSession, folder: str, recursive: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01..03: (path, sha256, file_size, mtime, content) of a folder, without excluded path components."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = r.load(folder).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"), "content")
    return df.filter(~excluded(F.col("path"), exclude)) if exclude else df


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """SRC-02: any whole path component equals a pattern."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, patterns)))


def known_hashes(files: DataFrame) -> DataFrame:
    """SRC-04."""
    return files.filter("status <> 'deleted'").select("path", "sha256")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def supported(path: Column) -> Column:
    """SRC-05."""
    return suffix(path).isin(*SUPPORTED)


def route(path: Column, size: Column) -> Column:
    """SRC-06: the way a file is read, or why it is not."""
    s = suffix(path)
    out = F.when(size > MAX_BYTES, "too_large")
    for name, kinds in (("python", (".py",)), ("code", CODE), ("csv", (".csv",)), ("json", (".json",)), ("html", WEB), ("text", TEXT), ("external", EXTERNAL)):
        out = out.when(s.isin(*kinds), name)
    return out.otherwise("unsupported")


def needs_ocr(text: Column, size: Column, path: Column) -> Column:
    """SRC-11: under 200 letters, digits and inner blanks; or, in a PDF or image over 1 MB, under 10 of them a KB."""
    n = F.length(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)^\s+|\s+$", ""))
    return (n < 200) | (suffix(path).isin(PDF, *IMAGES) & (size / 1024 > 1024) & (n / (size / 1024) < 10))


def with_ocr(text: Column, ocr: Column) -> Column:
    """SRC-12: the longer of the two."""
    return F.when(F.length(ocr) > F.length(text), ocr).otherwise(text)


def html_text(html: Column) -> Column:
    """SRC-09 for web pages: tags, scripts and styles out, entities of markup back, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# How lines begin that tell what a source file declares, blanks before them aside, and lines that hold a
# one-line documentation comment.
DECLARES = r"^(?:(?:import|from|require|#include|use|package|func|fn|function|def|class|interface|type|struct|enum)\s|//|/\*\*.*\*/|#)"


def code_outline(text: Column) -> Column:
    """SRC-15: of the first 500 lines those that declare, import or comment."""
    return F.array_join(F.filter(F.slice(F.split(text, r"\r\n|\r|\n"), 1, 500), lambda x: F.trim(x, F.lit(" \t\x0b\x0c")).rlike(DECLARES)), "\n")


def _signature(f: ast.FunctionDef) -> str:
    """Decorators, name, plain arguments, result and docstring; three dots stand for a body that has none."""
    args = ", ".join(a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in f.args.args)
    head = [f"@{ast.unparse(d)}" for d in f.decorator_list] + [f"def {f.name}({args})" + (f" -> {ast.unparse(f.returns)}" if f.returns else "") + ":"]
    doc = ast.get_docstring(f)
    return "\n".join(head) + (f'\n    """{doc}"""' if doc else " ...")


def python_outline(source: str) -> str:
    """SRC-14: imports, functions and classes with their docstrings, outermost first; a class also lists its methods, which
    come again on their own. At a syntax error the first 200 lines."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return "\n".join(source.splitlines()[:200])
    doc = ast.get_docstring(tree, clean=False)
    out = [] if doc is None else [f'""" {doc} """']
    for node in ast.walk(tree):
        match node:
            case ast.Import() | ast.ImportFrom():
                out.append(ast.unparse(node))
            case ast.FunctionDef():
                out.append(_signature(node))
            case ast.ClassDef():
                bases = ", ".join(map(ast.unparse, node.bases))
                out.append(f"\nclass {node.name}" + (f"({bases})" if bases else "") + ":")
                out += [f'    """{d}"""' for d in [ast.get_docstring(node)] if d]
                out += ["    " + _signature(x) for x in node.body if isinstance(x, ast.FunctionDef)]
    return "\n".join(out)


def csv_summary(text: str, name: str = "") -> str:
    """SRC-16: name, columns, number of rows and the first ten."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return "(empty CSV)"
    out = [f"CSV file: {name}", f"Columns ({len(rows[0])}): {', '.join(rows[0])}", f"Rows: {len(rows) - 1}"]
    return "\n".join(out + (["\nSample (first 10 rows):"] + ["  " + " | ".join(r) for r in rows[1:11]] if rows[1:] else []))


def json_text(text: str, most: int = 10000) -> str:
    """SRC-17: printed with indents and cut; what is no JSON as its first half of that."""
    try:
        out = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except ValueError:
        return text[: most // 2]
    return out if len(out) <= most else out[:most] + "\n... (truncated)"


def decode(content: bytes) -> str:
    """SRC-07: UTF-8, else Latin-1, which always reads."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parse(files: DataFrame, external=None) -> DataFrame:
    """SRC-06..17: (path, content, file_size, ...) with route and text. `external` reads what needs a converter or OCR
    (SRC-08..10, SRC-13): a function bytes -> text; without it such files have no text."""
    readers = {"python": lambda t, _: python_outline(t), "csv": csv_summary, "json": lambda t, _: json_text(t)}

    @F.pandas_udf("string")
    def read(how: pd.Series, content: pd.Series, path: pd.Series) -> pd.Series:
        def one(h, c, p):
            if h in ("too_large", "unsupported") or c is None:
                return None
            if h == "external":
                return external(c) if external else None
            t = decode(bytes(c))
            return readers[h](t, p.rpartition("/")[2]) if h in readers else t

        return pd.Series([one(h, c, p) for h, c, p in zip(how, content, path)], dtype=object)

    routed = files.withColumn("route", route(F.col("path"), F.col("file_size")))
    raw = routed.withColumn("text", read("route", "content", "path"))
    return raw.withColumn("text", F.when(F.col("route") == "html", html_text(F.col("text"))).when(F.col("route") == "code", code_outline(F.col("text"))).otherwise(F.col("text")))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    """SNK-01, SNK-04: rows or vectors appended in one write, by knowledge base if there is such a column."""
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def purge(tables: dict[str, DataFrame], keep: tuple[str, ...] = ("chat_history",)) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """SNK-06: every table emptied but those kept, with the counts of what went."""
    gone = {n: d.count() for n, d in tables.items() if n not in keep}
    return {n: d if n in keep else d.limit(0) for n, d in tables.items()}, gone


LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def log_lines(lines: DataFrame, level: str = "DEBUG") -> DataFrame:
    """SNK-08: lines (value) of a level or above."""
    named = lines.withColumn("level", F.regexp_extract("value", rf"\b({'|'.join(LEVELS)})\b", 1))
    return named.filter(F.col("level").isin(*LEVELS[LEVELS.index(level) :]))


def config(defaults: dict, given: dict | None = None, env: dict | None = None) -> dict:
    """SNK-07: defaults, then the file's values, then the environment's; unknown names are refused."""
    out = dict(defaults)
    for source in (given or {}, env or {}):
        if unknown := set(source) - set(defaults):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out |= {k: type(defaults[k])(v) if defaults[k] is not None else v for k, v in source.items()}
    return out
