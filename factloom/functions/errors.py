"""Error classes and tolerant JSON."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RETRYABLE = ("RATE_LIMIT", "TIMEOUT", "MODEL_UNAVAILABLE")
DASHBOARD_RETRYABLE = (*RETRYABLE, "INVALID_JSON", "CONTEXT_LENGTH_EXCEEDED")
# What in a message tells its class, tested in this order.
MARKS = (("CONTEXT_LENGTH_EXCEEDED", ("context", "length", "token")), ("RATE_LIMIT", ("rate", "429")), ("TIMEOUT", ("timeout", "timed out")))
# Exceptions whose type alone tells the class.
KINDS = (("TIMEOUT", ("TimeoutException", "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout")), ("MODEL_UNAVAILABLE", ("ConnectError",)), ("INVALID_JSON", ("ValueError", "KeyError", "TypeError", "JSONDecodeError")))


def http_class(code: Column) -> Column:
    """ERR-01."""
    return F.when(code == 429, "RATE_LIMIT").when(code >= 500, "MODEL_UNAVAILABLE").otherwise("UNKNOWN")


def error_class(message: Column, kind: Column | None = None, status: Column | None = None) -> Column:
    """ERR-02: by the HTTP status if there is one, else by the exception's type, else by its message."""
    m, out = F.lower(message), F.lit("UNKNOWN")
    for name, marks in reversed(MARKS):
        out = F.when(reduce(Column.__or__, [m.contains(x) for x in marks]), name).otherwise(out)
    for name, types in KINDS if kind is not None else ():
        out = F.when(kind.isin(*types), name).otherwise(out)
    return out if status is None else F.when(status.isNotNull(), http_class(status)).otherwise(out)


def exception_class(e: BaseException) -> str:
    """ERR-02 for an exception at hand; its base classes count."""
    status = getattr(getattr(e, "response", None), "status_code", None)
    if status is not None:
        return "RATE_LIMIT" if status == 429 else "MODEL_UNAVAILABLE" if status >= 500 else "UNKNOWN"
    bases = {t.__name__ for t in type(e).__mro__}
    of_type = next((name for name, types in KINDS if bases & set(types)), None)
    return of_type or next((name for name, marks in MARKS if any(x in str(e).lower() for x in marks)), "UNKNOWN")


def backoff(attempt: int, longest: int = 30) -> int:
    """RS-03: seconds to wait after the attempt, from 0: 1, 2, 4 ... up to the longest."""
    return min(2**attempt, longest)


def retryable(c: Column, dashboard: bool = False) -> Column:
    """ERR-03."""
    return c.isin(*(DASHBOARD_RETRYABLE if dashboard else RETRYABLE))


FACT_FIELDS = ("title", "subject", "predicate", "object", "description", "evidence_span")
FACT = "struct<title:string,subject:string,predicate:string,object:string,description:string,evidence_span:string,confidence:int,tags:array<string>>"


def fact_of(d: dict) -> dict | None:
    """JSON-02: missing strings are empty, a missing confidence is 50."""
    if not isinstance(d, dict):
        return None
    out = {f: str(d.get(f) or "") for f in FACT_FIELDS}
    try:
        out["confidence"] = int(d.get("confidence", 50))
    except (TypeError, ValueError):
        out["confidence"] = 50
    tags = d.get("tags")
    out["tags"] = [str(t) for t in tags] if isinstance(tags, list) else []
    return out if out["subject"] and out["predicate"] and out["object"] else None


def tolerant_facts(text: str | None) -> list[dict]:
    """JSON-01: facts from a model's answer: fenced, a `facts` key, a list, or whatever balanced objects can be read."""
    s = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", (text or "").strip())
    try:
        got = json.loads(s)
        rows = got.get("facts", [got] if "subject" in got else []) if isinstance(got, dict) else got if isinstance(got, list) else []
    except ValueError:
        rows, reader, at = [], json.JSONDecoder(), 0
        while (at := s.find("{", at)) >= 0:
            try:
                d, end = reader.raw_decode(s, at)
            except ValueError:
                at += 1
                continue
            rows += d["facts"] if isinstance(d, dict) and isinstance(d.get("facts"), list) else [d]
            at = end
    return [f for f in map(fact_of, rows) if f]


def parse_facts(c: Column) -> Column:
    """JSON-01 over a column."""

    @F.pandas_udf(f"array<{FACT}>")
    def fn(s: pd.Series) -> pd.Series:
        return s.map(tolerant_facts)

    return fn(c)
