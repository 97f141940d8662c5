"""Compares registered queries with their SQL in DuckDB, as sorted rows with columns in name order."""

import datetime
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def differ(spark, con, query, sql, sf):
    df = query(spark, sf)
    got = rows(df.columns, map(tuple, df.collect()))
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} and {len(want)} rows; first difference {first}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    sf = sys.argv[1]
    con, sql = connect(sf), e.oracle_sql()
    for n, q in e.queries().items():
        if len(sys.argv) > 2 and not any(n.startswith(x) for x in sys.argv[2:]):
            continue
        if len(sys.argv) == 2 and (n.startswith("op") or n == "pipeline"):
            continue
        try:
            bad = differ(s, con, q, sql[n], sf) if n in sql else None if q(s, sf).count() >= 0 else ""
        except Exception as x:  # noqa: BLE001
            bad = f"{type(x).__name__}: {str(x)[:300]}"
        if bad:
            print("DIFF", n, str(bad)[:420], flush=True)
    print("done", len(e.queries()), len(sql))
