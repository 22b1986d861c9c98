"""Run registered queries next to their SQL: python tests/check_queries.py [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6)
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    """(number of rows, None) or (number of rows, what differs)."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    want = con.sql(sql)
    want_rows = want.fetchall()
    if sorted(df.columns) != sorted(want.columns):
        return len(rows), f"columns {sorted(df.columns)} != {sorted(want.columns)}"
    a, b = canonical(df.columns, rows), canonical(want.columns, want_rows)
    if a != b:
        gone = [x for x in a if x not in set(b)][:2]
        miss = [x for x in b if x not in set(a)][:2]
        return len(rows), f"{sorted(df.columns)}\n  rows {len(a)} / {len(b)}\n  only spark {gone}\n  only sql   {miss}"
    return len(rows), None


if __name__ == "__main__":
    from eventflow.session import build_session
    import __spark_entry__ as entry_module

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN"):  # a session without this package's settings
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        began = time.time()
        try:
            n, wrong = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            n, wrong = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += wrong is not None
        mark = "ok " if wrong is None and name in sqls else "run" if wrong is None else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - began:.1f}s {wrong or ''}", flush=True)
    print("bad:", bad)
