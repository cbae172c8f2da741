"""Compare registered queries with their SQL on DuckDB.

usage: python tests/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_normal(r[i]) for i in order) for r in rows)


def compare(df, con, text):
    """None when equal, else a short description of the difference."""
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(text)
    want_columns, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} / {want_columns}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}", len(got)
    different = [(g, w) for g, w in zip(got, want) if g != w]
    if different:
        return f"{len(different)} rows differ, first: {different[0][0]} / {different[0][1]}", len(got)
    return None, len(got)


def main(argv):
    import __spark_entry__ as entry
    from moneytrail.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session()
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracle:
                problem, n = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                problem = None
            note = "" if name in oracle else " (rows only)"
        except Exception as error:
            problem, n, note = f"{type(error).__name__}: {str(error)[:900]}", -1, ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {n:7d} rows {time.time() - start:6.2f}s{note}", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
