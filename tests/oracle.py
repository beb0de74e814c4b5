"""Runs every registered query and its SQL on the same tables and compares them."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or v is pd.NaT:
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 9))
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(spark, con, run, sql, sf_dir):
    """None when both sides agree, else what differs."""
    df = run(spark, sf_dir)
    got_columns = df.columns
    got = _canonical([tuple(r) for r in df.collect()], got_columns)
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = _canonical(cursor.fetchall(), want_columns)
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{str(g)[:300]} vs {str(w)[:300]}"
    if not got:
        return "no rows on either side"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from conftest import new_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = new_session(), connect(sf_dir)
    failed = 0
    for name in names:
        sql = entry.oracle_sql().get(name)
        start = time.time()
        try:
            diff = differences(spark, con, entry.queries()[name], sql, sf_dir)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        failed += diff is not None
        print(f"{'OK  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}")
    print(f"{failed} of {len(names)} differ")
