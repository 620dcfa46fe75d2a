"""Run registered queries beside their SQL: python tests/compare.py [folder] [name prefix ...]."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def views(folder: str):
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return db


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: "" if v is None or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = canonical(got), canonical(want)
    kinds = [c for c in a.columns if a[c].dtype.kind != b[c].dtype.kind]
    if kinds and len(a):
        return f"types {[(c, str(a[c].dtype), str(b[c].dtype)) for c in kinds]}"
    for c in a.columns:
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            k = int(bad.idxmax())
            return f"{c}: {int(bad.sum())} of {len(a)} differ, first {dict(a.loc[k])} != {dict(b.loc[k])}"
    return None


if __name__ == "__main__":
    from conftest import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = session(), views(folder)
    sql = entry.oracle_sql()
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took, mid = time.time() - start, time.time()
            if name in sql:
                bad = difference(got, db.execute(sql[name]).df())
                print(f"{'DIFF' if bad else 'ok  '} {name:36s} {len(got):8d} rows {took:6.2f}s / sql {time.time() - mid:5.2f}s {bad or ''}", flush=True)
            else:
                print(f"rows {name:36s} {len(got):8d} rows {took:6.2f}s", flush=True)
        except Exception as e:
            print(f"FAIL {name:36s} {type(e).__name__}: {str(e)[:600]}", flush=True)
