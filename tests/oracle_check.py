"""Run registered queries on Spark and their SQL on DuckDB, and compare.

``python tests/oracle_check.py [folder] [name ...]`` prints one line per query.
"""

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), kind="mergesort").reset_index(drop=True) if len(frame) else frame


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = _canonical(got), _canonical(want)
    for name in got.columns:
        a, b = got[name], want[name]
        if str(a.dtype) != str(b.dtype):
            return f"{name}: dtype {a.dtype} != {b.dtype}"
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{name}: {int(bad.sum())} differ, first {a[i]!r} != {b[i]!r} in {dict(got.loc[i])} / {dict(want.loc[i])}"
        if a.isna().any():
            return f"{name}: has NULLs"
    return None


def main():
    from framesleuth.plans.catalog import oracle_sql, queries
    from framesleuth.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    for name, run in queries().items():
        if args and not any(name.startswith(a) for a in args) and run.__module__.split(".")[-1] not in args:
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            sql = oracle_sql().get(name)
            problem = "no oracle" if sql is None else compare(got, con.execute(sql).df())
            bad += problem is not None and sql is not None
            print(f"{'ok  ' if problem is None else 'BAD ' if sql else 'rows'} {name} rows={len(got)} {took:.2f}s {problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name} {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
