"""Run registered queries against their check SQL in DuckDB.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> str | None:
    """None when equal, else a short description."""
    left_cols = df.columns
    left = rows_of(left_cols, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    right_cols = [d[0] for d in rel.description]
    right = rows_of(right_cols, rel.fetchall())
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(left_cols)} != {sorted(right_cols)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {sorted(left_cols)}: {bad[0]}" if bad else None


def main():
    import __spark_entry__ as e
    from tillwater.session import session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = e.oracle_sql()
    failed = []
    for name, fn in e.queries().items():
        if len(args) > 1 and not any(a in name for a in args[1:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                why = differences(df, con, sqls[name])
                status = "ok" if why is None else f"DIFF {why}"
            else:
                status = f"rows-only {df.count()}"
        except Exception as error:  # report and go on
            status = f"ERROR {type(error).__name__}: {str(error)[:400]}"
        if status.startswith(("DIFF", "ERROR")):
            failed.append(name)
        print(f"{name:36s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
