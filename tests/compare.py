"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return float(f"{x:.12g}")
    return x


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


def differs(spark, con, sf_dir: str, query, sql: str) -> str:
    got_df = query(spark, sf_dir)
    got, want = got_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}; only one side: {[x for x in set(a) ^ set(b)][:4]}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"values {sorted(got.columns)}: {x} and {y}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from lodestrata.session import build_session

    spark = build_session("compare", "local[8]", 8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            said = differs(spark, con, sf, query, sql[name]) if name in sql else f"ok, no SQL, {query(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said) and not said.startswith("ok")
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bad > 0)
