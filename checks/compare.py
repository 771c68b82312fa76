"""Run every query in Spark and its SQL in DuckDB and report where they differ.

python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import oracle
from tallywarden.plans.catalog import catalog
from tallywarden.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return df


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same rows in any order, else what differs."""
    # Whole numbers with nulls arrive as floats from one side and as nullable integers from the other.
    got = got.astype({c: "Int64" for c in got.columns if c in want.columns and str(want[c].dtype) == "Int64" and str(got[c].dtype) == "float64"})
    got, want = _plain(got), _plain(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    left = sorted(map(repr, got.itertuples(index=False, name=None)))
    right = sorted(map(repr, want.itertuples(index=False, name=None)))
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> int:
    spark = build_session("checks", "local[8]", 8)
    con, queries, sql = connect(folder), catalog(), oracle()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            problem = difference(got, con.sql(sql[name]).df()) if name in sql else None
            note = f"{len(got)} rows" + ("" if name in sql else ", no SQL")
        except Exception as error:
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
