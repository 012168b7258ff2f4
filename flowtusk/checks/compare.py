"""Run queries next to their SQL counterparts: `python -m flowtusk.checks.compare [name ...]`."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from flowtusk.checks.oracles import ORACLES
from flowtusk.checks.queries import QUERIES
from flowtusk.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True) if len(df) else df


def difference(spark, con, folder: str, name: str, queries=QUERIES, oracles=ORACLES) -> str | None:
    """None when both sides agree, else what differs."""
    ours = _ordered(queries[name](spark, folder).toPandas())
    theirs = _ordered(con.execute(oracles[name]).fetch_df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} / {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    try:
        pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=0)
    except AssertionError as error:
        return str(error)
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours if ours[c].dtype != theirs[c].dtype}
    return f"dtypes {kinds}" if any(a != b for a, b in kinds.values()) else None


def main(names: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con, failed = local_session(), connect(folder), 0
    for name in names or QUERIES:
        begun = time.time()
        if name not in ORACLES:
            print(f"{name}: no SQL", flush=True)
            continue
        try:
            found = difference(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{name}: {found or 'equal'} ({time.time() - begun:.1f}s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
