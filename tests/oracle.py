"""Runs catalogue queries next to their SQL in DuckDB and compares rows, columns, types and values.

    python tests/oracle.py [--sf 0.01] [--rows N] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strataline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == object:
            frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA else (list(v) if hasattr(v, "tolist") else v))
            frame[c] = frame[c].map(lambda v: str(v) if isinstance(v, (list, dict)) else v)
    return frame.sort_values(list(frame.columns), na_position="first", kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = _plain(got), _plain(want)
    notes = []
    for c in a.columns:
        if a[c].dtype != b[c].dtype and not (a[c].isna().all() and b[c].isna().all()):
            notes.append(f"type of {c}: {a[c].dtype} / {b[c].dtype}")
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            notes.append(f"{c}: {int(bad.sum())} differ, first {a[c][i]!r} / {b[c][i]!r}")
    return "; ".join(notes) or None


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sf_dir: str) -> tuple[str | None, int]:
    got = query.plan(spark, sf_dir).toPandas()
    if query.sql is None:
        return None, len(got)
    return difference(got, con.execute(query.sql).df()), len(got)


def main() -> int:
    from strataline.plans.catalog import CATALOG
    from strataline.settings import GROUP_ROWS

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--rows", type=int)
    args.add_argument("--threads", type=int, default=5)
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    sf_dir = f"/root/testdata/sf{opts.sf}"
    spark, con = session(), database(sf_dir)
    if opts.rows:
        spark.conf.set(GROUP_ROWS, str(opts.rows))
    wanted = [q for n, q in CATALOG.items() if not opts.names or any(n.startswith(p) for p in opts.names)]

    def run(query) -> bool:
        start = time.time()
        try:
            problem, rows = compare(spark, con.cursor(), query, sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        note = "" if query.sql else " (no sql)"
        mark = "FAIL" if problem else "ok  "
        print(f"{mark} {query.name:34s} {rows:7d} rows {time.time() - start:6.1f}s{note} {problem or ''}", flush=True)
        return problem is not None

    with ThreadPoolExecutor(opts.threads) as pool:
        failed = sum(pool.map(run, wanted))
    print(f"{failed} of {len(wanted)} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
