"""Run queries beside their SQL twins in DuckDB and report differences.

    python tools/check.py [--sf DIR] [name-prefix ...]
"""

import argparse
import importlib
import math
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def make_spark(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    return sorted((tuple(plain(v) for v in row) for row in pdf[cols].itertuples(index=False)), key=repr)


def kind(dtype) -> str:
    return "float" if str(dtype).startswith("float") else str(dtype).lower()


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(got), rows_of(want)
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, cols {sorted(got.columns)}: {bad[0][0]} != {bad[0][1]}"
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if kind(got[c].dtype) != kind(want[c].dtype)]
    return f"types {types}" if types and len(got) else None


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default=None, help="one query family module, without loading the others")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tabulon.queries import ORACLES, QUERIES, load_all

    if args.only:
        for m in args.only.split(","):
            importlib.import_module(f"tabulon.queries.{m}")
    else:
        load_all()
    names = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    spark, con = make_spark(), connect(args.sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            got = QUERIES[n](spark, args.sf).toPandas()
            took = time.time() - t0
            if n in ORACLES:
                t1 = time.time()
                problem = compare(got, con.execute(ORACLES[n]).df())
                note = f"ok duck {time.time() - t1:.1f}s" if problem is None else problem
            else:
                problem, note = (None, "no sql") if len(got) else ("empty", "EMPTY")
        except Exception as e:  # noqa: BLE001
            problem, took, note = "error", time.time() - t0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {n} {took:.1f}s rows={len(got) if problem != 'error' else '-'} {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} pass")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
