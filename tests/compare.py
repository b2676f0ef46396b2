"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame = frame.assign(**{c: frame[c].astype("datetime64[us]")})
        elif str(frame[c].dtype) in ("Int64", "Int32"):  # numbers with NULL are floats in a plain frame
            frame = frame.assign(**{c: frame[c].astype("float64")})
        elif frame[c].map(lambda v: type(v).__name__ == "date").any():
            frame = frame.assign(**{c: pd.to_datetime(frame[c]).astype("datetime64[us]")})
    return frame.sort_values(list(frame.columns), ignore_index=True)


def differences(got: pd.DataFrame, expected: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(expected.columns):
        return [f"columns {sorted(got.columns)} != {sorted(expected.columns)}"]
    if len(got) != len(expected):
        return [f"{len(got)} rows != {len(expected)}"]
    got, expected = _sorted(got), _sorted(expected)
    found = []
    for c in got.columns:
        a, b = got[c], expected[c]
        if a.dtype != b.dtype:
            found.append(f"{c}: type {a.dtype} != {b.dtype}")
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            found.append(f"{c}: {int((~same).sum())} values differ, first {a[i]!r} != {b[i]!r}")
    return found


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from colloquy.session import local_session

    sf, chosen = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    oracles = contract.oracle_sql()
    for name, build in contract.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            start = time.time()
            got = build(spark, folder).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name}: {len(got)} rows, {took:.2f}s", flush=True)
                continue
            start = time.time()
            expected = con.execute(oracles[name]).df()
            bad = differences(got, expected)
            print(f"{'DIFF' if bad else 'same'}  {name}: {len(got)} rows, {took:.2f}s, sql {time.time() - start:.2f}s", *bad, sep="\n   ", flush=True)
        except Exception as error:
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
