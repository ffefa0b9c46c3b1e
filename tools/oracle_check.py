"""Run registered queries and their DuckDB oracles side by side; report mismatches.

usage: python tools/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablecheck.plans import ORACLES, QUERIES, TABLES  # noqa: E402
from tablecheck.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or sorted(QUERIES)
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            df = QUERIES[key](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = list(df.columns)
        except Exception as exc:  # noqa: BLE001
            print(f"{key:28s} SPARK ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if key not in ORACLES:
            print(f"{key:28s} rows-only  {len(srows)} rows  {ts:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[key])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{key:28s} ORACLE ERROR {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        same_cols = sorted(scols) == sorted(ocols)
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        ok = same_cols and a == b
        if not ok:
            bad += 1
            print(f"{key:28s} MISMATCH cols_ok={same_cols} spark={len(a)} oracle={len(b)}  {ts:.1f}s")
            if not same_cols:
                print("   spark cols", sorted(scols), "\n   oracle cols", sorted(ocols))
            else:
                sa, sb = set(a), set(b)
                print("   only spark:", list(sa - sb)[:3])
                print("   only oracle:", list(sb - sa)[:3])
        else:
            print(f"{key:28s} ok  {len(a)} rows  {ts:.1f}s")
    print(f"{bad} problem(s) in {len(keys)} key(s)")


if __name__ == "__main__":
    main()
