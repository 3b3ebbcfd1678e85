"""Run catalog queries in Spark and their oracle SQL in DuckDB, and compare.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from terroir.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import numpy as np
        if isinstance(v, np.generic):
            v = v.item()
    except ImportError:
        pass
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, int):
        return int(v)
    if hasattr(v, "__float__") and type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) for v in row)


def compare(spark_rows, duck_rows, rel_tol=0.0):
    a = sorted(spark_rows, key=_key)
    b = sorted(duck_rows, key=_key)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u == v:
                continue
            if isinstance(u, float) and isinstance(v, float) and rel_tol and math.isclose(u, v, rel_tol=rel_tol):
                continue
            return False, f"first diff {x} vs {y}"
    return True, "ok"


def run(spark, sf_dir, prefixes=(), verbose=False):
    from terroir.plans import catalog
    entries = catalog.load_all()
    con = duck(sf_dir)
    results = {}
    for name, e in entries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if verbose and results:
            last = list(results)[-1]
            _report(last, results[last])
        t0 = time.time()
        try:
            df = e.fn(spark, sf_dir)
            scols, srows = rows_of_spark(df)
        except Exception as exc:  # noqa: BLE001
            results[name] = (False, f"spark error: {type(exc).__name__}: {str(exc)[:300]}")
            continue
        t1 = time.time()
        if e.sql is None:
            results[name] = (True, f"rows-only {len(srows)} ({t1 - t0:.1f}s)")
            continue
        try:
            dcols, drows = rows_of_duck(con, e.sql)
        except Exception as exc:  # noqa: BLE001
            results[name] = (False, f"duckdb error: {str(exc)[:300]}")
            continue
        if scols != dcols:
            results[name] = (False, f"columns {scols} vs {dcols}")
            continue
        ok, msg = compare(srows, drows)
        results[name] = (ok, f"{msg} rows={len(srows)} ({t1 - t0:.1f}s)")
    return results


def _report(name, res):
    ok, msg = res
    print(("PASS " if ok else "FAIL ") + name + ": " + msg, flush=True)


if __name__ == "__main__":
    from terroir.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    res = run(spark, sf, tuple(sys.argv[2:]), verbose=True)
    if res:
        last = list(res)[-1]
        _report(last, res[last])
    bad = sum(0 if ok else 1 for ok, _ in res.values())
    print(f"{len(res) - bad}/{len(res)} passed")
