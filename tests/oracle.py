"""Run registered queries next to their check SQL in DuckDB and compare the rows.

Usage: python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=repr)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(close(x, y) for x, y in zip(a, b))
    return type(a) is type(b) and a == b


def compare(spark, con, name: str, sf_dir: str) -> str:
    from voxrill.plans.catalog import CHECK_SQL, QUERIES

    df = QUERIES[name](spark, sf_dir)
    scols, srows = rows_of(df.columns, [[r[i] for i in range(len(df.columns))] for r in df.collect()])
    if name not in CHECK_SQL:
        return f"rows-only n={len(srows)}"
    rel = con.sql(CHECK_SQL[name])
    dcols, drows = rows_of(rel.columns, rel.fetchall())
    if scols != dcols:
        return f"DIFF columns {scols} vs {dcols}"
    if len(srows) != len(drows):
        return f"DIFF rows {len(srows)} vs {len(drows)}; only spark {[r for r in srows if r not in drows][:2]} only duck {[r for r in drows if r not in srows][:2]}"
    if srows == drows and [[type(x) for x in r] for r in srows] == [[type(x) for x in r] for r in drows]:
        return f"ok n={len(srows)}" + ("" if srows else "  EMPTY")
    bad = [(a, b) for a, b in zip(srows, drows) if not close(a, b)]
    if not bad:
        noisy = [(scols[i], x, y) for a, b in zip(srows, drows) for i, (x, y) in enumerate(zip(a, b)) if x != y]
        return f"NOISE n={len(srows)} {noisy[:3]}"
    return f"DIFF values {len(bad)}/{len(srows)} {scols} e.g. {bad[0]}"


def main(argv: list[str]) -> int:
    from voxrill.plans.catalog import QUERIES
    from voxrill.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session("oracle", cores=8), duck(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            res = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += not res.startswith(("ok", "rows-only"))
        print(f"{n:32s} {time.time() - t:6.1f}s  {res}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
