"""Run a registered Spark query and its DuckDB twin and compare them.

Mirrors the driver's check: same row count, same column names, same values
(order-insensitive). Used by ``tests/test_oracle.py`` and from the command
line: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        out.append(tuple(_norm(r[i]) for i in order))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)), \
        [cols[i] for i in order]


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str, tol: float = 0.0) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_recs = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_recs), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_recs = rel.fetchall()
    res["oracle_rows"] = len(d_recs)
    res["oracle_sec"] = round(time.time() - t1, 2)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = "schema"
        res["detail"] = {"spark_only": sorted(set(s_cols) - set(d_cols)), "oracle_only": sorted(set(d_cols) - set(s_cols))}
        return res
    a, cols = _rows(s_cols, s_recs)
    b, _ = _rows(d_cols, d_recs)
    if len(a) != len(b):
        res["status"] = "rowcount"
        return res
    bad = []
    for ra, rb in zip(a, b):
        if ra != rb:
            for c, x, y in zip(cols, ra, rb):
                if x != y:
                    if tol and isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tol * max(1, abs(y)):
                        continue
                    bad.append((c, x, y))
            if len(bad) > 5:
                break
    res["status"] = "ok" if not bad else "values"
    if bad:
        res["detail"] = bad[:6]
    return res


def main(argv):
    from loadgrid.session import build_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        try:
            r = compare(spark, con, n, fn, sqls.get(n), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "status": "error", "detail": str(e)[:600]}
        failed += r["status"] not in ("ok", "rows-only")
        print("RESULT", r, flush=True)
    print("FAILED", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
