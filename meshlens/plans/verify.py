"""Local correctness check: every registered query against its DuckDB oracle.

Usage::

    python -m meshlens.plans.verify [sf_dir] [name-substring ...]

For each query: row count, column names, and an order-insensitive comparison
of the value multisets (floats compared after rounding to 6 significant
digits, timestamps as ISO text).  Queries without oracle get a rows-only run.
"""

from __future__ import annotations

import datetime as _dt
import json
import math
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from meshlens.plans import catalog
from meshlens.sources.tables import TABLE_NAMES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == 0:
            return 0.0
        return float(f"{v:.6g}")
    if isinstance(v, Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check_one(spark, con, name: str, sf_dir: str) -> dict:
    fn = catalog.REGISTRY[name].fn
    sql = catalog.REGISTRY[name].sql
    out = {"name": name}
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = df.collect()
    out["spark_sec"] = round(time.time() - t0, 2)
    out["rows"] = len(rows)
    if sql is None:
        out["status"] = "rows-only"
        return out
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    out["oracle_rows"] = len(drows)
    if sorted(cols) != sorted(dcols):
        out["status"] = "COLS"
        out["detail"] = {"spark": cols, "oracle": dcols}
        return out
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in rows)
    b = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    if a == b:
        out["status"] = "OK"
    else:
        out["status"] = "VALUES" if len(rows) == len(drows) else "ROWCOUNT"
        only_s = list((a - b).elements())[:3]
        only_d = list((b - a).elements())[:3]
        out["detail"] = {"cols": order, "spark_only": [str(x) for x in only_s],
                         "oracle_only": [str(x) for x in only_d]}
    return out


def main(argv: list[str]) -> int:
    from meshlens.session import get_spark

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv if not a.startswith("/")]
    spark = get_spark()
    con = duck_connect(sf_dir)
    names = [n for n in catalog.queries() if not pats or any(p in n for p in pats)]
    bad = 0
    for n in names:
        try:
            r = check_one(spark, con, n, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": n, "status": "ERROR", "detail": f"{type(e).__name__}: {str(e)[:600]}"}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(json.dumps(r, default=str), flush=True)
    print(json.dumps({"checked": len(names), "failed": bad}))
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
