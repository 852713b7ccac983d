"""Run registered queries beside their SQL oracle and compare schema, row count and values.

    python tests/compare.py [--sf 0.01] [key-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridledger.fixtures import TABLES  # noqa: E402

DATA = os.environ.get("GRIDLEDGER_DATA", "/root/testdata")


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "asDict"):
        return tuple((k, cell(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, key, fn, sql, sf_dir):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows only  spark {t1 - t0:.1f}s"
    con = duck(sf_dir)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows  spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if len(got) != len(want):
        return False, f"{note}: row count {len(got)} != {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    for x, y in zip(a, b):
        if x != y:
            return False, f"{note}: first difference\n   spark {x}\n   duck  {y}\n   columns {sorted(cols)}"
    if not got:
        return False, "no rows"
    return True, note


def main(argv):
    from gridledger import plans
    from gridledger.session import build_session
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    plans.load_all()
    spark = build_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for key, fn in plans.QUERIES.items():
        if argv and not any(key.startswith(p) for p in argv):
            continue
        try:
            ok, note = check(spark, key, fn, plans.ORACLES.get(key), f"{DATA}/sf{sf}")
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok   " if ok else "FAIL ") + key + "  " + note, flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(bad)} failing: {' '.join(bad)}")


if __name__ == "__main__":
    main(sys.argv[1:])
