"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from slotwise.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from slotwise.session import get_session  # noqa: E402
from slotwise.sources.testdata import TABLES  # noqa: E402


STRICT = os.environ.get("STRICT") == "1"


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if hasattr(v, "tolist"):
        return str(v.tolist())
    return str(v)


def normalize(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    load_all()
    spark = get_session("local[8]", shuffle_partitions=8, conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names or list(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in ORACLE:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(ORACLE[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a = normalize(srows, scols)
        b = normalize(drows, dcols)
        if a == b:
            print(f"OK   {name}: {len(a)} rows {dt:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}; cols={sorted(scols)}")
            print("   spark-only:", sorted(sa - sb)[:3])
            print("   duck-only: ", sorted(sb - sa)[:3])
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
