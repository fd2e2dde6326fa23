"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names/types and an order-insensitive value multiset.

    python tests/compare_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19] if hasattr(v, "hour") else v.isoformat()
    return v


SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "float": "FLOAT",
}


def type_mismatches(spark_dtypes, duck_cols, duck_types):
    duck = dict(zip(duck_cols, (str(t) for t in duck_types)))
    return [(c, t, duck.get(c)) for c, t in spark_dtypes if SPARK_TO_DUCK.get(t, t) != duck.get(c)]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries

    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_types = sdf.dtypes
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"rows-only {len(s_rows)}"
            print(f"{name:22s} {results[name]}  spark {t1 - t0:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            d_cols = rel.columns
            d_types = rel.types
            d_rows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = f"DUCKDB ERROR {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        ok_v = a == b
        bad_types = type_mismatches(s_types, d_cols, d_types) if ok_cols else []
        status = "OK" if (ok_cols and ok_n and ok_v and not bad_types) else "MISMATCH"
        results[name] = status
        print(f"{name:22s} {status} rows {len(s_rows)}/{len(d_rows)} cols {ok_cols}  spark {t1 - t0:.1f}s", flush=True)
        if status != "OK" and verbose:
            if not ok_cols:
                print("   spark cols:", s_cols, "\n   duck cols: ", d_cols)
            elif bad_types:
                print("   types (column, spark, duckdb):", bad_types)
            else:
                print("   spark-only:", list((a - b).items())[:3])
                print("   duck-only: ", list((b - a).items())[:3])
    return results


if __name__ == "__main__":
    from demandkit.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session(master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v not in ("OK",) and not v.startswith("rows-only")]
    print("FAILED:", bad if bad else "none")
